"""Previews, pages, systematic samples and exact splits. Orders are explicit, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stored


def numbered(df: DataFrame, order: Sequence[str], name: str = "__i") -> DataFrame:
    """df with its place from 0 in a total order, without sorting in one task: sorted ranges are counted, then numbered."""
    import pyarrow as pa
    from pyspark import TaskContext

    ordered = df.sort(*order)
    schema = ordered.schema

    def tag(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "__part", "__at"])
            at += b.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    tagged = stored(ordered.mapInArrow(tag, f"{fields}, __part int, __at bigint"))
    sizes = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return tagged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with its place from 1 among the rows of the same keys, in a total order; a key's rows may lie in many tasks."""
    placed = numbered(df, [*keys, *order], "__place")
    first = placed.groupBy(*keys).agg(F.min("__place").alias("__first"))
    return placed.join(first, list(keys)).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def even_sample(df: DataFrame, order: Sequence[str], size: int = 100, head_until: int = 1000) -> DataFrame:
    """All of up to `size` rows, the first `size` of up to head_until, else `size` evenly spaced ones from first to last."""
    n = df.count()
    if n <= size:
        return df
    rows = numbered(df, order)
    if n <= head_until:
        return rows.where(F.col("__i") < size).drop("__i")
    wanted = df.sparkSession.createDataFrame([(i * (n - 1) // (size - 1),) for i in range(size)], "__i bigint")
    return rows.join(F.broadcast(wanted), "__i").drop("__i")


def systematic_sample(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows round(i n / size)."""
    n = df.count()
    wanted = df.sparkSession.createDataFrame(sorted({(min(n - 1, int(i * n / size + 0.5)),) for i in range(size)}) if n else [], "__i bigint")
    return numbered(df, order).join(F.broadcast(wanted), "__i").drop("__i")


def page(df: DataFrame, order: Sequence[str], number: int, limit: int = 50) -> tuple[DataFrame, dict]:
    """One page in a total order, and the paging facts; limits outside 1 to 100 become 50, pages start at 1."""
    limit, number = limit if 1 <= limit <= 100 else 50, max(1, number)
    n = df.count()
    pages = -(-n // limit)
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit), {"page": number, "limit": limit, "total": n, "total_pages": pages, "has_next": number < pages, "has_prev": number > 1}


def _draw(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _exact(share: float) -> Decimal:
    """The share as it is written: in doubles 90,000 times 0.7 is less than 63,000."""
    return Decimal(str(share))


def split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42, least: int = 10, least_part: int = 5) -> DataFrame:
    """df with `part`, discovery or validation: exactly round-down(n share) rows with the least seeded hashes of their unique key."""
    n = df.count()
    first = int(n * _exact(share))
    if n < least or min(first, n - first) < least_part:
        raise ValueError(f"too few rows to split: {n}")
    rank = numbered(df.select(key, _draw(key, seed).alias("__h")), ["__h", key]).select(key, (F.col("__i") < first).alias("__d"))
    return df.join(rank, key).withColumn("part", F.when(F.col("__d"), "discovery").otherwise("validation")).drop("__d")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """As split() within each stratum: the rounded share, at least one row and at most all but one; strata of one are discovery."""
    w = Window.partitionBy(stratum)
    n = F.count(F.lit(1)).over(w)
    rows = df.withColumns({"__n": n, "__k": F.row_number().over(w.orderBy(_draw(key, seed), key))})
    rounded = F.floor(F.col("__n") * F.lit(_exact(share)) + F.lit(Decimal("0.5"))).cast("long")
    first = F.when(F.col("__n") == 1, 1).otherwise(F.greatest(F.lit(1), F.least(rounded, F.col("__n") - 1)))
    return rows.withColumn("part", F.when(F.col("__k") <= first, "discovery").otherwise("validation")).drop("__n", "__k")


def split_power(n_discovery: int, n_validation: int) -> tuple[bool, float]:
    """Whether both parts are large enough, and the power tier of the smaller."""
    small = min(n_discovery, n_validation)
    return n_discovery >= 30 and n_validation >= 20, 0.95 if small >= 1000 else 0.80 if small >= 100 else 0.50 if small >= 30 else 0.05


def _times(key: str, share: float, seed: int):
    """How often the round in column `round` draws a key: a Poisson count of mean `share` from a seeded hash."""
    u = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:"), F.col("round").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    p, total, cuts = exp(-share), 0.0, []
    for k in range(1, 12):
        total += p
        cuts.append(total)
        p *= share / k
    passed = lambda x: sum((F.when(x >= c, 1).otherwise(0) for c in cuts[1:]), F.when(x >= cuts[0], 1).otherwise(0))
    return F.element_at(F.transform(F.array(u), passed), 1)  # so that a row is hashed once, not once per cut


def bootstrap(df: DataFrame, key: str, rounds: int = 10, share: float = 0.8, seed: int = 42) -> DataFrame:
    """round, and df's rows once per draw: Poisson counts of mean `share` from seeded hashes of the key, so any partition agrees."""
    rounds_ = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return rounds_.withColumn("__t", _times(key, share, seed)).where("__t > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__t")


def bootstrap_sizes(df: DataFrame, key: str, rounds: int = 10, share: float = 0.8, seed: int = 42) -> DataFrame:
    """round, n and distinct, the rows and the different keys of each of bootstrap()'s rounds. All rows of a key are drawn alike, so a key's
    rows are counted once, before the rounds, and a round is a sum: no task holds a round's keys."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    drawn = keys.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("__t", _times(key, share, seed))
    return drawn.groupBy("round").agg(F.sum(F.col("__n") * F.col("__t")).alias("n"), F.count(F.when(F.col("__t") > 0, F.col(key))).alias("distinct")).where("n > 0")
