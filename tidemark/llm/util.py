"""What the corpus operators share: scratch tables, skew-proof lookups, row identity, word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_folder

#: A key is hot if it holds more than one row in so many; so at most that many keys are hot.
HOT_SHARE = 256
#: A table known to have no more rows of a few longs is broadcast whole.
HELD = 1 << 15
#: Bytes, by Spark's own estimate, of what a join may broadcast without being told to.
AUTO = 1 << 20

_own_folder: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temp folder of its own only where that is unset and the master is local."""
    if folder := checkpoint_folder(spark):
        return folder
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, name: str, value: str = "true") -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """What runs within gives its shuffle files back as it ends, and not only once the driver collects its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def sorted_aggregates(spark: SparkSession):
    """What runs within groups rows that a window has sorted by their keys as they come, instead of hashing and sorting them again."""
    return _set(spark, "spark.sql.execution.replaceHashWithSortAgg")


def small_broadcasts(spark: SparkSession):
    """In what is planned within, Spark broadcasts by itself only what it takes for AUTO bytes at most: it goes by the size of files and
    of a default value of each type, so hashes and texts come out several times as large on the driver."""
    set_to = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return _set(spark, "spark.sql.autoBroadcastJoinThreshold", str(min(set_to, AUTO)))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table: the lineage is cut and lost executors lose nothing. The shuffles
    behind it are freed, as nothing reads them again."""
    path = new_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession), small_broadcasts(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows at most, so that a batch of long ones fits beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int, how: str = "left", hot: DataFrame | None = None, held: int | None = None) -> DataFrame:
    """left with right's other columns. right has one row per key (keys not null); left may have any number per key.

    Keys with more than rows/HOT_SHARE rows in left, HOT_SHARE of them at most, are joined by a broadcast; their rows
    then take part in the shuffled join under keys of their own and so don't meet in one task. rows: left's row count.
    Null keys match nothing. how: left or inner. left should be a stored table, as it is read twice; not where the hot keys
    are known and given. held: right's row count at most, if that is known and its rows are a few longs; HELD of them are broadcast
    whole, by one join instead of three.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    if held is not None and held <= HELD:
        return left.join(F.broadcast(right), keys, how).select(*left.columns, *values)
    hot = hot.select(*keys) if hot is not None else (
        left.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_from(rows))
        .select(*keys)
    )
    head = right.join(F.broadcast(hot), keys, "left_semi")
    named = head.select(*[F.col(k).alias(f"__h_{k}") for k in keys], *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__h"))
    on = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    met = left.join(F.broadcast(named), on, "left")
    # a further key on both sides: a hash of the keys, or for rows that are done a number of their own, so that they spread
    done = F.coalesce(F.col("__h"), F.lit(False)) | F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys))
    met = met.withColumn("__lone", F.when(done, F.monotonically_increasing_id()).otherwise(F.xxhash64(*keys)))
    cold = right.select(*[F.col(k).alias(f"__c_{k}") for k in keys], *[F.col(v).alias(f"__c_{v}") for v in values], F.xxhash64(*keys).alias("__c_lone"), F.lit(True).alias("__c"))
    joined = met.join(cold, [F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__lone") == F.col("__c_lone")], "left")
    if how == "inner":
        joined = joined.where("__h OR __c")
    taken = [F.when(F.col("__h"), F.col(f"__h_{v}")).otherwise(F.col(f"__c_{v}")).alias(v) for v in values]
    return joined.select(*left.columns, *taken)


def hot_from(rows: int) -> int:
    return max(1, rows // HOT_SHARE)


def text_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What tells rows apart: the id (null as the least long) and a hash of the text. Rows equal in both are interchangeable."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("__hash")]


def keep_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows whose (__id, __hash), as row_key() has them, are in bad (distinct)."""
    keyed = docs.select(F.struct("*").alias("kept"), *row_key(docs))  # a struct, as docs may have columns of any name
    return keyed.join(bad.select("__id", "__hash").hint("shuffle_hash"), ["__id", "__hash"], "left_anti").select("kept.*")


def head_of(rows: DataFrame, column: str, most: int) -> Column:
    """A condition that holds for the rows with the largest positive numbers in the column, `most` rows at most. Rows are counted by
    eighths of powers of two, so a few hundred counts come to the driver; of rows in one such step all or none are taken."""
    step = F.floor(F.log2(F.col(column)) * 8)
    least, so_far = 1 << 10, 0
    for r in sorted(rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if (so_far := so_far + r["n"]) > most:
            break
        least = r["step"]
    return step >= least


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with their rank (1, 2, 3...) in an order, which should end in a column that tells rows apart. Ranges of the order are sorted
    in tasks of their own; one number per range comes to the driver."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = keep(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranks")  # the range above bit 33, the place in it below
    part = F.shiftright("__at", 33)
    starts, at = [], 0
    for r in sorted(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["part"], at))
        at += r["n"]
    begins = rows.sparkSession.createDataFrame(starts, "__part bigint, __begin bigint")
    placed = numbered.join(F.broadcast(begins), part == F.col("__part"))
    return placed.select(*rows.columns, (F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def columns_of_binary(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary or string array's bytes and its n+1 offsets, counted from the first of those bytes. Nulls are empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, each set if a hash in the column ends in its number. Its size is fixed, however many the hashes."""
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(at, 5).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 31L AS INT))").alias("bit"))
    with freed_shuffles(hashes.sparkSession):
        table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    for b in table.to_batches():
        out[b.column("word").to_numpy()] = b.column("bit").to_numpy().astype(np.uint32)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.uint64) & np.uint64(len(bitmap) * 32 - 1)
    return (bitmap[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output's."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
