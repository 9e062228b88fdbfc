"""Merging data sets: set operations, duplicate policies, time-series merges, outliers, business time, cohort and key joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import GRAINS, epoch, parse_timestamp
from tidemark.operators.temporal import filled
from tidemark.session import stored

DUPLICATES = ("keep_first", "keep_last", "remove_all", "error")
# Names of time columns, the likeliest first, and words that such names hold.
TIME_NAMES = ("timestamp", "datetime", "time", "date", "created_at", "updated_at", "occurred_at", "recorded_at", "period", "event_time", "transaction_time")
TIME_WORDS = ("time", "date", "created", "updated", "occurred")


def time_column(columns: Sequence[str], or_first: bool = False) -> str | None:
    """The likeliest time column: a known name, else one that holds a time word, else none (or the first)."""
    lower = {c.lower(): c for c in reversed(columns)}
    known = next((lower[n] for n in TIME_NAMES if n in lower), None)
    return known or next((c for c in columns if any(w in c.lower() for w in TIME_WORDS)), columns[0] if or_first and columns else None)


def same_columns(frames: Sequence[DataFrame]) -> None:
    first = {c.lower() for c in frames[0].columns}
    for i, f in enumerate(frames[1:], 2):
        if {c.lower() for c in f.columns} != first:
            raise ValueError(f"table {i} has other columns than the first: {sorted({c.lower() for c in f.columns} ^ first)}")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns in any order."""
    same_columns(frames)
    return reduce(DataFrame.unionByName, frames)


def deduplicated(df: DataFrame, keys: Sequence[str], order: Sequence, policy: str = "keep_first") -> DataFrame:
    """One row of each key in the given (total) order, or none where a key repeats, or an error if one does."""
    if policy not in DUPLICATES:
        raise ValueError(f"unknown policy {policy!r}")
    keys = list(keys) or df.columns
    if policy in ("remove_all", "error"):
        counted = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        if policy == "error":
            return counted.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a key repeats")).cast("boolean")).otherwise(True)).drop("__n")
        return counted.where("__n = 1").drop("__n")
    w = Window.partitionBy(*keys).orderBy(*(order if policy == "keep_first" else [F.desc(c) if isinstance(c, str) else c.desc() for c in order]))
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def merged(frames: Sequence[DataFrame], how: str, keys: Sequence[str] = ()) -> DataFrame:
    """union, inner, left, outer (by keys; other columns of equal name get _2, _3 ...) or intersect of tables in order."""
    if how == "union":
        return union_all(frames)
    if how == "intersect":
        same_columns(frames)
        return reduce(lambda a, b: a.intersect(b.select(a.columns)), frames)
    if how not in ("inner", "left", "outer"):
        raise ValueError(f"unknown merge {how!r}")
    out = frames[0]
    for i, f in enumerate(frames[1:], 2):
        f = f.select(*[F.col(c).alias(c if c in keys or c not in out.columns else f"{c}_{i}") for c in f.columns])
        out = out.join(f, list(keys), how)
    return out


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", suffixes: tuple[str, str] = ("_left", "_right"), unique: bool = False) -> DataFrame:
    """An equi-join with suffixes for other columns that both have; `unique` makes a repeated right key an error."""
    missing = [k for k in keys if k not in left.columns or k not in right.columns]
    if missing:
        raise ValueError(f"both tables need {missing}")
    both = (set(left.columns) & set(right.columns)) - set(keys)
    if unique:
        right = deduplicated(right, keys, [], "error")
    named = lambda f, s: f.select(*[F.col(c).alias(c + s if c in both else c) for c in f.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(keys), how)


def flagged(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with whether its key is among right's."""
    return left.join(right.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def time_rows(df: DataFrame, column: str, source_zone: str = "UTC", target_zone: str = "UTC") -> DataFrame:
    """df with `ts`, its text time read in one zone and told in another; rows without a time go."""
    local = F.convert_timezone(F.lit(source_zone), F.lit(target_zone), parse_timestamp(F.col(column)).cast("timestamp_ntz"))
    return df.withColumn("ts", local).where("ts IS NOT NULL")


def per_second(df: DataFrame, policy: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row a second: the first, the last, the newest by full time, or all (aggregate)."""
    if policy == "aggregate":
        return df
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    ranks = {"first": [F.asc(c) for c in order], "last": [F.desc(c) for c in order], "newest": [F.desc("ts"), *[F.desc(c) for c in order]]}[policy]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by, second).orderBy(*ranks))).where("__k = 1").drop("__k")


def without_outliers(df: DataFrame, columns: Sequence[str], z: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose every value lies within z population deviations of its column's mean; null and constant columns pass."""
    stats = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"__{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row
    far = [F.coalesce(F.abs(F.col(c) - F.col(f"__m{i}")) > z * F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")), F.lit(False)) for i, c in enumerate(columns)]
    return both.where(~reduce(Column.__or__, far)).select(*df.columns)


#: Rows of a stretch of a series, about; and knots around one, beyond which a spline isn't felt (each halves what is left and more).
STRETCH, AROUND = 4096, 64


def stretched(rows: DataFrame, by: Sequence[str], t: str = "t") -> DataFrame:
    """rows with the stretch of their series that they lie in; equal times share one."""
    of = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / STRETCH).alias("__parts"), F.min(t).alias("__low"), F.max(t).alias("__high"))
    width = F.col("__high") - F.col("__low")
    part = F.when(width > 0, F.least(F.floor((F.col(t) - F.col("__low")) * F.col("__parts") / F.when(width > 0, width)), F.col("__parts") - 1)).otherwise(0)
    return rows.join(of, list(by)).withColumn("stretch", part).drop("__parts", "__low", "__high")


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """rows, which have their stretch, with the last value that isn't null up to each in the order (ahead: the first from it on). Taken within
    stretches; what a stretch begins without comes from those before it."""
    inside = Window.partitionBy(*by, "stretch").orderBy(*order)
    found = F.first(value, True).over(inside.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last(value, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    pick = F.min_by if ahead else F.max_by
    ends = rows.where(F.col(value).isNotNull()).groupBy(*by, "stretch").agg(pick(value, F.struct(*order)).alias("__end"))
    every = rows.select(*by, "stretch").distinct().join(ends, [*by, "stretch"], "left")
    over = Window.partitionBy(*by).orderBy(F.col("stretch").desc() if ahead else F.col("stretch")).rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    came = every.select(*by, "stretch", F.last("__end", True).over(over).alias("__came"))
    return rows.withColumn(name, found).join(came, [*by, "stretch"]).withColumn(name, F.coalesce(name, "__came")).drop("__came")


def resampled(points: DataFrame, grain: str, ts: str = "ts", value: str = "value", by: Sequence[str] = ("series",), linear: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """by, bucket, value on a grid from each series' first time: the last row at or before a grid point, or linear between neighbours. Rows of
    one time are in the order of `ties`. Of the rows between two grid points only the first and the last are felt, so they are aggregated,
    and what is carried is a row per grid point."""
    step, by = GRAINS[grain], list(by)
    of = points.select(*by, epoch(F.col(ts)).alias("t"), F.col(value).cast("double").alias("v"), F.struct(epoch(F.col(ts)), *ties).alias("at"))
    first = of.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = first.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t1") - F.col("t0")) / step).cast("bigint"))).alias("k"), "t0").select(*by, "k", (F.col("t0") + F.col("k") * step).alias("t"))
    point = lambda k: F.col("t0") + k * step
    near = F.ceil((F.col("t") - F.col("t0")) / step).cast("bigint")  # the grid point at or after a row, but for rounding
    k = F.when(F.col("t") > point(near), near + 1).when(F.col("t") <= point(near - 1), near - 1).otherwise(near)
    known = F.struct("v", "t")
    cells = stored(of.where("v IS NOT NULL").join(first, by).withColumn("k", k).groupBy(*by, "k").agg(F.max_by(known, "at").alias("last"), F.min_by(known, "at").alias("first")))
    after = cells.select(*by, (F.col("k") - 1).alias("k"), "first")  # the rows after a grid point, up to the next
    rows = stored(stretched(grid.join(cells.drop("first"), [*by, "k"], "left").join(after, [*by, "k"], "left"), by, "k"))
    marks = carried(rows, by, ["k"], "last", "l")
    if not linear:
        return marks.select(*by, F.col("t").alias("bucket"), F.col("l.v").alias("value"))
    marks = carried(stored(marks), by, ["k"], "first", "r", ahead=True)
    between = F.col("l.v") + (F.col("r.v") - F.col("l.v")) * F.coalesce(F.try_divide(F.col("t") - F.col("l.t"), F.col("r.t") - F.col("l.t")), F.lit(0.0))
    return marks.select(*by, F.col("t").alias("bucket"), F.coalesce(between, F.col("l.v")).alias("value"))


def report(parts: Sequence[DataFrame], result: DataFrame) -> DataFrame:
    """rows_in, rows_out, duplicates (rows that the merge dropped) and n_columns of a merge, as one row."""
    before = reduce(lambda a, b: a.union(b), [p.agg(F.count(F.lit(1)).alias("n")) for p in parts]).agg(F.sum("n").alias("rows_in"))
    after = result.agg(F.count(F.lit(1)).alias("rows_out"))
    return before.crossJoin(after).select("rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("duplicates"), F.lit(len(result.columns)).alias("n_columns"))  # two rows of one number


def spline(grid: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Missing grid values by a natural cubic through each series' observed ones. A series is cut into pieces of STRETCH knots, which are fitted
    with the AROUND knots on either side; a tridiagonal system is solved by one sweep forward and one back."""
    import numpy as np
    import pandas as pd

    from tidemark.operators.sampling import numbered_within

    columns = grid.columns
    rows = stretched(grid.withColumn("__t", epoch(F.col("bucket")) if dict(grid.dtypes)["bucket"].startswith("timestamp") else F.col("bucket").cast("double")), by, "__t")
    knots = stored(numbered_within(grid.where("observed").select(*by, "bucket"), list(by), ["bucket"], "__k"))
    placed = stored(carried(rows.join(knots, [*by, "bucket"], "left"), by, ["__t"], "__k", "__last"))
    of = knots.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    placed = placed.join(of, list(by), "left").withColumn("__piece", F.floor(F.greatest(F.coalesce("__last", F.lit(1)) - 1, F.lit(0)) / STRETCH))
    last = F.greatest(F.floor((F.coalesce("__n", F.lit(1)) - 1) / STRETCH), F.lit(0))
    low, high = F.greatest(F.floor((F.col("__k") - 1 - AROUND) / STRETCH), F.lit(0)), F.least(F.floor((F.col("__k") - 1 + AROUND) / STRETCH), last)
    around = F.when(F.col("__k").isNull(), F.array("__piece")).otherwise(F.sequence(low.cast("bigint"), high.cast("bigint")))
    dealt = placed.withColumn("__own", F.col("__piece")).withColumn("__piece", F.explode(around))
    dealt = dealt.select(*columns, "__piece", (F.col("__own") == F.col("__piece")).alias("__core"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket")
        return fitted(part)[part["__core"].to_numpy(bool)][columns]

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        seen = part[part["observed"]]
        x, y = seen["bucket"].to_numpy(float), seen["value"].to_numpy(float)
        if len(x) < 3:
            return part.assign(value=np.interp(part["bucket"], x, y) if len(x) else np.nan)
        h = np.diff(x)
        slope = np.diff(y) / h
        up, side = np.zeros(len(x)), np.zeros(len(x))  # the ends' curvature is 0
        for i in range(1, len(x) - 1):
            pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * up[i - 1]
            up[i], side[i] = h[i] / pivot, (3 * (slope[i] - slope[i - 1]) - h[i - 1] * side[i - 1]) / pivot
        c = side
        for i in range(len(x) - 2, 0, -1):
            c[i] -= up[i] * c[i + 1]
        at = np.clip(np.searchsorted(x, part["bucket"], "right") - 1, 0, len(h) - 1)
        d = part["bucket"].to_numpy(float) - x[at]
        b = (y[at + 1] - y[at]) / h[at] - h[at] * (2 * c[at] + c[at + 1]) / 3
        return part.assign(value=y[at] + b * d + c[at] * d**2 + (c[at + 1] - c[at]) / (3 * h[at]) * d**3)

    return dealt.groupBy(*by, "__piece").applyInPandas(fit, grid.schema)


def gap_filled(grid: DataFrame, how: str, by: Sequence[str] = ("series",), longest_gap: int | None = None) -> DataFrame:
    return spline(grid, by) if how == "spline" else filled(grid, how, by, longest_gap)


def business_time(df: DataFrame, ts: str = "ts", weekends: bool = False, holidays: Sequence[str] = (), hours: tuple[str, str] | None = None) -> DataFrame:
    """Rows on working days (Monday to Friday unless weekends count, no holiday) and, if given, within hours, both ends included."""
    t = F.col(ts).cast("timestamp")
    keep = F.lit(True)
    if not weekends:
        keep &= F.weekday(t) < 5
    if holidays:
        keep &= ~F.date_format(t, "yyyy-MM-dd").isin(*holidays)
    if hours and hours[0] != hours[1]:
        keep &= F.date_format(t, "HH:mm").between(*hours)
    return df.where(keep)


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without a match."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key (the DISTINCT ON of other engines)."""
    return deduplicated(df, keys, list(order), "keep_last")


def upserted(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """table with changed rows replaced and new ones added; a version column goes up by one where a row is replaced."""
    both = table.join(changes.select(*keys, F.lit(True).alias("__hit"), *([F.col(version).alias("__v")] if version in changes.columns else [])), list(keys), "left_anti").unionByName(
        changes if version is None else changes.drop(version).join(table.select(*keys, (F.col(version) + 1).alias(version)), list(keys), "left").withColumn(version, F.coalesce(version, F.lit(1))), allowMissingColumns=True
    )
    return both.select(table.columns)
