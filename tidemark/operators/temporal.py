"""Event series on even grids, lags, trends and stability. Series are keyed, so all of them go through one plan at once.

Grids use fixed durations in whole seconds from a truncated start. A grid is one row per series and bucket (sequence and
explode), windows run per series; nothing compares all points with all points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import GRAINS, epoch, truncated
from tidemark.functions import special
from tidemark.operators.pairs import correlation

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}
FILLS = ("zero", "forward", "mean", "nan", "backward", "linear", "none")


def bucketed(events: DataFrame, grain: str, how: str = "sum", ts: str = "ts", value: str = "value", by: Sequence[str] = ("series",), common_start: bool = True) -> DataFrame:
    """by, bucket (seconds since 1970) and value of the buckets with events. Buckets step from the truncated first time of all
    series, or of each series on its own."""
    step = GRAINS[grain]
    whole = [F.lit(1).alias("all")] if common_start else [F.col(c) for c in by]
    starts = events.groupBy(*whole).agg(F.unix_seconds(truncated(F.min(F.col(ts)).cast("timestamp"), grain)).alias("start"))
    joined = events.crossJoin(F.broadcast(starts.select("start"))) if common_start else events.join(starts, list(by))  # a row in all, or one per series
    bucket = F.col("start") + F.floor((epoch(F.col(ts)) - F.col("start")) / step) * step
    return joined.groupBy(*by, bucket.alias("bucket")).agg(AGGREGATES[how](value).cast("double").alias("value"))


def gridded(points: DataFrame, grain: str, by: Sequence[str] = ("series",), span: str = "all") -> DataFrame:
    """points on a grid from the first to the last bucket of all series (or each `own`): by, bucket, value (null where nothing was), observed."""
    step = GRAINS[grain]
    ends = points.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")) if span == "all" else None
    keys = points.select(*by).distinct().crossJoin(F.broadcast(ends)) if ends is not None else points.groupBy(*by).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    grid = keys.select(*by, F.explode(F.sequence("low", "high", F.lit(step).cast("bigint"))).alias("bucket"))
    return grid.join(points, [*by, "bucket"], "left").withColumn("observed", F.col("value").isNotNull())


def filled(grid: DataFrame, how: str, by: Sequence[str] = ("series",), longest_gap: int | None = None) -> DataFrame:
    """grid with missing values filled: zero; forward (0 before the first); backward (0 after the last); linear between
    neighbours; mean of the values so far (0 before the first); nan; none. Gaps of more than longest_gap buckets stay null."""
    if how not in FILLS:
        raise ValueError(f"unknown fill {how!r}")
    w = Window.partitionBy(*by).orderBy("bucket")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    v, at = F.col("value"), F.col("bucket")
    left, right = F.last("value", True).over(back), F.first("value", True).over(ahead)
    t0, t1 = F.last(F.when(F.col("observed"), at), True).over(back), F.first(F.when(F.col("observed"), at), True).over(ahead)
    new = {
        "zero": F.lit(0.0), "forward": F.coalesce(left, F.lit(0.0)), "backward": F.coalesce(right, F.lit(0.0)), "mean": F.coalesce(F.avg("value").over(back), F.lit(0.0)),
        "nan": F.lit(float("nan")), "linear": left + (right - left) * (at - t0) / (t1 - t0), "none": F.lit(None).cast("double"),
    }[how]
    if longest_gap is None:
        return grid.withColumn("value", F.coalesce(v, new))
    runs = grid.withColumn("__run", F.sum(F.col("observed").cast("int")).over(w))
    size = F.count_if(~F.col("observed")).over(Window.partitionBy(*by, "__run"))
    return runs.withColumn("value", F.when(F.col("observed"), v).when(size <= longest_gap, new)).drop("__run")


def gap_ratio(grid: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Points and the share without an observation, per series."""
    return grid.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.avg((~F.col("observed")).cast("double")).alias("gap_ratio"))


def aligned(events: DataFrame, source: str, target: str, grain: str, fill: str = "zero", how: str = "sum", least: int = 10, most_gaps: float = 0.5) -> DataFrame:
    """idx, bucket, x, y of two series on their common grid; an error if it is too short or too empty. events(series, ts, value)."""
    grid = gridded(bucketed(events.where(F.col("series").isin(source, target)), grain, how), grain)
    of = {r["series"]: r for r in gap_ratio(grid).collect()}  # two rows
    if len(of) < 2 or min(r["points"] for r in of.values()) < least:
        raise ValueError("too few points")
    if max(r["gap_ratio"] for r in of.values()) > most_gaps:
        raise ValueError("too many gaps")
    side = lambda s: F.max(F.when(F.col("series") == s, F.col("value")))
    wide = filled(grid, fill).groupBy("bucket").agg(side(source).alias("x"), side(target).alias("y"))
    return wide.withColumn("idx", F.row_number().over(Window.orderBy("bucket")))  # one row per bucket


def lagged(pairs: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """lag, n, r: the correlation of x at t with y at t + lag, for lags from -most to most. pairs(by, idx, x, y), idx gapless.

    x rows are repeated once a lag and joined with y on idx + lag: rows grow with the number of lags alone.
    """
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    x = pairs.select(*by, F.col("idx").alias("i"), "x", lags).withColumn("idx", F.col("i") + F.col("lag"))
    both = x.join(pairs.select(*by, "idx", "y"), [*by, "idx"])
    a, b = F.col("x"), F.col("y")
    s = both.groupBy(*by, "lag").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    return s.select(*by, "lag", "n", correlation(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("r"))


def lag_limit(n: int, most: int | None = None) -> int:
    """A quarter of the points, 20 at most, under half."""
    return max(0, min(20 if most is None else most, n // 4 if most is None else most, (n - 1) // 2))


def direction(r: Column, lag: Column) -> Column:
    return (
        F.when(F.abs(r) < 0.3, "no_relationship").when(lag == 0, "simultaneous").when((lag >= 1) & (lag <= 3), "source_leads_short")
        .when(lag > 3, "source_leads_long").otherwise("target_leads")
    )


def causal_lead(pairs: DataFrame, most: int, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """The lag of the largest |r| (ties: the smallest |lag|, then the negative one), its p by Fisher's z, and a direction."""
    order = Window.partitionBy(*(list(by) or [F.lit(1)])).orderBy(F.desc(F.round(F.abs("r"), 12)), F.abs("lag"), "lag")
    best = lagged(pairs, most, by).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r")))) * F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)))
    out = best.withColumns({"z": z, "direction": direction(F.col("r"), F.col("lag"))})
    return out.withColumn("p", F.greatest(special.p_normal("z"), F.lit(1e-10))) if p_value else out


def gaps(events: DataFrame, ts: str = "ts", by: Sequence[str] = ("series",), tie: Sequence[str] = ()) -> DataFrame:
    """k (from 0) and the gap in days between an event and the one before."""
    w = Window.partitionBy(*by).orderBy(ts, *tie)
    return events.select(*by, (F.row_number().over(w) - 2).alias("k"), ((epoch(F.col(ts)) - F.lag(epoch(F.col(ts))).over(w)) / 86400).alias("gap")).where("gap IS NOT NULL")


def inactivity(events: DataFrame, ts: str = "ts", by: Sequence[str] = ("series",), tie: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Slope of the gaps between events over their order, its standard error from the residuals, z and trend."""
    g, k = F.col("gap"), F.col("k").cast("double")
    s = gaps(events, ts, by, tie).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(g).alias("mean_gap"), F.regr_slope(g, k).alias("slope"), F.regr_sxx(g, k).alias("sxx"), F.regr_syy(g, k).alias("syy"), F.regr_sxy(g, k).alias("sxy")).where("n >= 2")
    residual = F.greatest(F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)), F.lit(0.0))
    error = F.sqrt(F.try_divide(residual / F.col("n"), F.col("sxx")))
    out = s.select(*by, "n", "mean_gap", F.coalesce("slope", F.lit(0.0)).alias("slope"), error.alias("error"))
    out = out.withColumn("z", F.when(F.col("error") > 1e-12, F.col("slope") / F.col("error")).otherwise(F.when(F.abs("slope") > 1e-9, F.signum("slope") * 1e6).otherwise(0.0)))
    trend = F.when(F.abs("z") < 1.6448536269514722, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")  # p > 0.1
    out = out.withColumn("trend", trend)
    return out.withColumn("p", special.p_normal("z")) if p_value else out


def autocorrelation(points: DataFrame, most: int, by: Sequence[str] = ("series",)) -> DataFrame:
    """lag, n and r about the series' mean; r is the mean lagged product over the mean square. points(by, idx, value)."""
    mean = points.groupBy(*by).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("size"))
    x = points.join(mean, list(by)).withColumn("d", F.col("value") - F.col("m"))
    lags = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")
    ahead = x.select(*by, (F.col("idx")).alias("i"), F.col("d").alias("a"), "v", "size", lags).withColumn("idx", F.col("i") + F.col("lag"))
    both = ahead.join(x.select(*by, "idx", F.col("d").alias("b")), [*by, "idx"])
    return both.groupBy(*by, "lag").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.avg(F.col("a") * F.col("b")), F.first("v")), F.lit(0.0)).alias("r"))


def suggested_lags(points: DataFrame, by: Sequence[str] = ("series",), most: int = 10, keep: int = 3) -> DataFrame:
    """The lags above Bartlett's bound 1.96 sqrt((1 + 2 sum of earlier r^2) / n), the `keep` largest |r|, in order of lag."""
    acf = autocorrelation(points, most, by).where(F.col("lag") <= F.least(F.lit(most), F.floor(F.col("size") / 3)))
    w = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    bound = 1.96 * F.sqrt((1 + 2 * F.coalesce(F.sum(F.col("r") * F.col("r")).over(w), F.lit(0.0))) / F.col("size"))
    high = acf.withColumn("bound", bound).where(F.abs("r") > F.col("bound"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs("r")), "lag")
    return high.withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep).drop("k", "size")


def rolling_stability(points: DataFrame, by: Sequence[str] = ("series",), most: int = 30) -> DataFrame:
    """1 / (1 + cv) of the population variances in full windows of min(most, n / 3) points (n if that is under 5)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    sized = points.withColumn("n", n).withColumn("w", F.when(F.least(F.lit(most), F.floor(F.col("n") / 3)) < 5, F.col("n")).otherwise(F.least(F.lit(most), F.floor(F.col("n") / 3))))
    order = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumns({"k": F.row_number().over(Window.partitionBy(*by).orderBy("idx")), "s": F.sum("value").over(order), "q": F.sum(F.col("value") * F.col("value")).over(order)})
    before = run.select(*by, (F.col("k") + F.col("w")).alias("k"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    ends = run.where("k >= w").join(before, [*by, "k"], "left").na.fill(0.0, ["s0", "q0"])
    mean = (F.col("s") - F.col("s0")) / F.col("w")
    var = F.greatest((F.col("q") - F.col("q0")) / F.col("w") - mean * mean, F.lit(0.0))
    out = ends.select(*by, var.alias("v")).groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return out.select(*by, "windows", (1 / (1 + F.coalesce(F.try_divide("s", "m"), F.lit(0.0)))).alias("stability"))


def variance_halves(points: DataFrame, by: Sequence[str] = ("series",), p_value: bool = True) -> DataFrame:
    """The ratio of the larger to the smaller sample variance of the first and second half of a series."""
    rows = points.withColumns({"k": F.row_number().over(Window.partitionBy(*by).orderBy("idx")), "size": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    first = F.col("k") <= F.floor(F.col("size") / 2)
    s = rows.groupBy(*by).agg(F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"), F.var_samp(F.when(first, F.col("value"))).alias("v1"), F.var_samp(F.when(~first, F.col("value"))).alias("v2"))
    up = F.col("v1") >= F.col("v2")
    out = s.select(*by, "n1", "n2", F.try_divide(F.greatest("v1", "v2"), F.least("v1", "v2")).alias("f"), F.when(up, F.col("n1") - 1).otherwise(F.col("n2") - 1).alias("d1"), F.when(up, F.col("n2") - 1).otherwise(F.col("n1") - 1).alias("d2"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * special.p_f("f", F.col("d1").cast("double"), F.col("d2").cast("double")))) if p_value else out


def trend(points: DataFrame, ts: str = "ts", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """n, correlation and slope per day of a value over time."""
    t, v = epoch(F.col(ts)) / 86400, F.col(value).cast("double")
    s = points.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(v).alias("n"), F.regr_sxx(v, t).alias("sxx"), F.regr_syy(v, t).alias("syy"), F.regr_sxy(v, t).alias("sxy"))
    return s.select(*by, "n", F.coalesce(F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))), F.lit(0.0)).alias("r"), F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)).alias("slope"))
