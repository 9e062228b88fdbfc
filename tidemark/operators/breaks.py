"""Evidence of thresholds and of memory in pairs(pair, idx, x, y): where the line breaks along x, and whether y takes another way back.

Running sums are taken in stretches (referees.running), neighbours in the order met by a join on places, so no task holds a whole pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import referees
from tidemark.operators.sampling import numbered_within
from tidemark.session import stored


def _placed(pairs: DataFrame, order: list[str], least: int) -> DataFrame:
    """Rows with both values, of pairs with enough of them, with their place from 1 in the order as idx, stored."""
    rows = referees.checked(pairs, least).select("pair", "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return stored(numbered_within(rows, ["pair"], order, "__at").select("pair", F.col("__at").alias("idx"), "x", "y"))


def _slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    spread = n * sxx - sx * sx
    return F.coalesce(F.try_divide(n * sxy - sx * sy, F.when(spread > 1e-12 * n * F.abs(sxx), spread)), F.lit(0.0))


def breakpoints(pairs: DataFrame, trim: float = 0.15, least: int = 30, limit: float = 6.91) -> DataFrame:
    """pair, n, breakpoint (the largest x to its left), statistic (F of two lines over one), left and right (their slopes), found: the F is
    beyond the limit. Rows are ordered by x; all cuts between different x in the middle part are compared, and of equal ones the first."""
    placed = _placed(pairs, ["x", "idx"], least)
    rows = referees.checked(placed, least)
    run = referees.running(rows, referees.moments())
    totals = rows.groupBy("pair").agg(*[F.sum(c).alias(f"t{k}") for k, c in referees.moments().items()])
    following = placed.select("pair", (F.col("idx") - 1).alias("idx"), F.col("x").alias("next_x"))
    at = run.join(placed.select("pair", "idx", "x"), ["pair", "idx"]).join(following, ["pair", "idx"]).where("next_x > x").join(totals, "pair")
    k, n = F.col("n"), F.col("tn")
    left = [F.col(m) for m in referees.moments()]
    right = [F.col(f"t{m}") - F.col(m) for m in referees.moments()]
    inside = at.where((k >= F.greatest(F.floor(n * trim), F.lit(3))) & (k <= F.least(F.floor(n * (1 - trim)), n - 3)))
    apart = referees._sse(*left) + referees._sse(*right)
    f = F.try_divide((referees._sse(*[F.col(f"t{m}") for m in referees.moments()]) - apart) / 2, F.greatest(apart, F.lit(1e-300)) / (n - 4))
    slopes = [_slope(*[s[i] for i in (0, 1, 2, 3, 5)]) for s in (left, right)]
    told = inside.select("pair", n.cast("long").alias("n"), "x", k.alias("k"), f.alias("f"), slopes[0].alias("left"), slopes[1].alias("right"))
    best = told.groupBy("pair", "n").agg(F.max(F.struct("f", (-F.col("k")).alias("k"), "x", "left", "right")).alias("b"))
    return best.select("pair", "n", F.col("b.x").alias("breakpoint"), F.col("b.f").alias("statistic"), F.col("b.left").alias("left"), F.col("b.right").alias("right"), (F.col("b.f") > limit).alias("found"))


def hysteresis(pairs: DataFrame, bins: int = 10, least: int = 30, limit: float = 0.2) -> DataFrame:
    """pair, n, rising and falling (steps of x up and down), loop (the area that the path of (x, y) encloses, closed from its end to its start,
    in parts of the box around all points; positive if it runs against the clock), gap (the mean over equal parts of x with steps of
    both kinds, of y after a step up less y after a step down, in deviations of y) and found: the gap is beyond the limit."""
    placed = _placed(pairs, ["idx"], least)
    of = placed.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"), F.stddev_pop("y").alias("dy"),
        F.min_by("x", "idx").alias("x0"), F.min_by("y", "idx").alias("y0"), F.max_by("x", "idx").alias("x1"), F.max_by("y", "idx").alias("y1"),
    )
    before = placed.select("pair", (F.col("idx") + 1).alias("idx"), F.col("x").alias("px"), F.col("y").alias("py"))
    steps = stored(placed.join(before, ["pair", "idx"]).join(of.select("pair", "lx", "hx"), "pair"))
    up, down = F.col("x") > F.col("px"), F.col("x") < F.col("px")
    sums = steps.groupBy("pair").agg(F.count_if(up).alias("rising"), F.count_if(down).alias("falling"), F.sum(F.col("px") * F.col("y") - F.col("x") * F.col("py")).alias("twice"))
    part = F.least(F.floor((F.col("x") - F.col("lx")) / F.when(F.col("hx") > F.col("lx"), F.col("hx") - F.col("lx")).otherwise(1.0) * bins), F.lit(bins - 1))
    each = steps.groupBy("pair", part.alias("part")).agg((F.avg(F.when(up, F.col("y"))) - F.avg(F.when(down, F.col("y")))).alias("gap"))
    gaps = each.groupBy("pair").agg(F.avg("gap").alias("gap"))
    out = of.join(sums, "pair").join(gaps, "pair")
    box = (F.col("hx") - F.col("lx")) * (F.col("hy") - F.col("ly"))
    area = (F.col("twice") + F.col("x1") * F.col("y0") - F.col("x0") * F.col("y1")) / 2
    gap = F.coalesce(F.try_divide("gap", F.when(F.col("dy") > 0, F.col("dy"))), F.lit(0.0))
    return out.select("pair", "n", "rising", "falling", F.coalesce(F.try_divide(area, F.when(box > 0, box)), F.lit(0.0)).alias("loop"), gap.alias("gap"), (F.abs(gap) > limit).alias("found"))
