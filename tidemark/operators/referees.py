"""Falsification tests of pairs. Input: pairs(pair, idx, x, y), idx an order without repeats within each pair.

Tests with a closed form are aggregations and running sums over all pairs at once; running sums are taken in stretches of the order
and started from the sums before them, so no task holds a whole pair. Tests of whole vectors (neighbours, transforms, shuffles) are in
vectors.py. Where a test asks for certainty, p is the share of a block bootstrap's rounds (resampling.py) that lie on the wrong side
of the limit, and `passed` needs the statistic beyond the limit and p below its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import resampling, vectors
from tidemark.operators.pairs import correlation
from tidemark.session import stored

# Names under which each test is asked for, with its category.
REGISTRY = {
    "permutation": ("SHREDDER", ("permutation_shuffling", "permutation_shredder", "shredder", "statistical_integrity")),
    "transfer_entropy": ("DIRECTIONAL", ("transfer_entropy", "directional_causality")),
    "cross_mapping": ("DIRECTIONAL", ("convergent_cross_mapping", "ccm")),
    "chow": ("INVARIANCE", ("chow_stability_test", "invariance", "structural_stability")),
    "cusum": ("INVARIANCE", ("cusum_drift_detection",)),
    "conditional_mi": ("ANTI_CONFOUNDER", ("conditional_mutual_information", "conditional_mi", "cmi")),
    "partial": ("ANTI_CONFOUNDER", ("partial_correlation",)),
    "monotonic": ("MECHANISM", ("monotonicity_stress_test", "isotonic_mechanism", "isotonic_mechanism_check")),
    "functional_form": ("MECHANISM", ("functional_form_test",)),
    "leave_one_out": ("SENSITIVITY", ("leave_one_out_cv", "loo_cross_validation")),
    "alpha_decay": ("SENSITIVITY", ("alpha_decay_test",)),
    "homology": ("TOPOLOGICAL", ("persistent_homology", "topological_analysis")),
    "lempel_ziv": ("THERMODYNAMIC", ("lempel_ziv_complexity",)),
    "complexity": ("THERMODYNAMIC", ("algorithmic_complexity", "compression_complexity")),
    "intervention": ("COUNTERFACTUAL", ("synthetic_intervention", "g_computation")),
    "wavelet_coherence": ("SPECTRAL", ("wavelet_coherence",)),
    "spectral_analysis": ("SPECTRAL", ("spectral_analysis",)),
}


def resolve(name: str) -> tuple[str, str]:
    """A test and its category from any of its names."""
    wanted = name.strip().lower()
    for test, (category, names) in REGISTRY.items():
        if wanted == test or wanted in names:
            return test, category
    raise ValueError(f"unknown referee {name!r}")


def compatible(names: list[str]) -> bool:
    """Three different tests of three categories."""
    found = [resolve(n) for n in names]
    return len(found) == 3 and len({t for t, _ in found}) == 3 and len({c for _, c in found}) == 3


#: Rows of a stretch, about.
STRETCH = 4096


def checked(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Rows with x and y finite of pairs with enough of them; size: their number, stretch: the part of the order they lie in."""
    ok = pairs.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    of = ok.groupBy("pair").agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("__from"), F.max("idx").alias("__to")).where(F.col("size") >= least)
    stretch = F.floor((F.col("idx") - F.col("__from")) * F.ceil(F.col("size") / STRETCH) / (F.col("__to") - F.col("__from") + 1))
    return ok.join(of, "pair").withColumn("stretch", stretch).drop("__from", "__to")


def running(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """pair, idx, size and the sums of values up to each row of checked() rows."""
    at = rows.select("pair", "idx", "size", "stretch", *[c.alias(k) for k, c in values.items()])
    parts = at.groupBy("pair", "stretch").agg(*[F.sum(k).alias(f"__{k}") for k in values])
    order = Window.partitionBy("pair").orderBy("stretch")  # a row per stretch
    starts = parts.select("pair", "stretch", *[(F.sum(f"__{k}").over(order) - F.col(f"__{k}")).alias(f"__{k}") for k in values])
    inside = Window.partitionBy("pair", "stretch").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = at.select("pair", "idx", "size", "stretch", *[F.sum(k).over(inside).alias(k) for k in values])
    return sums.join(starts, ["pair", "stretch"]).select("pair", "idx", "size", *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in values])


def row_at(rows: DataFrame, place: Column) -> DataFrame:
    """The row of each pair of checked() rows at a place (from 1) of its order. Only the stretch that it lies in is put in order."""
    counts = rows.groupBy("pair", "size", "stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("pair").orderBy("stretch")) - F.col("__n")  # a row per stretch
    own = counts.withColumn("__k", place - before).where("__k > 0 AND __k <= __n").select("pair", "stretch", "__k")
    number = F.row_number().over(Window.partitionBy("pair", "stretch").orderBy("idx"))
    return rows.join(own, ["pair", "stretch"]).withColumn("__at", number).where("__at = __k").drop("__at", "__k")


def ranked(rows: DataFrame, keys: list[str], column: str, name: str, ranges: int = 64) -> DataFrame:
    """rows with `before`, the rows of the same keys with a lesser value, and `name`, the average rank of the value among them.
    Values are counted, dealt into ranges by approximate quantiles and numbered there; a range starts at the sum of those before."""
    counts = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__k"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000).alias("__cuts"))
    dealt = counts.join(cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(column)))).drop("__cuts")
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("__k").alias("__n"))
    starts = sizes.select(*keys, "__part", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")).alias("__start"))
    before = F.col("__start") + F.sum("__k").over(Window.partitionBy(*keys, "__part").orderBy(column)) - F.col("__k")
    placed = dealt.join(starts, [*keys, "__part"]).select(*keys, column, before.alias("before"), "__k")
    return rows.join(placed, [*keys, column]).withColumn(name, F.col("before") + (F.col("__k") + 1) / 2.0).drop("__k")


def moments() -> dict[str, Column]:
    """What is summed for a line."""
    x, y = F.col("x"), F.col("y")
    return {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}


def _sse(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Residual sum of squares of the line through points with these sums."""
    cx, cy, cxy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    return F.greatest(cy - F.coalesce(F.try_divide(cxy * cxy, F.when(cx > 1e-12 * F.abs(sxx), cx)), F.lit(0.0)), F.lit(0.0))


def _with_totals(rows: DataFrame, source: DataFrame) -> DataFrame:
    """rows with the pair's sums of moments() over source, named t..."""
    return rows.join(source.groupBy("pair").agg(*[F.sum(c).alias(f"t{k}") for k, c in moments().items()]), "pair")


def chow(pairs: DataFrame, trim: float = 0.15, limit: float = 6.91) -> DataFrame:
    """The largest F of a break in the line over all splits of the middle 70 %; stable if under the limit."""
    rows = checked(pairs)
    run = _with_totals(running(rows, moments()), rows)
    left = _sse(*[F.col(k) for k in moments()])
    right = _sse(*[F.col(f"t{k}") - F.col(k) for k in moments()])
    total = _sse(*[F.col(f"t{k}") for k in moments()])
    k, n = F.col("n"), F.col("tn")
    inside = run.where((k >= F.greatest(F.floor(n * trim), F.lit(3))) & (k <= F.least(F.floor(n * (1 - trim)), n - 3)))
    f = F.try_divide((total - left - right) / 2, (left + right) / (n - 4))
    return inside.select("pair", F.coalesce(f, F.lit(0.0)).alias("f")).groupBy("pair").agg(F.max("f").alias("statistic")).withColumn("passed", F.col("statistic") < limit)


def _with_p(out: DataFrame, p: DataFrame, passed: Column, most: float) -> DataFrame:
    """out with p, and passed where the statistic is beyond its limit and p below `most`."""
    return out.join(p, "pair").withColumn("passed", passed & (F.col("p") < most))


def _slope_stability(limit: float) -> resampling.Finish:
    """p of leave_one_out(): without a row, the slope moves by (x - mean) times its residual over the squares of x (its leverage aside),
    so the spread of the slopes follows from sums of powers."""

    def finish(table, draws):
        s = resampling.weighted(table, draws).T
        n, x, xx, xxx, xxxx, y, xy, xxy, xxxy, yy, xyy, xxyy = s
        m = x / n
        sxx = xx - x * m
        b = np.where(sxx > 0, (xy - m * y) / np.where(sxx > 0, sxx, 1), 0)
        a = y / n - b * m
        moved = lambda k0, k1, k2: k2 - 2 * m * k1 + m * m * k0  # noqa: E731  sums of (x - m)^2 times a power
        e2 = moved(yy, xyy, xxyy) + a * a * moved(n, x, xx) + b * b * moved(xx, xxx, xxxx) - 2 * a * moved(y, xy, xxy) - 2 * b * moved(xy, xxy, xxxy) + 2 * a * b * moved(x, xx, xxx)
        spread = np.sqrt(np.maximum(e2, 0) / n) / np.where(sxx > 0, sxx, np.inf)
        return (resampling.share(~(1 / (1 + spread / np.abs(b)) > limit)),)

    return finish


def leave_one_out(pairs: DataFrame, limit: float = 0.8, most: float = 0.05) -> DataFrame:
    """Slope of all rows, mean squared error of the left-out rows, spread of the slopes, and stability 1 / (1 + cv of slopes).
    Each row's fit is all sums less its own."""
    rows = checked(pairs)
    t = _with_totals(rows.select("pair", "x", "y"), rows)
    n, sx, sy, sxx, sxy = (F.col(f"t{k}") - c for k, c in moments().items() if k != "syy")
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, F.when(n * sxx - sx * sx > 1e-12 * n * sxx, n * sxx - sx * sx)), F.lit(0.0))
    fits = t.withColumn("slope", slope).withColumn("error", F.pow(F.col("y") - (sy / n + F.col("slope") * (F.col("x") - sx / n)), 2))
    full = F.first(F.coalesce(F.try_divide(F.col("tn") * F.col("tsxy") - F.col("tsx") * F.col("tsy"), F.col("tn") * F.col("tsxx") - F.col("tsx") * F.col("tsx")), F.lit(0.0)))
    out = fits.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), full.alias("slope"), F.avg("error").alias("mse"), F.stddev_pop("slope").alias("slope_spread"), F.avg("slope").alias("mean_slope"))
    out = out.select("pair", "n", "slope", "mse", "slope_spread", (1 / (1 + F.coalesce(F.abs(F.try_divide("slope_spread", "mean_slope")), F.lit(0.0)))).alias("statistic"))
    centred = rows.join(rows.groupBy("pair").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), "pair").withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")})
    x, y = F.col("x"), F.col("y")
    powers = {f"s{j}{i}": F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) for j, top in ((0, 4), (1, 3), (2, 2)) for i in range(top + 1)}
    sums = resampling.block_sums(resampling.in_blocks(centred, ordered=False), powers)
    return _with_p(out, resampling.drawn(sums, list(powers), _slope_stability(limit), "p double"), F.col("statistic") > limit, most)


def _false_alarms(limit: float) -> resampling.Finish:
    """p of cusum(): the drawn stretches follow each other, so the least running sum is that of the stretches' own, each from where the
    stretches before it end."""

    def finish(table, draws):
        up, down, least, most = (table[draws, i] for i in range(4))
        before_up, before_down = np.cumsum(up, 1) - up, np.cumsum(down, 1) - down
        upper = up.sum(1) - np.minimum(0, (before_up + least).min(1))
        lower = down.sum(1) - np.maximum(0, (before_down + most).max(1))
        return (resampling.share(np.maximum(upper, -lower) > limit),)

    return finish


def cusum(pairs: DataFrame, limit: float = 5.0, slack: float = 0.5, most: float = 0.001) -> DataFrame:
    """The last upper and lower CUSUM of residuals of the line through the first third, in their deviations.

    The recursion max(0, c + z - slack) is the running sum less its least value so far; at the end that is the least of all. p is the
    share of false alarms: resampled series that end beyond the limit. Independent normal residuals do so in about .004 of all cases, so the
    limit of .001 passes only what is calmer.
    """
    rows = checked(pairs)
    third = row_at(rows, F.floor(F.col("size") / 3)).select("pair", F.col("idx").alias("__third"))
    fit = rows.join(third, "pair").where(F.col("idx") <= F.col("__third")).groupBy("pair").agg(*[F.sum(c).alias(f"b{k}") for k, c in moments().items()])
    n, sx, sy, sxx, syy, sxy = (F.col(f"b{k}") for k in moments())
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, F.when(n * sxx - sx * sx > 0, n * sxx - sx * sx)), F.lit(0.0))
    spread = F.sqrt(_sse(n, sx, sy, sxx, syy, sxy) / F.greatest(n - 2, F.lit(1.0)))
    z = rows.join(fit, "pair").withColumn("z", F.coalesce(F.try_divide(F.col("y") - (sy / n + slope * (F.col("x") - sx / n)), F.when(spread > 1e-12, spread)), F.lit(0.0)))
    z = resampling.in_blocks(z.select("pair", "idx", "size", "z"), ordered=True)
    inside = Window.partitionBy("pair", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = z.select("pair", "block", "size", F.sum(F.col("z") - slack).over(inside).alias("up"), F.sum(F.col("z") + slack).over(inside).alias("down"), F.row_number().over(Window.partitionBy("pair", "block").orderBy("idx")).alias("k"))
    parts = stored(sums.groupBy("pair", "size", "block").agg(F.max_by("up", "k").alias("up"), F.max_by("down", "k").alias("down"), F.min("up").alias("least"), F.max("down").alias("most")))
    order = Window.partitionBy("pair").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    before = {c: F.coalesce(F.sum(c).over(order), F.lit(0.0)) for c in ("up", "down")}
    at = parts.select("pair", "size", "up", "down", (F.col("least") + before["up"]).alias("least"), (F.col("most") + before["down"]).alias("most"))
    ends = at.groupBy("pair").agg(F.first("size").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"), F.min("least").alias("least"), F.max("most").alias("most"))
    upper, lower = F.col("up") - F.least(F.lit(0.0), "least"), F.col("down") - F.greatest(F.lit(0.0), "most")
    out = ends.select("pair", "n", upper.alias("upper"), lower.alias("lower"), F.greatest(upper, -lower).alias("statistic"))
    return _with_p(out, resampling.drawn(parts, ["up", "down", "least", "most"], _false_alarms(limit), "p double"), F.col("statistic") <= limit, most)


def partial(rows: DataFrame, controls: tuple[str, ...] = ("z",), limit: float = 0.3) -> DataFrame:
    """The correlation of x and y with all controls held, and its 95 % interval; passes if the interval lies within the limit on both sides
    (nothing strong is left that the controls don't tell). rows(pair, idx, x, y, controls...); rows with a null are left out. One Gram
    matrix per block of rows, summed; the controls are swept out of the whole and of each round's. Without controls the correlation itself
    must be within the limit."""
    columns = ("x", "y", *controls)
    ok = rows.select("pair", "idx", *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=list(columns))
    of = ok.groupBy("pair").agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"__{c}") for c in columns])
    centred = ok.join(of, "pair").select("pair", "idx", "size", *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in columns])
    values = {"n": F.lit(1.0)} | {c: F.col(c) for c in columns} | {f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]}
    values = {f"s{i}": v for i, v in enumerate(values.values())}

    def finish(table, draws):
        whole = table.sum(0)[None]
        statistic = float(resampling.partial_of(whole, len(columns))[0])
        r = float(resampling.partial_of(whole[:, _without_controls(len(columns))], 2)[0])
        low, high = np.percentile(resampling.partial_of(resampling.weighted(table, draws), len(columns)), (2.5, 97.5))
        inside = low > -limit and high < limit if controls else abs(statistic) < limit
        return int(whole[0, 0]), r, statistic, float(low), float(high), max(abs(low), abs(high)), bool(inside)

    sums = resampling.block_sums(resampling.in_blocks(centred, ordered=False), values)
    return resampling.drawn(sums, list(values), finish, "n bigint, r double, statistic double, low double, high double, p double, passed boolean")


def _without_controls(columns: int) -> list[int]:
    """The places of n and of the sums and products of the first two columns among the sums that partial() takes."""
    first = 1 + columns
    return [0, 1, 2, first, first + 1, first + columns]


def _rank_correlations(least: int, limit: float) -> resampling.Finish:
    """p of monotonic(): ranks stay those of all points; a round weighs the blocks."""

    def finish(table, draws):
        s = resampling.weighted(table, draws).reshape(len(draws), 4, 6)
        enough = table.sum(0).reshape(4, 6)[:, 0] >= least
        rho = np.abs(resampling.correlation(*np.moveaxis(np.where(s[..., :1] > 0, s, 1.0), 2, 0)))
        return (resampling.share(~(rho[:, enough].mean(1) > limit)) if enough.any() else 1.0,)

    return finish


def monotonic(pairs: DataFrame, least: int = 10, limit: float = 0.9, most: float = 0.01) -> DataFrame:
    """The mean |rank correlation| within quarters of x that have enough points; passes above the limit."""
    rows = ranked(stored(checked(pairs).select("pair", "idx", "x", "y", "size")), ["pair"], "x", "__rank")
    place = F.col("before") + F.row_number().over(Window.partitionBy("pair", "x").orderBy("idx"))
    base, more = F.floor(F.col("size") / 4), F.col("size") % 4  # the first `more` quarters have one row more
    quarter = F.when(place <= (base + 1) * more, F.ceil(place / (base + 1))).otherwise(more + F.ceil((place - (base + 1) * more) / base))
    rows = stored(resampling.in_blocks(rows, ordered=False).select("pair", "block", "x", "y", quarter.cast("int").alias("q")))
    rows = ranked(stored(ranked(rows, ["pair", "q"], "x", "__x").drop("before")), ["pair", "q"], "y", "__y")
    rows = rows.select("pair", "q", "block", F.col("__x").alias("x"), F.col("__y").alias("y"))
    r = rows.groupBy("pair", "q").agg(*[F.sum(c).alias(k) for k, c in moments().items()]).where(F.col("n") >= least)
    out = r.select("pair", "q", F.abs(correlation(*[F.col(k) for k in moments()])).alias("rho")).groupBy("pair").agg(F.count(F.lit(1)).alias("bins"), F.avg("rho").alias("statistic"))
    values = {f"{k}{q}": F.when(F.col("q") == q, c).otherwise(0.0) for q in range(1, 5) for k, c in moments().items()}
    sums = resampling.block_sums(rows, values)
    return _with_p(out, resampling.drawn(sums, list(values), _rank_correlations(least, limit), "p double"), F.col("statistic") > limit, most)


def _bends(cuts: int, limit: float) -> resampling.Finish:
    """p of alpha_decay(): the drawn stretches in their order, prefixes of them."""

    def finish(table, draws):
        whole = np.cumsum(table[np.sort(draws, 1)], 1)
        at = np.unique(np.ceil(np.arange(1, cuts + 1) * table.shape[0] / cuts).astype(int)) - 1
        r = resampling.correlation(*np.moveaxis(whole[:, at], 2, 0))
        d = r[:, 2:] - 2 * r[:, 1:-1] + r[:, :-2]
        spread = r.std(1)
        return (resampling.share(~(np.where(spread > 1e-12, d.std(1) / np.where(spread > 1e-12, spread, 1), 0.0) < limit)),)

    return finish


def alpha_decay(pairs: DataFrame, cuts: int = 20, least: int = 30, limit: float = 0.3, most: float = 0.05) -> DataFrame:
    """Spread of the second differences of r over growing prefixes, over r's spread; passes under the limit (a smooth path)."""
    rows = checked(pairs, least)
    run = running(rows, moments())
    step = F.greatest(F.floor(F.col("size") / cuts), F.lit(1))
    at = run.where((F.col("n") >= 10) & (F.col("n") % step == 0)).select("pair", "n", correlation(*[F.col(k) for k in moments()]).alias("r"))
    o = Window.partitionBy("pair").orderBy("n")  # about `cuts` rows, 2 * cuts at most
    second = at.withColumn("d", F.col("r") - 2 * F.lag("r").over(o) + F.lag("r", 2).over(o))
    out = second.groupBy("pair").agg(F.stddev_pop("d").alias("bend"), F.stddev_pop("r").alias("spread"), F.count("d").alias("points"))
    out = out.select("pair", "points", F.coalesce(F.try_divide("bend", F.when(F.col("spread") > 1e-12, F.col("spread"))), F.lit(0.0)).alias("statistic"))
    sums = resampling.block_sums(resampling.in_blocks(rows, ordered=True), moments())
    return _with_p(out, resampling.drawn(sums, list(moments()), _bends(cuts, limit), "p double"), F.col("statistic") < limit, most)


CLOSED = {"chow": chow, "cusum": cusum, "leave_one_out": leave_one_out, "monotonic": monotonic, "alpha_decay": alpha_decay}


def judge(pairs: DataFrame, name: str) -> DataFrame:
    """pair, referee, statistic, passed of one test by any of its names. Columns z... are the confounders of conditional_mi and the
    controls of partial."""
    test, _ = resolve(name)
    out = CLOSED[test](pairs) if test in CLOSED else partial(pairs, tuple(c for c in pairs.columns if c.startswith("z"))) if test == "partial" else vectors.TESTS[test](pairs)
    return out.select(F.col("pair").cast("string").alias("pair"), F.lit(test).alias("referee"), "statistic", "passed")


def tri_gate(pairs: DataFrame, names: list[str]) -> DataFrame:
    """pair, passed (all three), confidence (share passed) of three tests of three categories."""
    if not compatible(names):
        raise ValueError("three tests of three categories are needed")
    from functools import reduce

    votes = reduce(DataFrame.union, [judge(pairs, n) for n in names])
    return votes.groupBy("pair").agg((F.count_if("passed") == 3).alias("passed"), (F.count_if("passed") / 3).alias("confidence"))


def audit(evidence: DataFrame, limit: float = 0.01) -> DataFrame:
    """evidence(q, ...) with e_value 1 / q and whether q is within the limit."""
    return evidence.withColumns({"e_value": F.try_divide(F.lit(1.0), F.col("q")), "passed": F.col("q") <= limit})
