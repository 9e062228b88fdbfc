"""Information between series, and cross mapping, by nearest neighbours over all points.

Input: pairs(pair, idx, x, y, ...), idx an order without repeats; rows with a null or not a number are left out, and pairs with fewer
than LEAST rows. Values are standardised and made whole numbers (neighbours.scaled), so the results are those of a plain computation over
all pairs of points, whatever the partitions. Nothing is estimated from a part of the points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import neighbours, resampling
from tidemark.operators.pairs import correlation
from tidemark.session import stored

K = 5
LEAST = 10
#: Between the parts of a key.
JOINT = "\x1f"


def finite(pairs: DataFrame, columns: Sequence[str], least: int = LEAST) -> DataFrame:
    """pair (a string), idx and the columns (doubles) of rows where all are finite, of pairs with enough of them, with their number size."""
    ok = pairs.select(F.col("pair").cast("string").alias("pair"), F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in columns])
    ok = ok.dropna(subset=["pair", *columns])
    for c in columns:
        ok = ok.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return ok.join(ok.groupBy("pair").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least), "pair")


def digamma(n: Column) -> Column:
    """digamma of positive whole numbers."""
    z = n.cast("double") + 6
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, F.lit(4))) - 1 / (252 * F.pow(z, F.lit(6))) - sum(1 / (n + i) for i in range(6))


def different(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """key, id (the least), the columns and w, how many of rows(key, id, ...) are equal in key and columns: equal points have the same
    neighbours, so each is asked for once. Stored."""
    return stored(rows.groupBy("key", *columns).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")))


def _points(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select("key", "id", F.array(*columns).alias("c"), "w", F.lit(0.0).alias("t"), F.lit(True).alias("self"))


def _reaches(rows: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """key, id and box, the distance of the k-th neighbour (of the last, where there are fewer), stored."""
    points = _points(rows, columns)
    near = neighbours.nearest(neighbours.Grid(points, len(columns)), points, k)
    return stored(near.select("key", "id", F.element_at("near", -1)["d"].alias("box")))


def _counted(rows: DataFrame, reaches: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """key, id and the number of points nearer in these columns than the reach, at least 1."""
    if len(columns) == 1:
        v = F.col(columns[0])
        n = neighbours.within_line(rows.select("key", v.alias("v"), "w"), rows.select("key", "id", v.alias("v")).join(reaches, ["key", "id"]))
    else:
        n = neighbours.within(neighbours.Grid(_points(rows, columns), len(columns)), _points(rows, columns).join(reaches, ["key", "id"]))
    return n.select("key", "id", F.greatest("n", F.lit(1)).alias(name))


def mutual_terms(rows: DataFrame, k: int = K) -> DataFrame:
    """key, a, b, w (such points), m (the key's rows) and term, whose mean over all points is the mutual information (Kraskov, Stoegbauer and
    Grassberger) of a and b of the whole-number rows(key, id, a, b), in natural units."""
    rows = different(rows, ["a", "b"])
    reaches = _reaches(rows, ["a", "b"], k)
    m = rows.groupBy("key").agg(F.sum("w").alias("m"))
    met = rows.join(_counted(rows, reaches, ["a"], "na"), ["key", "id"]).join(_counted(rows, reaches, ["b"], "nb"), ["key", "id"]).join(m, "key")
    term = digamma(F.least(F.lit(k), F.col("m") - 1)) + digamma(F.col("m")) - digamma(F.col("na")) - digamma(F.col("nb"))
    return met.select("key", "a", "b", "w", "m", term.alias("term"))


def conditional_terms(rows: DataFrame, k: int = K) -> DataFrame:
    """key, a, b, c, w (such points), m and term, whose mean over all points is the information between a and b with c known (Frenzel and
    Pompe) of the whole-number rows(key, id, a, b, c)."""
    rows = different(rows, ["a", "b", "c"])
    reaches = _reaches(rows, ["a", "b", "c"], k)
    m = rows.groupBy("key").agg(F.sum("w").alias("m"))
    met = rows.join(_counted(rows, reaches, ["a", "c"], "nac"), ["key", "id"]).join(_counted(rows, reaches, ["b", "c"], "nbc"), ["key", "id"]).join(_counted(rows, reaches, ["c"], "nc"), ["key", "id"]).join(m, "key")
    term = digamma(F.least(F.lit(k), F.col("m") - 1)) - digamma(F.col("nac")) - digamma(F.col("nbc")) + digamma(F.col("nc"))
    return met.select("key", "a", "b", "c", "w", "m", term.alias("term"))


def mutual_information(pairs: DataFrame, k: int = K, limit: float = 0.1) -> DataFrame:
    """pair, n, statistic (mutual information of x and y), p = 1 - min(statistic / 2, 1), passed above the limit."""
    rows = neighbours.scaled(finite(pairs, ["x", "y"]), ["pair"], ["x", "y"])
    rows = rows.select(F.col("pair").alias("key"), F.col("idx").alias("id"), F.col("x").alias("a"), F.col("y").alias("b"))
    mean = F.sum(F.col("w") * F.col("term")) / F.sum("w")
    out = mutual_terms(rows, k).groupBy(F.col("key").alias("pair")).agg(F.first("m").alias("n"), F.greatest(mean, F.lit(0.0)).alias("statistic"))
    return out.select("pair", "n", "statistic", (1 - F.least(F.col("statistic") / 2, F.lit(1.0))).alias("p"), (F.col("statistic") > limit).alias("passed"))


def conditional_information(pairs: DataFrame, confounders: Sequence[str] = (), k: int = K, limit: float = 0.01, z: float = 3.09) -> DataFrame:
    """pair, n, statistic, p, passed: the least, over confounders, of the information between x and y with the confounder known; p is its
    99.9 % upper bound, which must be within the limit. Without confounders none can explain the relation, so it passes."""
    every = finite(pairs, ["x", "y"]).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    if not confounders:
        return every.select("pair", "n", F.lit(0.0).alias("statistic"), F.lit(1.0).alias("p"), F.lit(True).alias("passed"))
    each = []
    for name in confounders:
        rows = neighbours.scaled(finite(pairs, ["x", "y", name]), ["pair"], ["x", "y", name])
        each.append(rows.select(F.concat_ws(JOINT, "pair", F.lit(name)).alias("key"), F.col("idx").alias("id"), F.col("x").alias("a"), F.col("y").alias("b"), F.col(name).alias("c")))
    terms = stored(conditional_terms(reduce(DataFrame.unionByName, each), k))
    means = terms.groupBy("key").agg((F.sum(F.col("w") * F.col("term")) / F.sum("w")).alias("mean"))
    off = F.col("term") - F.col("mean")
    of = terms.join(means, "key").groupBy("key").agg(F.first("mean").alias("mean"), (F.sqrt(F.sum(F.col("w") * off * off)) / F.sum("w")).alias("error"))
    least = of.groupBy(F.split("key", JOINT)[0].alias("pair")).agg(F.min(F.struct("mean", "error")).alias("s"))
    told = least.select("pair", F.greatest("s.mean", F.lit(0.0)).alias("statistic"), (F.greatest("s.mean", F.lit(0.0)) + z * F.col("s.error")).alias("p"))
    out = every.join(told, "pair", "left")
    return out.select("pair", "n", F.coalesce("statistic", F.lit(0.0)).alias("statistic"), F.coalesce("p", F.lit(1.0)).alias("p"), (F.col("p").isNull() | (F.col("p") <= limit)).alias("passed"))


def _lagged(rows: DataFrame, lags: Sequence[int]) -> DataFrame:
    """key (pair, lag, direction), id, a (the driver's past), b (the target's present), c (the target's past)."""
    past = rows.select("pair", "idx", F.explode(F.array(*[F.lit(lag) for lag in lags])).alias("lag"), F.col("x").alias("px"), F.col("y").alias("py"))
    past = past.withColumn("idx", F.col("idx") + F.col("lag"))
    met = rows.join(past, ["pair", "idx"])
    ways = F.array(F.struct(F.lit("there").alias("way"), F.col("px").alias("a"), F.col("y").alias("b"), F.col("py").alias("c")), F.struct(F.lit("back").alias("way"), F.col("py").alias("a"), F.col("x").alias("b"), F.col("px").alias("c")))
    return met.select(F.col("idx").alias("id"), "pair", "lag", F.explode(ways).alias("w")).select(F.concat_ws(JOINT, "pair", F.col("lag").cast("string"), "w.way").alias("key"), "id", "w.a", "w.b", "w.c")


def transfer_entropy(pairs: DataFrame, lags: Sequence[int] = (1, 2, 3, 4, 5), k: int = K, ratio: float = 1.1, most: float = 0.001) -> DataFrame:
    """pair, n, there (transfer entropy from x to y, the mean over lags), back, statistic = there / back, p and passed: more than `ratio` times
    as much goes there, and p is below `most`. p is the share of a block bootstrap's rounds in which no more goes there than back. Rows
    whose idx differ by a lag are taken together."""
    rows = stored(finite(pairs, ["x", "y"], 20))
    whole = neighbours.scaled(rows.select("pair", "idx", "x", "y"), ["pair"], ["x", "y"])
    past = stored(_lagged(whole, lags))
    terms = past.join(conditional_terms(past, k), ["key", "a", "b", "c"])
    parts = F.split("key", JOINT)
    named = terms.select(parts[0].alias("pair"), F.col("id").alias("idx"), F.concat_ws("_", parts[2], parts[1]).alias("of"), "term")
    blocks = resampling.in_blocks(rows.select("pair", "idx", "size"), ordered=True).select("pair", "idx", "block")
    columns = [f"{way}_{lag}" for way in ("there", "back") for lag in lags]
    values = {f"n_{c}": (F.col("of") == c).cast("int") for c in columns} | {f"s_{c}": F.when(F.col("of") == c, F.col("term")).otherwise(0.0) for c in columns}
    sums = resampling.block_sums(named.join(blocks, ["pair", "idx"]), values)

    def finish(table, draws):
        def flows(s):
            mean = np.maximum(s[:, len(columns) :] / np.maximum(s[:, : len(columns)], 1), 0)
            return mean[:, : len(lags)].mean(1), mean[:, len(lags) :].mean(1)

        there, back = (float(v[0]) for v in flows(table.sum(0)[None]))
        told = there / (back + 1e-10)
        p = resampling.share(np.less_equal(*flows(resampling.weighted(table, draws))))
        return there, back, told, p, bool(told > ratio and p < most)

    out = resampling.drawn(sums, list(values), finish, "there double, back double, statistic double, p double, passed boolean")
    return rows.groupBy("pair").agg(F.first("size").alias("n")).join(out, "pair").select("pair", "n", "there", "back", "statistic", "p", "passed")


FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)


def cross_mapping_skill(pairs: DataFrame, dimension: int = 3, fractions: Sequence[float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """pair, way, fraction, library (points in it) and skill: the correlation of a series' values with what the other one's shadow manifold
    (its last `dimension` values) tells of them, by simplex projection from the nearest points of a seeded part of all points. way: 'there'
    if y's manifold tells x (x drives y), else 'back'. A library of a fraction holds those of lesser ones."""
    rows = neighbours.scaled(finite(pairs, ["x", "y"], dimension + LEAST), ["pair"], ["x", "y"]).select("pair", "idx", "x", "y")
    rows = stored(rows)
    met = rows
    for lag in range(1, dimension):
        met = met.join(rows.select("pair", (F.col("idx") + lag).alias("idx"), F.col("x").alias(f"x{lag}"), F.col("y").alias(f"y{lag}")), ["pair", "idx"])
    manifold = lambda c: F.array(c, *[f"{c}{lag}" for lag in range(1, dimension)])
    ways = F.array(F.struct(F.lit("there").alias("way"), manifold("y").alias("c"), F.col("x").alias("t")), F.struct(F.lit("back").alias("way"), manifold("x").alias("c"), F.col("y").alias("t")))
    draw = F.pmod(F.xxhash64("idx", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    each = met.select("pair", "idx", draw.alias("draw"), F.explode(ways).alias("w"), F.lit(1).alias("one")).select("pair", "idx", "draw", F.col("w.way").alias("way"), F.col("w.c").alias("c"), F.col("w.t").cast("double").alias("t"))
    each = each.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    each = stored(each.select(F.concat_ws(JOINT, "pair", "way", F.col("fraction").cast("string")).alias("key"), F.col("idx").alias("id"), "c", "t", (F.col("draw") < F.col("fraction")).alias("self")))
    library = each.where("self").select("key", "c", F.lit(1).cast("long").alias("w"), "t")
    # rows of equal coordinates, values and part have the same neighbours, so each such set asks once
    asked = stored(each.groupBy("key", "c", "t", "self").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("asking")))
    near = neighbours.nearest(neighbours.Grid(library, dimension), asked, dimension + 1, euclidean=True)
    first = F.greatest(F.element_at("near", 1)["d"], F.lit(1))  # at a distance of 0 those there alone count
    weighted = F.aggregate("near", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a["s"] + F.exp(-x["d"] / first) * x["t"]).alias("s"), (a["w"] + F.exp(-x["d"] / first) * x["w"]).alias("w")), lambda a: a["s"] / a["w"])
    told = near.where(F.size("near") > 0).select("key", "id", (weighted / neighbours.UNITS).alias("y")).join(asked.select("key", "id", "asking", (F.col("t") / neighbours.UNITS).alias("x")), ["key", "id"])
    x, y = F.col("x"), F.col("y")
    sums = told.groupBy("key").agg(F.sum("asking").alias("n"), *[F.sum(F.col("asking") * e).alias(n) for n, e in {"sx": x, "sy": y, "xx": x * x, "yy": y * y, "xy": x * y}.items()])
    sizes = library.groupBy("key").agg(F.sum("w").alias("library"))
    parts = F.split("key", JOINT)
    skill = correlation(*[F.col(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
    return sums.join(sizes, "key").select(parts[0].alias("pair"), parts[1].alias("way"), parts[2].cast("double").alias("fraction"), "library", F.col("n"), skill.alias("skill"))


def cross_mapping(pairs: DataFrame, dimension: int = 3, fractions: Sequence[float] = FRACTIONS, limit: float = 0.3, advantage: float = 0.1) -> DataFrame:
    """pair, n, statistic (the skill with all points in which y's manifold tells x), p = 1 - skill, advantage (over the other way) and passed:
    the skill is beyond the limit, has levelled off (it grows by less than .1 from the last library but one) and has the advantage."""
    last, before = sorted(fractions)[-1], sorted(fractions)[-2]
    at = lambda way, f: F.max(F.when((F.col("way") == way) & (F.col("fraction") == f), F.col("skill")))
    s = cross_mapping_skill(pairs, dimension, fractions).groupBy("pair").agg(F.max("n").alias("n"), at("there", last).alias("statistic"), at("there", before).alias("before"), at("back", last).alias("back"))
    out = s.withColumn("advantage", F.col("statistic") - F.col("back"))
    level = (F.col("statistic") > 0.1) & (F.col("statistic") - F.col("before") < 0.1)
    return out.select("pair", "n", "statistic", (1 - F.greatest("statistic", F.lit(0.0))).alias("p"), "advantage", (level & (F.col("statistic") > limit) & (F.col("advantage") > advantage)).alias("passed"))
