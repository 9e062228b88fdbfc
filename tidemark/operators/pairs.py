"""Screening of variable pairs: correlation, rank correlation, association, group differences, and false-discovery control.

Correlations of all pairs of V columns come from one aggregation over the table: a row's pairs are unfolded in the task and
summed map-side into V(V-1)/2 rows of moments, so the shuffle carries pairs per task, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.functions import special

MOST_VARIABLES, MOST_PAIRS = 2000, 500_000
#: Up to so many pairs have aggregates of their own in one row a group; more are unfolded into rows.
FEW_PAIRS = 15


def check_size(variables: int, most_variables: int = MOST_VARIABLES, most_pairs: int = MOST_PAIRS) -> None:
    if variables > most_variables:
        raise ValueError(f"too many variables: {variables} of at most {most_variables}")
    if variables * (variables - 1) // 2 > most_pairs:
        raise ValueError(f"too many variable pairs: {variables * (variables - 1) // 2} of at most {most_pairs}")


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r of sums, held within -1 and 1; 0 where a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    bound = lambda v, s: v > 1e-12 * s * s + 1e-300  # noqa: E731  a constant's variance is rounding noise
    r = F.when(bound(vx, sx) & bound(vy, sy), F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """x, y, n and the sums of every pair of columns over the rows where both are finite."""
    check_size(len(columns))
    finite = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in columns]
    if len(columns) * (len(columns) - 1) // 2 <= FEW_PAIRS:
        return _few_moments(df.select(*by, *[f.alias(f"__{i}") for i, f in enumerate(finite)]), columns, by)
    wide = df.select(*by, F.array(*finite).alias("v"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(len(columns)), 2)])
    each = wide.select(*by, "v", F.explode(pairs).alias("p")).select(*by, "p.i", "p.j", F.col("v")[F.col("p.i")].alias("a"), F.col("v")[F.col("p.j")].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    sums = each.groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(*by, names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), "n", "sx", "sy", "sxx", "syy", "sxy")


def _few_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    aggs, structs = [], []
    for i, j in combinations(range(len(columns)), 2):
        a, b = F.col(f"__{i}"), F.col(f"__{j}")
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        parts = {"n": F.count(a + b), "sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "syy": F.sum(b * b), "sxy": F.sum(a * b)}
        aggs += [e.alias(f"{k}_{i}_{j}") for k, e in parts.items()]
        structs.append(F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), *[F.col(f"{k}_{i}_{j}").alias(k) for k in parts]))
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*structs)).alias("p")).select(*by, "p.*").where("n > 0")


def pearson(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), least: int = 3, p_value: bool = True) -> DataFrame:
    """x, y, n, r, t and the two-sided p of every pair with at least `least` common values."""
    r = correlation(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    out = moments(df, columns, by).where(F.col("n") >= least).select(*by, "x", "y", "n", r.alias("r"))
    out = out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15))))
    return out.withColumn("p", special.p_t("t", (F.col("n") - 2).cast("double"))) if p_value else out


def fisher_interval(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The confidence interval of a correlation; (-1, 1) for fewer than four values."""
    centre, half = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))), z / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return F.when(n > 3, F.tanh(centre - half)).otherwise(-1.0), F.when(n > 3, F.tanh(centre + half)).otherwise(1.0)


def ranked(df: DataFrame, columns: Sequence[str], ids: Sequence[str], average_ties: bool = True, ranges: int = 64) -> DataFrame:
    """df's ids with each column as its rank. Average ranks for ties, or ordinal ranks (ties by the ids).

    Values are counted first, so a frequent value is one row; distinct values are dealt into ranges by approximate quantiles, a
    window numbers each range, and a range's start is the sum of those before it. No task sorts a whole column.
    """
    rows = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), "field", "value").where("value IS NOT NULL AND NOT isnan(value)")
    counts = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("k"))
    cuts = counts.groupBy("field").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    dealt = counts.join(F.broadcast(cuts), "field").select("field", "value", "k", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("part"))  # a row per column
    sizes = dealt.groupBy("field", "part").agg(F.sum("k").alias("n"))
    starts = sizes.select("field", "part", (F.sum("n").over(Window.partitionBy("field").orderBy("part")) - F.col("n")).alias("start"))
    before = F.col("start") + F.sum("k").over(Window.partitionBy("field", "part").orderBy("value")) - F.col("k")
    placed = dealt.join(F.broadcast(starts), ["field", "part"]).select("field", "value", before.alias("before"), "k")  # a row per column and range
    both = rows.join(placed, ["field", "value"])
    if average_ties:
        rank = F.col("before") + (F.col("k") + 1) / 2.0
    else:
        rank = (F.col("before") + F.row_number().over(Window.partitionBy("field", "value").orderBy(*ids))).cast("double")
    return both.withColumn("rank", rank).groupBy(*ids).pivot("field", list(columns)).agg(F.first("rank"))


def spearman(df: DataFrame, columns: Sequence[str], ids: Sequence[str], average_ties: bool = True, p_value: bool = True) -> DataFrame:
    """Pearson's correlation of ranks."""
    return pearson(ranked(df, columns, ids, average_ties), columns, p_value=p_value)


def adjusted(df: DataFrame, p: str = "p", family: Sequence[str] = (), ties: Sequence[str] = (), method: str = "bh") -> DataFrame:
    """df with rank and q. `bh`: the step-up procedure (running minimum from the largest p); `plain`: min(1, p m / rank) alone.
    Families are ranked apart; df has one row per test, so a family is as large as the number of pairs screened."""
    keys = list(family) or [F.lit(1)]
    order = Window.partitionBy(*keys).orderBy(p, *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = df.withColumns({"rank": F.row_number().over(order), "tests": m})
    out = out.withColumn("q", F.least(F.lit(1.0), F.col(p) * F.col("tests") / F.col("rank")))
    if method == "bh":
        out = out.withColumn("q", F.min("q").over(Window.partitionBy(*keys).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("tests")


def sweep(df: DataFrame, columns: Sequence[str], threshold: float = 0.3, least: int = 10) -> DataFrame:
    """The association sweep: pairs with at least `least` common values and |r| above the threshold."""
    return pearson(df, columns, least=least).where(F.abs("r") > threshold)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of the cells of two categories that hold rows, with the margins na and nb and the total n. NaN
    counts as missing. Empty cells aren't built: their expected counts add up to n less those of the others."""
    clean = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a NOT IN ('NaN', 'Infinity', '-Infinity') AND b NOT IN ('NaN', 'Infinity', '-Infinity')")
    cells = clean.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"))
    rows, cols = cells.groupBy("a").agg(F.sum("observed").alias("na")), cells.groupBy("b").agg(F.sum("observed").alias("nb"))
    total = cells.agg(F.sum("observed").alias("n"))  # one row
    met = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    return met.select("a", "b", "observed", (F.col("na") * F.col("nb") / F.col("n")).alias("expected"), "na", "nb", "n")


def chi_square(df: DataFrame, a: str, b: str, p_value: bool = True) -> DataFrame:
    """n, chi2 (with Yates's correction for 2 x 2 tables), df and Cramer's V of two categories.

    Over cells that hold rows; an empty one adds its expected count. The cells of a 2 x 2 table all differ by the same amount."""
    cells = contingency(df, a, b)
    o, e = F.col("observed"), F.col("expected")
    s = cells.agg(
        F.sum("observed").alias("n"), F.sum((o - e) * (o - e) / e - e).alias("gaps"), F.max(F.abs(o - e)).alias("gap"),
        F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"),
    )
    gap, n, na, nb = F.greatest(F.col("gap") - 0.5, F.lit(0.0)), F.col("n"), F.col("na"), F.col("nb")
    yates = gap * gap * n * (1 / na + F.try_divide(F.lit(1.0), n - na)) * (1 / nb + F.try_divide(F.lit(1.0), n - nb))
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(F.greatest(F.col("gaps") + n, F.lit(0.0)))
    out = s.withColumn("chi2", chi2).select("n", "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.coalesce(F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("r", "c") - 1))), F.lit(0.0)).alias("cramers_v"))
    return out.withColumn("p", special.p_chi2("chi2", F.col("df").cast("double"))) if p_value else out


def two_samples(df: DataFrame, value: str, group: str, first, second, p_value: bool = True) -> DataFrame:
    """Pooled and Welch's t, their degrees of freedom, Cohen's d and Hedges's g of two groups."""
    v = F.col(value).cast("double")
    of = lambda k: F.when(F.col(group) == F.lit(k), v)
    s = df.where(F.col(group).isin(first, second) & v.isNotNull() & ~F.isnan(v)).agg(
        *[f(of(k)).alias(f"{name}{i}") for i, k in ((1, first), (2, second)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    d = F.try_divide(m1 - m2, F.sqrt(pooled))
    a, b = v1 / n1, v2 / n2
    out = s.select(
        "n1", "n2", F.try_divide(m1 - m2, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), (n1 + n2 - 2).alias("df"), d.alias("cohen_d"), (d * (1 - 3 / (4 * (n1 + n2) - 9))).alias("hedges_g"),
        F.try_divide(m1 - m2, F.sqrt(a + b)).alias("welch_t"), F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)).alias("welch_df"),
    )
    return out.withColumns({"p": special.p_t("t", F.col("df").cast("double")), "welch_p": special.p_t("welch_t", "welch_df")}) if p_value else out


def rank_sums(df: DataFrame, value: str, group: str, ids: Sequence[str]) -> DataFrame:
    """n and rank sum per group with the tie term, from one average ranking."""
    order = ranked(df, [value], ids).withColumnRenamed(value, "rank")
    return df.select(*ids, F.col(group).alias("g")).join(order, list(ids)).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"))


def kruskal_wallis(df: DataFrame, value: str, group: str, ids: Sequence[str], p_value: bool = True) -> DataFrame:
    """H (without tie correction), df and p over all groups."""
    sums = rank_sums(df, value, group, ids)
    total = F.sum("n")
    out = sums.agg(F.count(F.lit(1)).alias("groups"), total.alias("n"), F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("s"))
    out = out.select("n", (F.col("groups") - 1).alias("df"), (12 * F.col("s") / (F.col("n") * (F.col("n") + 1)) - 3 * (F.col("n") + 1)).alias("h"))
    return out.withColumn("p", special.p_chi2("h", F.col("df").cast("double"))) if p_value else out


def mann_whitney(df: DataFrame, value: str, group: str, first, second, ids: Sequence[str], p_value: bool = True) -> DataFrame:
    """U of the first group and z by the normal approximation."""
    sums = rank_sums(df.where(F.col(group).isin(first, second)), value, group, ids)
    of = lambda k, c: F.max(F.when(F.col("g") == F.lit(k), F.col(c)))
    out = sums.agg(of(first, "n").alias("n1"), of(second, "n").alias("n2"), of(first, "ranks").alias("r1"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # the product of three counts is beyond a long
    out = out.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    out = out.select("n1", "n2", "u", F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)).alias("z"))
    return out.withColumn("p", special.p_normal("z")) if p_value else out


def normality(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """D'Agostino's K2 of a column (8 values or more) with p = exp(-K2 / 2), or skewness and kurtosis as Jarque and Bera have them."""
    v = F.col(column).cast("double")
    s = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(y / alpha) / F.sqrt(F.log(F.sqrt(w2)))
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    z2 = ((1 - 2 / (9 * a)) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    k2 = F.when(n >= 8, z1 * z1 + z2 * z2).otherwise(n / 6 * (g1 * g1 + g2 * g2 / 4))
    return s.select(*by, n.cast("bigint").alias("n"), "g1", "g2", k2.alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))


def relationships(screened: DataFrame) -> DataFrame:
    """Screened pairs (x, y, n, r, p, q) with verdict, confidence and practical size."""
    return screened.withColumns({"verdict": C.verdict(F.col("q"), F.col("n")), "confidence": C.confidence_level(F.col("p"), F.col("r")), "practical": C.practical_significance(F.col("r"), "correlation"), "signal": C.signal_label(F.col("r"))})
