"""Discovery briefs: all senses of a pair together, their confidence, strength and warnings; registries, daily roll-ups, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.functions import special
from tidemark.operators import pairs as PA

# Weights of the senses in a brief's confidence.
SENSES = {"mutual_information": 0.25, "welch_t": 0.20, "chi_square": 0.15, "spearman": 0.20, "cross_correlation": 0.20}


def senses(df: DataFrame, x: str, y: str, ids: Sequence[str], bins: int = 4) -> DataFrame:
    """sense, n, effect of a pair by four senses at once: Pearson, Spearman, Cramer's V of equally filled bins, and their mutual
    information in bits over its bound. Each is an independent aggregate; bins come from one ranking per column."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    one = lambda f, name: f.select(F.lit(name).alias("sense"), "n", F.col("r").alias("effect"))
    ranks = PA.ranked(base, [x, y], ids, average_ties=False)
    total = ranks.agg(F.count(F.lit(1)).alias("__n"))  # one row
    binned = ranks.crossJoin(F.broadcast(total)).select(*[F.least(F.floor((F.col(c) - 1) * bins / F.col("__n")), F.lit(bins - 1)).cast("int").alias(c) for c in (x, y)])
    cells = PA.contingency(binned, x, y)
    p = F.col("observed") / F.sum("observed").over(Window.partitionBy(F.lit(1)))  # bins x bins rows
    info = cells.where("observed > 0").select("observed", (p * F.log2(F.col("observed") / F.col("expected"))).alias("i")).agg(F.sum("observed").alias("n"), (F.sum("i") / F.log2(F.lit(float(bins)))).alias("r"))
    v = PA.chi_square(binned, x, y, p_value=False).select("n", F.col("cramers_v").alias("r"))
    return reduce(DataFrame.union, [one(PA.pearson(base, [x, y], p_value=False), "pearson"), one(PA.spearman(base, [x, y], ids, p_value=False), "spearman"), one(v, "chi_square"), one(info, "mutual_information")])


def strength(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted confidence, consistency (1 - deviation of the scores) and their number, over scores(by, sense, score); null scores
    don't count."""
    weight = C.lookup_label(F.col("sense"), SENSES, 0.0)
    s = scores.where("score IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("senses"), F.coalesce(F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)), F.lit(0.0)).alias("confidence"), F.stddev_pop("score").alias("d"))
    return s.select(*by, "senses", "confidence", F.when(F.col("senses") > 1, 1 - F.col("d")).otherwise(0.0).alias("consistency"))


def warnings(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, flags: low_sample_size if a sense has under 30 rows; nonlinear_only if mutual information is significant and neither
    Pearson nor Spearman is. results(by, sense, n, p)."""
    significant = lambda *s: F.coalesce(F.bool_or(F.col("sense").isin(*s) & (F.col("p") < 0.05)), F.lit(False))
    s = results.groupBy(*by).agg(F.min("n").alias("n"), significant("mutual_information").alias("mi"), significant("pearson", "spearman").alias("linear"))
    flags = F.filter(F.array(F.when(F.col("n") < 30, F.lit("low_sample_size")), F.when(F.col("mi") & ~F.col("linear"), F.lit("nonlinear_only"))), lambda f: f.isNotNull())
    return s.select(*by, flags.alias("flags"))


def signed_ranks(df: DataFrame, a: str, b: str, ids: Sequence[str], p_value: bool = True) -> DataFrame:
    """Wilcoxon's signed ranks of paired values: n without ties, the smaller rank sum, and z by the normal approximation."""
    d = df.select(*ids, (F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d IS NOT NULL AND d <> 0")
    ranks = PA.ranked(d.select(*ids, F.abs("d").alias("size")), ["size"], ids).withColumnRenamed("size", "rank")
    s = d.join(ranks, list(ids)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("down"))
    n = F.col("n").cast("double")
    out = s.select("n", F.least("up", "down").alias("w")).withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))
    return out.withColumn("p", special.p_normal("z")) if p_value else out


def mean_interval(df: DataFrame, value: str, by: Sequence[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Mean with its normal confidence interval."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    half = z * F.col("s") / F.sqrt("n")
    return s.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def sample_size(effect: Column, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """Rows a group that find a standardised difference of means (two-sided .05, power .8)."""
    return F.ceil(2 * F.pow((z_alpha + z_power) / F.nullif(F.abs(effect), F.lit(0.0)), F.lit(2.0)))


# --- registries, roll-ups, checks


def registry_hash(contracts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One SHA-256 of all contracts, whatever their order in the table."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return contracts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("contracts"))


def contract_value(text: Column, kind: str, codes: dict[str, float] | None = None) -> Column:
    """A cell as the contract's double: binary 1 or 0, categories by their codes (`__unknown__` for others), numbers; 0 otherwise."""
    if kind == "binary":
        return F.when(C.parse_boolean(text), 1.0).otherwise(0.0)
    if kind == "categorical":
        codes = codes or {}
        return C.lookup_label(text, {k: v for k, v in codes.items() if k != "__unknown__"}, codes.get("__unknown__", 0.0))
    return F.coalesce(C.parse_number(text), F.lit(0.0))


def daily_metrics(df: DataFrame, ts: str, measures: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Measures per day."""
    return df.groupBy(F.to_date(ts).alias("day"), *by).agg(*[m.alias(k) for k, m in measures.items()])


def text_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean length in bytes, and whether any value has digits or other signs."""
    v = F.col(column)
    return df.groupBy(*by).agg(F.avg(F.octet_length(v)).alias("mean_bytes"), F.coalesce(F.bool_or(v.rlike(r"\d")), F.lit(False)).alias("has_digits"), F.coalesce(F.bool_or(v.rlike(r"[^A-Za-z0-9\s]")), F.lit(False)).alias("has_specials"))


def key_checks(df: DataFrame, key: str, pattern: str, most_invalid: float = 0.1, most_null: float = 0.5) -> DataFrame:
    """Rows, invalid and repeated keys, columns with too many nulls, and whether the table passes, in one aggregation."""
    invalid = F.count_if(~F.coalesce(F.col(key).cast("string").rlike(pattern), F.lit(False)))
    nulls = [F.avg(F.col(c).isNull().cast("double")).alias(f"__{i}") for i, c in enumerate(df.columns)]
    s = df.agg(F.count(F.lit(1)).alias("rows"), invalid.alias("invalid"), (F.count(key) - F.countDistinct(key)).alias("repeated"), *nulls)
    sparse = F.filter(F.array(*[F.when(F.col(f"__{i}") > most_null, F.lit(c)) for i, c in enumerate(df.columns)]), lambda c: c.isNotNull())
    return s.select("rows", "invalid", "repeated", F.size(sparse).alias("sparse_columns"), (F.col("invalid") <= F.col("rows") * most_invalid).alias("passes"))


def noisy(evidence: DataFrame, by: Sequence[str], limit: float = 0.10) -> DataFrame:
    """Hypotheses to reject before validation: any of their discovery q-values is over the limit."""
    return evidence.groupBy(*by).agg(F.max("q").alias("worst_q")).withColumn("reject", F.col("worst_q") > limit)


def workspace_threshold(hypotheses: Column, base: float = 8.0) -> Column:
    """The e-value asked for grows with the hypotheses already made."""
    return base * (1 + hypotheses / 20)


def readable_name(column: str, known: dict[str, str] | None = None) -> str:
    """A column's name for people: a known name, else words of its snake or camel case with capitals."""
    import re

    if known and column.lower() in known:
        return known[column.lower()]
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[_\-.\s]+", " ", column)).strip()
    return " ".join(w[:1].upper() + w[1:] for w in spaced.split())
