"""Profiles of columns: numeric and shape statistics, cardinality, entropy, missing runs, type inference, contracts, readiness.

A wide table is profiled in one aggregation over all columns; what needs value frequencies goes through one unpivot and one
count per (column, value), whatever the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C


def long(df: DataFrame, columns: Sequence[str], name: str = "field", value: str = "value", ids: Sequence[str] = (), kind: str = "string") -> DataFrame:
    """One row per row and column: the wide table on end, values cast to one type."""
    return df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def numeric_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """field, n, mean, std_samp, min, max, zeros, negatives; NaN and infinite values count as missing."""
    rows = long(df, columns, ids=by, kind="double")
    v = F.when(F.abs(F.col("value")) < float("inf"), F.col("value"))
    return rows.groupBy(*by, "field").agg(
        F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_samp"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"),
    )


def shape_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Population moments, quartiles, adjusted skewness, the library's kurtosis, noise, sparsity and IQR outliers of a column.

    skewness: g1 sqrt(n(n-1))/(n-2). kurtosis: m4/m2^2 (n-1)/((n-2)(n-3)) + 6/(n+1) + 3. noise: min(cv/2, 1), 1 at mean 0.
    """
    v = F.col(column).cast("double")
    clean = df.where(v.isNotNull() & ~F.isnan(v))
    n = F.col("n")
    stats = clean.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("excess"), F.avg((v == 0).cast("double")).alias("sparsity"),
    )
    # equal values are counted where they are, so that a group's quantiles are taken over its different values
    counted = clean.groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.percentile("__v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__n")).alias("q"))
    stats = stats.join(counted, list(by)) if by else stats.crossJoin(counted)
    stats = stats.select(
        *by, "n", "mean", "std_pop", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "sparsity",
        F.when((n > 2) & (F.col("std_pop") > 0), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0).alias("skewness"),
        F.when((n > 3) & (F.col("std_pop") > 0), (F.col("excess") + 3) * (n - 1) / ((n - 2) * (n - 3)) + 6 / (n + 1) + 3).otherwise(0.0).alias("kurtosis"),
        F.when(F.col("mean") == 0, 1.0).otherwise(F.least(F.abs(F.col("std_pop") / F.when(F.col("mean") != 0, F.col("mean"))) / 2, F.lit(1.0))).alias("noise"),
    )
    spread = F.col("q75") - F.col("q25")
    fences = stats.select(*by, (F.col("q25") - 1.5 * spread).alias("low"), (F.col("q75") + 1.5 * spread).alias("high"))
    with_fences = clean.join(F.broadcast(fences), list(by)) if by else clean.crossJoin(F.broadcast(fences))  # a row per group, or one
    outliers = with_fences.groupBy(*by).agg(F.count_if((v < F.col("low")) | (v > F.col("high"))).alias("outliers"))
    return stats.join(outliers, list(by)) if by else stats.crossJoin(outliers)


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, value, n of every non-empty value."""
    return long(df, columns).where("value IS NOT NULL AND value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, distinct, total, ratio, entropy (bits), gini (1 - sum of squared shares), mode and its share. Ties: the least value."""
    freq = frequencies(df, columns)
    totals = freq.groupBy("field").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    shares = freq.join(F.broadcast(totals), "field")  # a row for each column
    return shares.groupBy("field").agg(
        F.count(F.lit(1)).alias("distinct"), F.first("total").alias("total"), (F.count(F.lit(1)) / F.first("total")).alias("ratio"), (-F.sum(p * F.log2(p))).alias("entropy"),
        (1 - F.sum(p * p)).alias("gini"), F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("mode"), (F.max("n") / F.first("total")).alias("mode_share"),
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """field, rank, value, n, share of the k most frequent values; ties by value."""
    freq = frequencies(df, columns)
    total = freq.groupBy("field").agg(F.sum("n").alias("total"))
    ranked = freq.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(total), "field").select("field", "rank", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def missing_runs(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Missing rate and the longest run of missing values in the given order, within each group."""
    missing = F.col(column).isNull() | (F.col(column).cast("string") == "")
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.select(*by, missing.alias("missing"), (F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, missing).orderBy(*order))).alias("island"))
    runs = marked.groupBy(*by, "missing", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*by).agg((F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_rate"), F.coalesce(F.max(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("longest_run"))


def type_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, n, shares of values that parse as numbers, booleans and timestamps, distinct and whole-number shares, and the types
    by thresholds (recommended) and by confidence (inferred, confidence)."""
    v = F.col("value")
    number = C.parse_number(v)
    rows = long(df, columns).where(v.isNotNull() & (v != ""))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), share(number.isNotNull()).alias("numeric"), share(C.parse_boolean(v).isNotNull()).alias("boolean"), share(C.parse_timestamp(v).isNotNull()).alias("timestamp"),
        F.countDistinct(number).alias("numbers"), F.count(number).alias("n_numbers"), F.coalesce(F.avg(F.when(number.isNotNull(), (number == F.floor(number)).cast("double"))), F.lit(0.0)).alias("whole"),
    )
    codes = (F.col("n_numbers") >= 10) & (F.col("numbers") < 0.3 * F.col("n_numbers")) & (F.col("whole") > 0.8)
    num, truth, when = F.col("numeric"), F.col("boolean"), F.col("timestamp")
    inferred = F.when(num >= 0.95, F.when(codes, "categorical").otherwise("numeric")).when(truth >= 0.98, "boolean").when(when >= 0.90, "timestamp").when(num >= 0.8, F.when(codes, "categorical").otherwise("numeric")).otherwise("categorical")
    confidence = F.when(num >= 0.95, F.when(codes, 0.8).otherwise(F.least(num, F.lit(0.99)))).when(truth >= 0.98, truth).when(when >= 0.90, F.least(when, F.lit(0.95))).when(num >= 0.8, F.when(codes, 0.7).otherwise(num * 0.8)).otherwise(0.5)
    recommended = F.when(num >= 0.8, "numeric").when(truth >= 0.9, "boolean").when(when >= 0.8, "timestamp").otherwise("string")
    return out.select("field", "n", "numeric", "boolean", "timestamp", codes.alias("codes"), recommended.alias("recommended"), inferred.alias("inferred"), confidence.alias("confidence"))


def upload_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field and the type of an uploaded column: any number makes it numeric, else only dates a date, else only booleans a boolean."""
    v = F.col("value")
    number, date, truth = v.try_cast("double").isNotNull(), C.likely_date(v), F.lower(F.trim(v)).isin("true", "false")
    rows = long(df, columns).where(v.isNotNull() & (v != ""))
    return rows.groupBy("field").agg(F.when(F.bool_or(number), "numeric").when(F.bool_or(date), "date").when(F.bool_and(truth), "boolean").otherwise("text").alias("type"))


def entity_column(df: DataFrame, candidates: Sequence[str] = ("id", "entity_id", "customer_id", "user_id", "account_id", "record_id", "key", "primary_key")) -> str | None:
    """The first candidate, else the first column, if under half of it is empty and over half of its values differ."""
    lower = {c.lower(): c for c in df.columns}
    name = next((lower[c] for c in candidates if c in lower), df.columns[0])
    v = F.col(name).cast("string")
    row = df.agg(F.avg((v.isNull() | (v == "")).cast("double")).alias("empty"), (F.countDistinct(v) / F.count(F.lit(1))).alias("distinct")).first()
    return name if row["empty"] is not None and row["empty"] < 0.5 and row["distinct"] > 0.5 else None


def contracts(profile: DataFrame) -> DataFrame:
    """As-of mode, imputation, type, window and confidence of profiled fields: profile(field, inferred, missing_rate, zeros, n,
    negatives, mean, std_samp, quality, temporal)."""
    zeros = C.ratio(F.col("zeros"), F.col("n"), 0)
    counter = (zeros >= 0.1) & (F.col("negatives") == 0) & (F.col("std_samp") / (F.col("mean") + 1e-10) < 2)
    summable = (zeros >= 0.1) & (F.col("std_samp") > 0.01)
    numeric = F.col("inferred") == "numeric"
    mode = F.when(numeric & counter, "count_over_window").when(numeric & summable, "sum_over_window").when((F.col("inferred") == "boolean") & (F.col("missing_rate") > 0.8), "exists_as_of").otherwise("latest_value_as_of")
    windowed = mode.isin("count_over_window", "sum_over_window")
    imputation = F.when(F.col("missing_rate") > 0.5, "missing_indicator").when(windowed, "zero_fill").when(F.col("temporal"), "forward_fill").otherwise("missing_indicator")
    kind = C.lookup_label(F.col("inferred"), {"numeric": "numeric", "boolean": "binary", "timestamp": "timestamp"}, "categorical")
    wanted = (F.col("quality") >= 0.3) & (F.col("missing_rate") <= 0.95) & (F.col("inferred") != "unknown")
    return profile.where(wanted).select("field", mode.alias("as_of_mode"), imputation.alias("imputation"), kind.alias("statistical_type"), F.when(windowed, 30).alias("window_days"), F.lit(86400).alias("lag_seconds"), F.least(F.col("quality") * 1.2, F.lit(1.0)).alias("confidence"))


def readiness(profile: DataFrame, require_temporal: bool = False, least_n: int = 30, max_distinct: int = 1000) -> DataFrame:
    """profile with `problems` (errors), `warnings`, `suggestions` and `ready`: profile(field, n, quality, missing_rate, std_samp, distinct, temporal, inferred)."""
    some = lambda *x: F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in x]), lambda y: y.isNotNull())
    out = profile.withColumns({
        "problems": some((F.col("n") < least_n, "too few samples"), (F.col("quality") < 0.3, "low quality"), (F.col("missing_rate") > 0.95, "mostly missing"), (F.col("distinct") > max_distinct, "too many categories"),
                         *([(~F.col("temporal"), "no updates in time")] if require_temporal else []), (F.col("inferred") == "unknown", "unknown type")),
        "warnings": some((F.col("std_samp") < 1e-10, "constant")),
        "suggestions": some((F.col("distinct") > max_distinct / 2, "bucket rare categories"), ((F.col("quality") >= 0.3) & (F.col("quality") < 0.5), "improve quality")),
    })
    return out.withColumn("ready", F.size("problems") == 0)


def encoding(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """value, code: ordinals of a column's most frequent values; the code after the last stands for all others."""
    top = top_values(df, [column], most).select("value", (F.col("rank") - 1).alias("code"))
    rest = top.agg(F.lit("__unknown__").alias("value"), (F.coalesce(F.max("code"), F.lit(-1)) + 1).cast("int").alias("code"))
    return top.unionByName(rest)


def mode_column(value: Column) -> Column:
    """The most frequent value, the least of tied ones."""
    return F.mode(value, True)


def json_kinds(records: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """field, type (string, numeric, boolean, mixed, or unknown if it never has a value) and missing, over JSON objects."""
    v = F.try_parse_json(column)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    each = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(kind(f), F.lit("VOID")).alias("kind")) for f in fields])).alias("k")).select("k.*")
    text, truth = F.col("kind") == "STRING", F.col("kind") == "BOOLEAN"
    s = each.groupBy("field").agg(F.coalesce(F.bool_or(text), F.lit(False)).alias("t"), F.coalesce(F.bool_or(truth), F.lit(False)).alias("b"), F.coalesce(F.bool_or(~text & ~truth), F.lit(False)).alias("n"), F.count_if(F.col("kind").isNull()).alias("missing"))
    several = F.col("t").cast("int") + F.col("b").cast("int") + F.col("n").cast("int")
    return s.select("field", F.when(several == 0, "unknown").when(several > 1, "mixed").when(F.col("t"), "string").when(F.col("b"), "boolean").otherwise("numeric").alias("type"), "missing")
