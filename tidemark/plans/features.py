"""As-of features, profiles, typing and contracts over the events and orders tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import asof, evidence, profile
from tidemark.operators.asof import Contract
from tidemark.plans.registry import query, r, rounded, table

CUTOFF = datetime(2024, 1, 20)
KINDS = ("click", "purchase", "view", "error", "signup")


def observed(spark, d):
    """The events as observations: entity, time, field, value."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("observed_at"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("tie"))


def cohort(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("entity_id")).distinct()


def _one(contract):
    def run(spark, d):
        out = asof.matrix(observed(spark, d), cohort(spark, d), [contract], CUTOFF)
        return out.select("entity_id", r(contract.variable, 4).alias("value"))

    return run


_ASOF = """WITH c AS (SELECT DISTINCT user_id AS entity_id FROM events), e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20')
SELECT entity_id, round(coalesce(v, 0.0), 4) AS value FROM c LEFT JOIN (SELECT user_id AS entity_id, {} AS v FROM e WHERE event_type = '{}' {} GROUP BY 1) USING (entity_id)"""
_WINDOW = "AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY"
query(_ASOF.format("arg_max(value, struct_pack(a := ts, b := event_id))", "purchase", ""), "asof_latest")(_one(Contract("v", "latest_value_as_of", "purchase")))
query(_ASOF.format("count(*)::DOUBLE", "click", _WINDOW), "asof_count_window")(_one(Contract("v", "count_over_window", "click", 7)))
query(_ASOF.format("sum(value)", "purchase", _WINDOW), "asof_sum_window")(_one(Contract("v", "sum_over_window", "purchase", 7)))
query(_ASOF.format("1.0::DOUBLE", "error", ""), "asof_exists")(_one(Contract("v", "exists_as_of", "error")))

CONTRACTS = [Contract("last_purchase", "latest_value_as_of", "purchase"), Contract("clicks_7d", "count_over_window", "click", 7), Contract("spend_14d", "sum_over_window", "purchase", 14), Contract("had_error", "exists_as_of", "error")]


@query("""WITH c AS (SELECT DISTINCT user_id AS entity_id FROM events), e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
a AS (SELECT user_id AS entity_id, arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-13') AS k,
  sum(value) FILTER (event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-06') AS s, max(CASE WHEN event_type = 'error' THEN 1.0 END) AS x FROM e GROUP BY 1)
SELECT entity_id, round(coalesce(p, 0), 4) AS last_purchase, coalesce(k, 0)::DOUBLE AS clicks_7d, round(coalesce(s, 0), 4) AS spend_14d, coalesce(x, 0)::DOUBLE AS had_error FROM c LEFT JOIN a USING (entity_id)""")
def asof_matrix(spark, d):
    return rounded(asof.matrix(observed(spark, d), cohort(spark, d), CONTRACTS, CUTOFF), digits=4)


@query("""WITH k AS (SELECT user_id AS entity_id, ts, event_id, json_extract_string(props, '$.k')::DOUBLE AS v FROM events WHERE ts <= TIMESTAMP '2024-01-20')
SELECT c.entity_id, coalesce(v, 0.0) AS last_k FROM (SELECT DISTINCT user_id AS entity_id FROM events) c LEFT JOIN (SELECT entity_id, arg_max(v, struct_pack(a := ts, b := event_id)) AS v FROM k GROUP BY 1) USING (entity_id)""")
def asof_payload(spark, d):
    raw = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("observed_at"), "props", F.col("event_id").alias("tie"))
    return asof.matrix(asof.payload_events(raw, ["k"], "props"), cohort(spark, d), [Contract("last_k", "latest_value_as_of", "k")], CUTOFF)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template, names, glue=" UNION ALL "):
    return glue.join(template.replace("{c}", c) for c in names)


@query(_union("SELECT '{c}' AS field, count({c}) AS n, count(*) - count({c}) AS n_missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std_samp, min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM lineitem", NUMERIC))
def profile_numeric(spark, d):
    return rounded(profile.numeric_stats(table(spark, d, "lineitem"), NUMERIC), "mean", "std_samp")


@query("""WITH s AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.25) AS q25, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.75) AS q75,
  skewness(l_extendedprice) AS sk, kurtosis_pop(l_extendedprice) AS ku FROM lineitem GROUP BY 1)
SELECT g AS l_returnflag, n, round(mean, 4) AS mean, round(sd, 4) AS std_pop, round(q25, 4) AS q25, round(med, 4) AS median, round(q75, 4) AS q75, round(sk, 6) AS skewness,
  round((ku + 3) * (n - 1) / ((n - 2) * (n - 3)::DOUBLE) + 6 / (n + 1)::DOUBLE + 3, 6) AS kurtosis, round(least(abs(sd / mean) / 2, 1), 6) AS noise,
  (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = s.g AND (l_extendedprice < q25 - 1.5 * (q75 - q25) OR l_extendedprice > q75 + 1.5 * (q75 - q25))) AS outliers FROM s""")
def distribution_shape(spark, d):
    s = profile.shape_stats(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(s, "mean", "std_pop", "q25", "median", "q75", digits=4), "skewness", "kurtosis", "noise").select("l_returnflag", "n", "mean", "std_pop", "q25", "median", "q75", "skewness", "kurtosis", "noise", "outliers")


CATEGORIES = ["l_returnflag", "l_linestatus", "l_linenumber"]
_FREQ = "f AS (" + _union("SELECT '{c}' AS field, {c}::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 2", CATEGORIES) + "), t AS (SELECT field, sum(n)::BIGINT AS total FROM f GROUP BY 1)"


@query(f"""WITH {_FREQ} SELECT field, count(*) AS "distinct", any_value(total) AS total, count(*) / any_value(total)::DOUBLE AS ratio, round(-sum(n / total::DOUBLE * log2(n / total::DOUBLE)), 6) AS entropy,
  round(1 - sum((n / total::DOUBLE) ** 2), 6) AS gini, min_by(value, struct_pack(a := -n, b := value)) AS mode, round(max(n) / any_value(total)::DOUBLE, 6) AS mode_share FROM f JOIN t USING (field) GROUP BY field""")
def profile_cardinality(spark, d):
    return rounded(profile.cardinality(table(spark, d, "lineitem"), CATEGORIES), "entropy", "gini", "mode_share")


@query(f"""WITH {_FREQ}, k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM f) SELECT field, rank::INT AS rank, value, n, round(n / total::DOUBLE, 6) AS share FROM k JOIN t USING (field) WHERE rank <= 3""")
def profile_top_values(spark, d):
    return rounded(profile.top_values(table(spark, d, "lineitem"), CATEGORIES, 3), "share")


@query("""WITH m AS (SELECT user_id, event_id, event_type = 'view' AS missing FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, missing ORDER BY event_id) AS island FROM m),
u AS (SELECT user_id, missing, island, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, round(sum(CASE WHEN missing THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS missing_rate, coalesce(max(n) FILTER (missing), 0) AS longest_run FROM u GROUP BY 1""")
def profile_missing_runs(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return rounded(profile.missing_runs(e, "v", ["event_id"], ["user_id"]), "missing_rate")


@query("""WITH v AS (SELECT 'o_orderkey' AS field, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_totalprice', o_totalprice::VARCHAR FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders)
SELECT field, count(*) AS n, avg((try_cast(v AS DOUBLE) IS NOT NULL)::INT) AS numeric, avg((regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))::INT) AS dates,
  CASE WHEN bool_or(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'numeric' WHEN bool_or(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) THEN 'date' ELSE 'text' END AS type FROM v GROUP BY field""")
def type_inference(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    names = o.columns
    ratios = profile.long(o, names).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(C.parse_number(F.col("value")).isNotNull(), 1.0).otherwise(0.0)).alias("numeric"), F.avg(C.likely_date(F.col("value")).cast("double")).alias("dates"))
    return ratios.join(profile.upload_types(o, names), "field")


@query("""SELECT user_id % 4 AS kind, count(*) AS n, round(sum(CASE user_id % 4 WHEN 0 THEN round(value, 2) WHEN 1 THEN -round(value, 2) WHEN 2 THEN round(value, 2) ELSE NULL END), 4) AS total, count(*) FILTER (user_id % 4 <> 3) AS parsed FROM events GROUP BY 1""")
def coercion_parse(spark, d):
    v = F.round("value", 2).cast("string")
    text = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("$"), v)).when(F.col("user_id") % 4 == 1, F.concat(F.lit("("), v, F.lit(")"))).when(F.col("user_id") % 4 == 2, F.concat(F.lit(" "), v, F.lit("% "))).otherwise(F.concat(F.lit("about "), v))
    parsed = C.parse_number(text)
    return table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(parsed), 4).alias("total"), F.count(parsed).alias("parsed"))


@query("""WITH p AS (SELECT event_type AS field, 'numeric' AS inferred, count(*) AS n, count(*) FILTER (floor(value) % 3 = 0) AS zeros, avg(CASE WHEN floor(value) % 3 = 0 THEN 0 ELSE value END) AS mean, stddev_samp(CASE WHEN floor(value) % 3 = 0 THEN 0 ELSE value END) AS sd FROM events GROUP BY 1)
SELECT field, CASE WHEN zeros / n::DOUBLE >= 0.1 AND sd / (mean + 1e-10) < 2 THEN 'count_over_window' WHEN zeros / n::DOUBLE >= 0.1 AND sd > 0.01 THEN 'sum_over_window' ELSE 'latest_value_as_of' END AS as_of_mode,
  CASE WHEN zeros / n::DOUBLE >= 0.1 THEN 'zero_fill' ELSE 'forward_fill' END AS imputation, 'numeric' AS statistical_type, CASE WHEN zeros / n::DOUBLE >= 0.1 THEN 30 END AS window_days, 86400 AS lag_seconds, 0.96::DOUBLE AS confidence FROM p""")
def contract_synthesis(spark, d):
    v = F.when(F.floor("value") % 3 == 0, 0.0).otherwise(F.col("value"))
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_samp"))
    p = p.withColumns({"inferred": F.lit("numeric"), "missing_rate": F.lit(0.0), "quality": F.lit(0.8), "temporal": F.lit(True)})
    return rounded(profile.contracts(p), "confidence")


@query("""WITH p AS (SELECT event_type AS field, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1) SELECT field, n >= 30 AND u <= 1000 AS ready, (n < 30)::INT + (u > 1000)::INT AS n_problems FROM p""")
def readiness_gate(spark, d):
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("distinct"), F.stddev_samp("value").alias("std_samp"))
    p = p.withColumns({"quality": F.lit(1.0), "missing_rate": F.lit(0.0), "temporal": F.lit(True), "inferred": F.lit("numeric")})
    return profile.readiness(p).select("field", "ready", F.size("problems").alias("n_problems"))


@query("""WITH f AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS code FROM f) SELECT value, code::INT AS code FROM k UNION ALL SELECT '__unknown__', (max(code) + 1)::INT FROM k""")
def categorical_encoding(spark, d):
    return profile.encoding(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS grouping_id, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))""")
def usage_rollup(spark, d):
    return rounded(evidence.usage(table(spark, d, "orders"), [[], ["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]], {"orders": F.count(F.lit(1)), "total": F.sum("o_totalprice")}), "total", digits=2)


@query("""SELECT event_type, count(*) AS n, round(count(*) / 1440.0::DOUBLE, 8) AS per_minute FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1""")
def event_velocity(spark, d):
    return rounded(evidence.velocity(table(spark, d, "events"), "ts", datetime(2024, 1, 10), datetime(2024, 1, 11), ["event_type"]), "per_minute", digits=8)


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 6) AS mean_purchase, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 4) AS error_value FROM events GROUP BY 1""")
def conditional_agg(spark, d):
    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count(of("click")).alias("clicks"), F.round(F.coalesce(F.avg(of("purchase")), F.lit(0.0)), 6).alias("mean_purchase"), F.round(F.sum(F.coalesce(of("error"), F.lit(0.0))), 4).alias("error_value"))


@query("""SELECT entity_col, ok FROM (SELECT 'event_id' AS entity_col, count(DISTINCT event_id) / count(*)::DOUBLE > 0.5 AS ok FROM events)""")
def entity_detection(spark, d):
    e = table(spark, d, "events").drop("user_id")
    name = profile.entity_column(e)
    return spark.createDataFrame([(name or "event_id", name is not None)], "entity_col string, ok boolean")
