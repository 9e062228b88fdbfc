"""Test settings, findings' worth, legacy scores, JSON kinds and merge reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merge, policy, profile, scoring
from tidemark.plans.registry import query, rounded, table

#: A profile per customer, from its numbers.
_PROFILES = """p AS (SELECT c_custkey, c_custkey % 3 <> 0 AS is_normal, (c_custkey % 11) / 10.0::DOUBLE AS sparsity, (c_custkey % 13) / 12.0::DOUBLE AS noise, (c_custkey % 7) / 10.0::DOUBLE AS autocorr_1, c_custkey % 5 = 0 AS is_categorical, c_custkey % 2 = 0 AS is_stationary,
range(1, (c_custkey % 6)::INT * 4 + 1, 4) AS lags FROM customer)"""


def _profiles(spark, d):
    k = F.col("c_custkey")
    lags = F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i * 4 + 1).cast("int")), lambda v: v < k % 6 * 4 + 1)
    return table(spark, d, "customer").select("c_custkey", (k % 3 != 0).alias("is_normal"), (k % 11 / 10).alias("sparsity"), (k % 13 / 12).alias("noise"), (k % 7 / 10).alias("autocorr_1"), (k % 5 == 0).alias("is_categorical"), (k % 2 == 0).alias("is_stationary"), lags.alias("lags"))


@query(f"""WITH {_PROFILES} SELECT c_custkey, greatest(0.001, CASE WHEN NOT is_normal THEN 0.005 ELSE 0 END, CASE WHEN sparsity > 0.5 OR noise > 0.7 THEN 0.01 ELSE 0 END)::DOUBLE AS alpha, CASE WHEN noise > 0.7 THEN 10000 WHEN sparsity > 0.5 THEN 5000 ELSE 2500 END AS iterations,
NOT is_normal OR is_categorical AS nonparametric, CASE WHEN autocorr_1 > 0.3 THEN 2000 ELSE 0 END AS bootstrap_samples FROM p""")
def validation_settings(spark, d):
    return policy.validation(_profiles(spark, d)).select("c_custkey", "alpha", "iterations", "nonparametric", "bootstrap_samples")


@query(f"""WITH {_PROFILES} SELECT c_custkey, greatest(CASE WHEN noise > 0.7 THEN 10000 WHEN sparsity > 0.5 THEN 5000 ELSE 2500 END, CASE WHEN NOT is_stationary THEN 5000 ELSE 0 END) AS shuffle_rounds,
CASE WHEN NOT is_normal OR (noise <= 0.7 AND sparsity > 0.5) THEN 0.005 ELSE 0.001 END::DOUBLE AS shuffle_alpha, noise <= 0.7 AS early_exit, CASE WHEN is_stationary THEN 0.001 ELSE 0.01 END::DOUBLE AS break_alpha, CASE WHEN sparsity > 0.7 THEN 0.2 ELSE 0.15 END::DOUBLE AS trim,
least(20, CASE WHEN len(lags) > 0 THEN list_max(lags) + 2 ELSE 5 END)::INT AS max_lag, CASE WHEN is_normal THEN 'parametric' ELSE 'nonparametric' END AS direction_test, CASE WHEN noise > 0.8 THEN 2000 ELSE 1000 END AS bootstrap_size,
CASE WHEN autocorr_1 > 0.3 THEN 'block' WHEN is_categorical THEN 'stratified' ELSE 'independent' END AS resampling, CASE WHEN autocorr_1 > 0.3 THEN greatest(5, floor(len(lags) * 1.5)::INT) END AS block_size FROM p""")
def referee_policy(spark, d):
    return policy.referee_policy(_profiles(spark, d)).drop("is_normal", "sparsity", "noise", "autocorr_1", "is_categorical", "is_stationary", "lags")


_FINDINGS = """f AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' causal' WHEN 1 THEN ' forecast' WHEN 2 THEN ' cluster, significant effect' ELSE '' END AS text, (doc_id % 100) / 100.0::DOUBLE AS confidence FROM documents WHERE text IS NOT NULL)"""


def _findings(spark, d):
    k = F.col("doc_id") % 4
    words = F.when(k == 0, " causal").when(k == 1, " forecast").when(k == 2, " cluster, significant effect").otherwise("")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", words).alias("text"), (F.col("doc_id") % 100 / 100).alias("confidence"))


@query(f"""WITH {_FINDINGS} SELECT doc_id, round(greatest(100.0, confidence * 1000.0 * least(strlen(text) / 500.0::DOUBLE, 3.0) * CASE WHEN contains(text, 'causal') OR contains(text, 'correlation') THEN 1.5 WHEN contains(text, 'predict') OR contains(text, 'forecast') THEN 1.3 WHEN contains(text, 'segment') OR contains(text, 'cluster') THEN 1.2 ELSE 1.0 END::DOUBLE), 4) AS opportunity_cost,
round(least(99.99, confidence * 100 * CASE WHEN contains(text, 'strong correlation') OR contains(text, 'significant effect') THEN 1.2 ELSE 1.0 END::DOUBLE), 4) AS leverage, CASE WHEN strlen(text) > 500 THEN 250.0 ELSE 150.0 END::DOUBLE AS price FROM f""")
def finding_worth(spark, d):
    out = _findings(spark, d).withColumns(policy.worth(F.col("text"), F.col("confidence")))
    return rounded(out.select("doc_id", "opportunity_cost", "leverage", "price"), digits=4)


@query("""WITH o AS (SELECT o_orderkey, 'X_' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ' predicts ' WHEN 1 THEN ' leads to ' ELSE ' and ' END || 'STATUS ' || o_orderpriority AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'given' END AS cause, CASE WHEN o_orderkey % 5 = 0 THEN 'known' END AS effect FROM orders)
SELECT o_orderkey, CASE WHEN cause IS NOT NULL THEN cause WHEN o_orderkey % 3 < 2 THEN split_part(text, ' ', 1) ELSE '' END AS cause, CASE WHEN effect IS NOT NULL THEN effect WHEN o_orderkey % 3 < 2 THEN 'STATUS' ELSE '' END AS effect FROM o""")
def cause_and_effect(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("X_"), F.col("o_custkey").cast("string"), F.when(k % 3 == 0, " predicts ").when(k % 3 == 1, " leads to ").otherwise(" and "), F.lit("STATUS "), "o_orderpriority")
    cause, effect = policy.cause_effect(text, F.when(k % 5 == 0, "given"), F.when(k % 5 == 0, "known"))
    return table(spark, d, "orders").select("o_orderkey", cause.alias("cause"), effect.alias("effect"))


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'a tipping point' WHEN 'click' THEN 'path-dependent' ELSE 'linked' END AS s, event_id % 100 / 100.0::DOUBLE AS p, value / 100 AS strength FROM events),
k AS (SELECT *, CASE s WHEN 'a tipping point' THEN 'breakpoint' WHEN 'path-dependent' THEN 'hysteresis' ELSE 'correlation' END AS kind FROM e)
SELECT user_id, round(coalesce(avg(CASE WHEN kind = 'hysteresis' THEN CASE WHEN strength > 0.5 THEN strength * 0.2 END WHEN p < 0.05 THEN (1 - p) * 0.4 END::DOUBLE), 0.5), 6) AS confidence FROM k GROUP BY 1""")
def evidence_confidence(spark, d):
    science = F.when(F.col("event_type") == "view", "a tipping point").when(F.col("event_type") == "click", "path-dependent").otherwise("linked")
    e = table(spark, d, "events").select("user_id", policy.evidence_kind(science, F.lit("")).alias("kind"), (F.col("event_id") % 100 / 100).alias("p"), (F.col("value") / 100).alias("strength"))
    return rounded(policy.overall_confidence(e, ["user_id"]))


@query("""WITH r AS (SELECT user_id AS hypothesis, avg((value > 20)::INT)::DOUBLE AS confidence, count(*) FILTER (value > 20) AS n FROM events GROUP BY 1), s AS (SELECT user_id AS hypothesis, avg((event_type = 'view')::INT)::DOUBLE AS share FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT hypothesis, round(confidence, 6) AS confidence, n > 0 AND coalesce(share, 1) >= 0.3 AS passed FROM r LEFT JOIN s USING (hypothesis)""")
def run_verdict(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "hypothesis")
    stable = e.where("hypothesis % 2 = 0").groupBy("hypothesis").agg(F.avg((F.col("event_type") == "view").cast("double")).alias("share"))
    return rounded(policy.run_verdict(e.select("hypothesis", (F.col("value") > 20).alias("passed")), stable, least=0.3))


@query("""WITH n AS (SELECT max(o_orderdate) AS newest FROM orders), s AS (SELECT o_orderkey, o_custkey % 150 AS fleet, floor(epoch(newest - o_orderdate) / 86400) AS days FROM orders, n)
SELECT o_orderkey, round((CASE WHEN fleet <= 0 THEN greatest(0, 5 - days / 365.25) ELSE (CASE WHEN fleet <= 1 THEN 1 WHEN fleet <= 5 THEN 2 WHEN fleet <= 20 THEN 3 WHEN fleet <= 100 THEN 4 ELSE 5 END + greatest(0, 5 - days / 365.25)) / 2.0 END)::DOUBLE, 6) AS score FROM s""")
def fleet_and_age(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).cast("string").alias("fleet"), F.col("o_orderdate").alias("added"))
    return rounded(scoring.fleet_and_age_score(o, "fleet", "added").select("o_orderkey", "score"))


@query("""WITH n AS (SELECT max(o_orderdate) AS newest FROM orders), s AS (SELECT o_orderkey, o_custkey % 150 AS fleet, floor(epoch(newest - o_orderdate) / 86400) / 365.25::DOUBLE AS years, CASE WHEN o_orderkey % 4 = 0 THEN 2.5 ELSE o_totalprice / 100000 END AS safety FROM orders, n)
SELECT o_orderkey, round(0.3 * CASE WHEN fleet <= 0 THEN 0 WHEN fleet <= 1 THEN 1 WHEN fleet <= 5 THEN 2 WHEN fleet <= 20 THEN 3 WHEN fleet <= 100 THEN 4 ELSE 5 END + 0.2 * greatest(1, 6 - years) + 0.3 * CASE WHEN safety <= 1 THEN 5 WHEN safety <= 2 THEN 4 WHEN safety <= 3 THEN 3 WHEN safety <= 4 THEN 2 ELSE 1 END, 6)::DOUBLE AS score FROM s""")
def legacy_score(spark, d):
    safety = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") / 100000)
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).cast("string").alias("fleet"), F.col("o_orderdate").alias("added"), safety.alias("safety"))
    return rounded(scoring.legacy_score(o, "fleet", "added", "safety").select("o_orderkey", "score"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '000001') AND c_mktsegment = 'BUILDING'")
def city_filter(spark, d):
    return table(spark, d, "customer").where(scoring.in_city(F.col("c_name"), "000001", F.col("c_mktsegment"), "building")).select("c_custkey")


@query("SELECT c_custkey, c_acctbal AS risk_score FROM customer WHERE c_acctbal >= 5000")
def high_risk(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("risk_score"), F.lit("9").alias("rating_text"))
    return scoring.high_risk(c, 5000.0).select("c_custkey", F.col("risk_score").cast("double").alias("risk_score"))


@query("""SELECT * FROM (VALUES ('id', 'numeric', 0::BIGINT), ('kind', 'string', 0), ('late', 'boolean', 0), ('value', 'mixed', (SELECT count(*) FROM events WHERE event_id % 3 = 0))) AS t(field, type, missing)""")
def json_kinds(spark, d):
    """A field's kind over all JSON objects; `value` is a number, a text or missing in turn."""
    k = F.col("event_id") % 3
    value = F.when(k == 1, F.concat(F.lit(', "value": '), F.col("value").cast("string"))).when(k == 2, F.concat(F.lit(', "value": "'), "event_type", F.lit('"'))).otherwise("")
    record = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('", "late": '), (F.hour("ts") > 20).cast("string"), value, F.lit("}"))
    return profile.json_kinds(table(spark, d, "events").select(record.alias("record")), "record", ["id", "kind", "late", "value"])


@query("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT (SELECT count(*) FROM u) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM u) - count(*) AS duplicates, 2 AS n_columns FROM (SELECT DISTINCT * FROM u)""")
def merge_report(spark, d):
    o = table(spark, d, "orders")
    parts = [o.where(f"o_orderkey % {k} = 0").select("o_custkey", "o_orderstatus") for k in (2, 3)]
    whole = merge.union_all(parts)
    return merge.report(parts, whole.distinct())
