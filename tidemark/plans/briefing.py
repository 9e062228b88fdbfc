"""Briefs, intervals, choices of tests, registries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import briefs, evidence, pairs
from tidemark.plans.registry import query, rounded, table


@query("""WITH b AS (SELECT least(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 4 / count(*) OVER ()::DOUBLE), 3) AS a, least(floor((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) * 4 / count(*) OVER ()::DOUBLE), 3) AS b FROM orders),
c AS (SELECT a, b, count(*) AS o FROM b GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(o) AS nb FROM c GROUP BY 1), t AS (SELECT sum(o) AS n FROM c),
g AS (SELECT coalesce(o, 0) AS o, na * nb / n::DOUBLE AS e, n FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN c USING (a, b)),
k AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders)
SELECT 'pearson' AS sense, count(*) AS n, round(corr(o_totalprice, o_custkey), 6) AS effect FROM orders UNION ALL SELECT 'spearman', count(*), round(corr(a, b), 6) FROM k
UNION ALL SELECT 'chi_square', any_value(n)::BIGINT, round(sqrt(sum((o - e) ** 2 / e) / (any_value(n) * 3)), 6) FROM g UNION ALL SELECT 'mutual_information', sum(o)::BIGINT, round(sum(o / n::DOUBLE * log2(o / e)) FILTER (o > 0) / 2, 6) FROM g""")
def all_senses(spark, d):
    return rounded(briefs.senses(table(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"]))


@query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'welch_t' WHEN 'view' THEN 'spearman' WHEN 'purchase' THEN 'mutual_information' WHEN 'error' THEN 'chi_square' ELSE 'cross_correlation' END AS sense, avg(value) / 100 AS score FROM events GROUP BY 1, 2),
w AS (SELECT *, CASE sense WHEN 'mutual_information' THEN 0.25 WHEN 'chi_square' THEN 0.15 ELSE 0.20 END::DOUBLE AS w FROM s)
SELECT user_id, count(*) AS senses, round(sum(score * w) / sum(w), 6) AS confidence, round(CASE WHEN count(*) > 1 THEN 1 - stddev_pop(score) ELSE 0 END, 6) AS consistency FROM w GROUP BY 1""")
def brief_strength(spark, d):
    e = F.col("event_type")
    sense = F.when(e == "click", "welch_t").when(e == "view", "spearman").when(e == "purchase", "mutual_information").when(e == "error", "chi_square").otherwise("cross_correlation")
    return rounded(briefs.strength(table(spark, d, "events").groupBy("user_id", sense.alias("sense")).agg((F.avg("value") / 100).alias("score")), ["user_id"]))


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'pearson' WHEN 'view' THEN 'spearman' ELSE 'mutual_information' END AS sense, count(*) AS n, avg(value) / 400 AS p FROM events GROUP BY 1, 2),
s AS (SELECT user_id, min(n) AS n, coalesce(bool_or(sense = 'mutual_information' AND p < 0.05), false) AS mi, coalesce(bool_or(sense <> 'mutual_information' AND p < 0.05), false) AS lin FROM r GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN n < 30 THEN 'low_sample_size' END, CASE WHEN mi AND NOT lin THEN 'nonlinear_only' END) AS flags FROM s""")
def brief_warnings(spark, d):
    e = F.col("event_type")
    r = table(spark, d, "events").groupBy("user_id", F.when(e == "click", "pearson").when(e == "view", "spearman").otherwise("mutual_information").alias("sense")).agg(F.count(F.lit(1)).alias("n"), (F.avg("value") / 400).alias("p"))
    return briefs.warnings(r, ["user_id"]).select("user_id", F.array_join("flags", ",").alias("flags"))


@query("""WITH d AS (SELECT l_extendedprice / 1000 - l_quantity * 1.5 AS d FROM lineitem WHERE l_extendedprice / 1000 <> l_quantity * 1.5), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
s AS (SELECT count(*)::DOUBLE AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM k) SELECT n::BIGINT AS n, round(w, 1) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""")
def signed_ranks(spark, d):
    t = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), (F.col("l_extendedprice") / 1000).alias("a"), (F.col("l_quantity") * 1.5).alias("b"))
    return rounded(rounded(briefs.signed_ranks(t, "a", "b", ["id"], p_value=False), "w", digits=1), "z")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) - 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS low, round(avg(l_quantity) + 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS high FROM lineitem GROUP BY 1")
def mean_interval(spark, d):
    return rounded(briefs.mean_interval(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]))


@query("""WITH c AS (SELECT l_returnflag, count(*)::DOUBLE AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1) SELECT l_returnflag, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS high FROM c""")
def correlation_interval(spark, d):
    p = pairs.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"], p_value=False)
    low, high = pairs.fisher_interval(F.col("r"), F.col("n"))
    return rounded(p.select("l_returnflag", low.alias("low"), high.alias("high")))


@query("SELECT l_returnflag, ceil(2 * ((1.959963984540054 + 0.8416212335729143) / abs(avg(l_discount) * 10)) ** 2)::BIGINT AS rows FROM lineitem GROUP BY 1")
def sample_size(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.avg("l_discount") * 10).alias("e")).select("l_returnflag", briefs.sample_size(F.col("e")).alias("rows"))


@query("""WITH l AS (SELECT r_regionkey::VARCHAR || '|' || r_name AS l FROM region) SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS hash, count(*) AS contracts FROM l""")
def registry_hash(spark, d):
    return briefs.registry_hash(table(spark, d, "region"), ["r_regionkey", "r_name"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (value > 20) AS high FROM events GROUP BY 1, 2")
def daily_metrics(spark, d):
    return rounded(briefs.daily_metrics(table(spark, d, "events"), "ts", {"n": F.count(F.lit(1)), "mean": F.avg("value"), "high": F.count_if(F.col("value") > 20)}, ["event_type"])).withColumn("day", F.col("day").cast("string"))


@query("SELECT p_type, round(avg(strlen(p_name || p_brand)), 6) AS mean_bytes, bool_or(regexp_matches(p_name || p_brand, '[0-9]')) AS has_digits, bool_or(regexp_matches(p_name || p_brand, '[^A-Za-z0-9\\s]')) AS has_specials FROM part GROUP BY 1")
def text_stats(spark, d):
    return rounded(briefs.text_stats(table(spark, d, "part").withColumn("t", F.concat("p_name", "p_brand")), "t", ["p_type"]))


@query("SELECT count(*) AS rows, count(*) FILTER (NOT regexp_matches(o_custkey::VARCHAR, '^[0-9]{1,2}$')) AS invalid, count(o_custkey) - count(DISTINCT o_custkey) AS repeated, 0 AS sparse_columns, count(*) FILTER (NOT regexp_matches(o_custkey::VARCHAR, '^[0-9]{1,2}$')) <= count(*) * 0.1::DOUBLE AS passes FROM orders")
def key_checks(spark, d):
    return briefs.key_checks(table(spark, d, "orders"), "o_custkey", r"^\d{1,2}$")


@query("SELECT o_custkey AS hypothesis, max((o_orderkey % 23) / 200.0::DOUBLE) AS worst_q, max((o_orderkey % 23) / 200.0::DOUBLE) > 0.10::DOUBLE AS reject FROM orders GROUP BY 1")
def early_rejection(spark, d):
    return briefs.noisy(table(spark, d, "orders").select(F.col("o_custkey").alias("hypothesis"), ((F.col("o_orderkey") % 23) / 200).alias("q")), ["hypothesis"])


@query("""WITH e AS (SELECT user_id AS hypothesis, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, avg(value) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1)
SELECT hypothesis, round(0.5 * coalesce(a, 0) + 0.3 * coalesce(b, 0) + 0.2 * coalesce(c, 0), 6) AS score, coalesce(a, 0) >= 0.1 AS gate FROM e""")
def phase_score(spark, d):
    e = F.col("event_type")
    r = table(spark, d, "events").select(F.col("user_id").alias("hypothesis"), F.when(e == "click", "integrity").when(e == "view", "causality").when(e == "purchase", "complexity").otherwise("other").alias("phase"), F.col("value").alias("e"))
    return rounded(evidence.phase_score(r).select("hypothesis", "score", "gate"))


def _tests(spark):
    rows = [("permutation", "SHREDDER", 10.0, 4.0, 0.9), ("transfer_entropy", "DIRECTIONAL", 8.0, 6.0, 0.8), ("chow", "INVARIANCE", 6.0, 1.0, 0.7), ("cusum", "INVARIANCE", 5.0, 1.0, 0.7), ("partial", "ANTI_CONFOUNDER", 6.0, 2.0, 0.8)]
    return spark.createDataFrame(rows, "test string, category string, e double, cost double, reliability double")


@query("""WITH t(test, category, v) AS (VALUES ('permutation', 'SHREDDER', 2.25), ('transfer_entropy', 'DIRECTIONAL', 1.0667), ('chow', 'INVARIANCE', 4.2), ('cusum', 'INVARIANCE', 3.5), ('partial', 'ANTI_CONFOUNDER', 2.4)),
k AS (SELECT c_custkey AS hypothesis, test, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, test) AS rank FROM customer JOIN t ON category IN ('SHREDDER', CASE WHEN c_custkey % 2 = 0 THEN 'INVARIANCE' ELSE 'DIRECTIONAL' END)) SELECT hypothesis, rank::INT AS rank, test FROM k WHERE rank <= 1 + c_custkey_mod(hypothesis)""".replace("c_custkey_mod(hypothesis)", "hypothesis % 3"))
def test_selection(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("hypothesis"), F.array(F.lit("SHREDDER"), F.when(k % 2 == 0, "INVARIANCE").otherwise("DIRECTIONAL")).alias("categories"), (1 + k % 3).alias("most_tests"))
    return evidence.chosen_tests(p, _tests(spark))


@query("""WITH h AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'A drives B' WHEN 1 THEN 'B comes after A' WHEN 2 THEN 'works via C' ELSE 'A and B' END AS t FROM customer)
SELECT id, CASE WHEN regexp_matches(lower(t), 'cause|lead|drive|impact') THEN 'CAUSAL' WHEN regexp_matches(lower(t), 'lag|delay|follow|after|before') THEN 'TEMPORAL' WHEN regexp_matches(lower(t), 'how|mechanism|through|via') THEN 'MECHANISTIC' ELSE 'ASSOCIATIVE' END AS kind FROM h""")
def hypothesis_kinds(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "A drives B").when(k % 4 == 1, "B comes after A").when(k % 4 == 2, "works via C").otherwise("A and B")
    return table(spark, d, "customer").select(k.alias("id"), evidence.hypothesis_kind(text, F.lit("")).alias("kind"))


@query("""WITH e AS (SELECT user_id AS id, event_type AS name, avg(value) > 20 AS passed, avg(value) / 100 AS p FROM events GROUP BY 1, 2) SELECT name AS referee, count(*) AS uses, round(avg(passed::INT), 6) AS success, round(avg(p), 6) AS mean_p FROM e GROUP BY 1""")
def referee_summary(spark, d):
    return rounded(evidence.referee_summary(_hypotheses(spark, d)))


@query("""WITH e AS (SELECT user_id AS id, event_type AS name, avg(value) > 20 AS passed FROM events GROUP BY 1, 2), h AS (SELECT id, string_agg(name, '+' ORDER BY name) AS combination, bool_and(passed) AS ok FROM e GROUP BY 1)
SELECT combination, count(*) AS uses, round(avg(ok::INT), 6) AS success FROM h GROUP BY 1""")
def referee_combinations(spark, d):
    return rounded(evidence.combination_summary(_hypotheses(spark, d)))


def _hypotheses(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("name")).agg((F.avg("value") > 20).alias("passed"), (F.avg("value") / 100).alias("p"))
    return e.groupBy("id").agg(F.collect_list(F.struct("name", "passed", "p")).alias("referees"))
