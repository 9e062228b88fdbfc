"""Grids, fills, lags, trends and stability over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import merge, temporal
from tidemark.plans.registry import query, rounded, table


def _events(spark, d):
    return table(spark, d, "events").withColumn("series", F.col("event_type"))


_HOURS = """g0 AS (SELECT epoch(date_trunc('{0}', min(ts)))::BIGINT AS s FROM events), b AS (SELECT event_type AS series, s + floor((epoch(ts) - s) / {1})::BIGINT * {1} AS bucket, {2} AS value FROM events, g0 GROUP BY 1, 2),
r AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b), g AS (SELECT series, unnest(range(lo, hi + 1, {1}))::BIGINT AS bucket FROM (SELECT DISTINCT series FROM b), r), f AS (SELECT g.series, g.bucket, b.value FROM g LEFT JOIN b USING (series, bucket))"""
_HOURLY = _HOURS.format("hour", 3600, "sum(value)")
_DAILY = _HOURS.format("day", 86400, "count(value)::DOUBLE")


def _hourly(spark, d):
    return temporal.gridded(temporal.bucketed(_events(spark, d), "hour"), "hour")


def _daily(spark, d):
    """series, idx, value: events a day."""
    g = temporal.filled(temporal.gridded(temporal.bucketed(_events(spark, d), "day", "count"), "day"), "zero")
    return g.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("bucket")))


_IDX = "p AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY bucket) AS idx, coalesce(value, 0) AS value FROM f)"


@query(f"WITH {_HOURLY} SELECT series, bucket, round(coalesce(value, 0), 4) AS value FROM f")
def grid_zero(spark, d):
    return rounded(temporal.filled(_hourly(spark, d), "zero").select("series", "bucket", "value"), digits=4)


@query(f"WITH {_HOURLY} SELECT series, bucket, round(coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS value FROM f")
def grid_forward(spark, d):
    return rounded(temporal.filled(_hourly(spark, d), "forward").select("series", "bucket", "value"), digits=4)


@query(f"WITH {_HOURLY} SELECT series, bucket, round(coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 4) AS value FROM f")
def grid_backward(spark, d):
    return rounded(temporal.filled(_hourly(spark, d), "backward").select("series", "bucket", "value"), digits=4)


@query(f"WITH {_HOURLY} SELECT series, bucket, round(coalesce(value, avg(value) OVER (PARTITION BY series ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS value FROM f")
def grid_mean(spark, d):
    return rounded(temporal.filled(_hourly(spark, d), "mean").select("series", "bucket", "value"), digits=4)


@query(f"""WITH {_HOURLY}, n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS l, first_value(value IGNORE NULLS) OVER a AS r, max(CASE WHEN value IS NOT NULL THEN bucket END) OVER b AS lt, min(CASE WHEN value IS NOT NULL THEN bucket END) OVER a AS rt FROM f
WINDOW b AS (PARTITION BY series ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT series, bucket, round(coalesce(value, l + (r - l) * (bucket - lt) / (rt - lt)), 4) AS value FROM n""")
def grid_linear(spark, d):
    return rounded(temporal.filled(_hourly(spark, d), "linear").select("series", "bucket", "value"), digits=4)


@query()
def grid_spline(spark, d):
    return rounded(merge.gap_filled(_hourly(spark, d), "spline").select("series", "bucket", "value"), digits=4)


@query(f"WITH {_HOURLY} SELECT series, count(*) AS points, round(avg((value IS NULL)::INT), 6) AS gap_ratio FROM f GROUP BY 1")
def gap_ratio(spark, d):
    return rounded(temporal.gap_ratio(_hourly(spark, d)))


def _click_purchase(spark, d):
    g = temporal.filled(_hourly(spark, d), "zero")
    wide = g.groupBy("bucket").agg(F.max(F.when(F.col("series") == "click", F.col("value"))).alias("x"), F.max(F.when(F.col("series") == "purchase", F.col("value"))).alias("y"))
    return wide.withColumn("idx", F.row_number().over(Window.orderBy("bucket")))  # a row an hour


_LAGS = f"""{_HOURLY}, w AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS idx, max(coalesce(value, 0)) FILTER (series = 'click') AS x, max(coalesce(value, 0)) FILTER (series = 'purchase') AS y FROM f GROUP BY bucket),
l AS (SELECT lag, count(*) AS n, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.y) > 0 THEN corr(a.x, b.y) ELSE 0 END AS r FROM w a, (SELECT unnest(range(-10, 11))::INT AS lag), w b WHERE b.idx = a.idx + lag GROUP BY lag)"""


@query(f"WITH {_LAGS} SELECT lag, n, round(r, 6) AS r FROM l")
def lag_correlation(spark, d):
    return rounded(temporal.lagged(_click_purchase(spark, d), 10))


@query(f"WITH {_LAGS} SELECT lag, n, round(r, 6) AS r, CASE WHEN abs(r) < 0.3 THEN 'no_relationship' WHEN lag = 0 THEN 'simultaneous' WHEN lag BETWEEN 1 AND 3 THEN 'source_leads_short' WHEN lag > 3 THEN 'source_leads_long' ELSE 'target_leads' END AS direction FROM l ORDER BY round(abs(r), 12) DESC, abs(lag), lag LIMIT 1")
def causal_lead(spark, d):
    return rounded(temporal.causal_lead(_click_purchase(spark, d), 10, p_value=False).drop("z"), "r")


@query("""WITH g AS (SELECT user_id, row_number() OVER w - 2 AS k, (epoch(ts) - epoch(lag(ts) OVER w)) / 86400 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, count(*) AS n, avg(gap) AS mean_gap, coalesce(CASE WHEN count(*) > 1 THEN regr_slope(gap, k) END, 0) AS slope, regr_sxx(gap, k) AS sxx, regr_syy(gap, k) AS syy, regr_sxy(gap, k) AS sxy FROM g WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
e AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / n / sxx) AS error FROM s), z AS (SELECT *, CASE WHEN error > 1e-12 THEN slope / error WHEN abs(slope) > 1e-9 THEN sign(slope) * 1e6 ELSE 0 END AS z FROM e)
SELECT user_id, n, round(mean_gap, 5) AS mean_gap, round(slope, 5) AS slope, CASE WHEN abs(z) < 1.6448536269514722 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM z""")
def inactivity_acceleration(spark, d):
    out = temporal.inactivity(table(spark, d, "events"), by=["user_id"], tie=["event_id"], p_value=False)
    return rounded(out.select("user_id", "n", "mean_gap", "slope", "trend"), digits=5)


_ACF = f"""{_DAILY}, {_IDX}, m AS (SELECT series, avg(value) AS m, var_pop(value) AS v, count(*) AS size FROM p GROUP BY 1),
a AS (SELECT a.series, lag, any_value(size) AS size, count(*) AS n, avg((a.value - m) * (b.value - m)) / any_value(v) AS r FROM p a JOIN m USING (series), (SELECT unnest(range(1, 11))::INT AS lag), p b WHERE b.series = a.series AND b.idx = a.idx + lag GROUP BY 1, 2)"""


@query(f"WITH {_ACF} SELECT series, lag, n, round(r, 6) AS r FROM a")
def autocorrelation(spark, d):
    return rounded(temporal.autocorrelation(_daily(spark, d), 10).select("series", "lag", "n", "r"))


@query(f"""WITH {_ACF}, bounds AS (SELECT *, 1.96 * sqrt((1 + 2 * coalesce(sum(r * r) OVER (PARTITION BY series ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / size) AS bound FROM a WHERE lag <= least(10, floor(size / 3))),
k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, lag) AS k FROM bounds WHERE abs(r) > bound) SELECT series, lag, round(r, 6) AS r FROM k WHERE k <= 3""")
def suggested_lags(spark, d):
    return rounded(temporal.suggested_lags(_daily(spark, d)).select("series", "lag", "r"))


@query(f"""WITH {_DAILY}, {_IDX}, s AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM p), w AS (SELECT *, CASE WHEN least(30, floor(n / 3)) < 5 THEN n ELSE least(30, floor(n / 3)) END AS w FROM s),
v AS (SELECT a.series, a.idx, var_pop(b.value) AS v FROM w a JOIN p b ON a.series = b.series AND b.idx BETWEEN a.idx - a.w + 1 AND a.idx WHERE a.idx >= a.w GROUP BY 1, 2)
SELECT series, count(*) AS windows, round(1 / (1 + coalesce(stddev_pop(v) / nullif(avg(v), 0), 0)), 5) AS stability FROM v GROUP BY 1""")
def rolling_stability(spark, d):
    return rounded(temporal.rolling_stability(_daily(spark, d)), digits=5)


@query(f"""WITH {_DAILY}, {_IDX}, s AS (SELECT series, value, idx <= floor(count(*) OVER (PARTITION BY series) / 2) AS first FROM p), v AS (SELECT series, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, var_samp(value) FILTER (first) AS v1, var_samp(value) FILTER (NOT first) AS v2 FROM s GROUP BY 1)
SELECT series, n1, n2, round(greatest(v1, v2) / least(v1, v2), 6) AS f FROM v""")
def variance_halves(spark, d):
    return rounded(temporal.variance_halves(_daily(spark, d), p_value=False).select("series", "n1", "n2", "f"))


@query("""SELECT event_type, count(*) AS n, round(corr(value, epoch(ts) / 86400), 6) AS r, round(regr_slope(value, epoch(ts) / 86400), 6) AS slope FROM events GROUP BY 1""")
def temporal_trend(spark, d):
    return rounded(temporal.trend(table(spark, d, "events"), by=["event_type"]))


@query("""WITH f AS (SELECT event_type AS series, min(epoch(ts)) AS t0, max(epoch(ts)) AS t1 FROM events GROUP BY 1), g AS (SELECT series, t0 + k * 86400 AS t FROM (SELECT *, unnest(range(0, floor((t1 - t0) / 86400)::BIGINT + 1)) AS k FROM f))
SELECT g.series, round(g.t, 3) AS bucket, arg_max(value, struct_pack(a := e.ts, b := e.event_id)) AS value FROM g JOIN events e ON e.event_type = g.series AND epoch(e.ts) <= g.t + 1e-7 GROUP BY 1, 2""")
def resample_carry(spark, d):
    return merge.resampled(_events(spark, d), "day", ties=["event_id"]).withColumn("bucket", F.round("bucket", 3))


@query("""WITH f AS (SELECT event_type AS series, min(epoch(ts)) AS t0, max(epoch(ts)) AS t1 FROM events GROUP BY 1), g AS (SELECT series, t0 + k * 86400 AS t FROM (SELECT *, unnest(range(0, floor((t1 - t0) / 86400)::BIGINT + 1)) AS k FROM f)),
l AS (SELECT g.series, g.t, max(epoch(e.ts)) AS lt, arg_max(value, struct_pack(a := e.ts, b := e.event_id)) AS lv FROM g JOIN events e ON e.event_type = g.series AND epoch(e.ts) <= g.t GROUP BY 1, 2),
r AS (SELECT g.series, g.t, min(epoch(e.ts)) AS rt, arg_min(value, struct_pack(a := e.ts, b := e.event_id)) AS rv FROM g JOIN events e ON e.event_type = g.series AND epoch(e.ts) > g.t GROUP BY 1, 2)
SELECT series, round(t, 4) AS bucket, round(CASE WHEN rt IS NULL OR lt = t THEN lv ELSE lv + (rv - lv) * (t - lt) / (rt - lt) END, 4) AS value FROM l LEFT JOIN r USING (series, t)""")
def resample_linear(spark, d):
    return rounded(merge.resampled(_events(spark, d), "day", linear=True, ties=["event_id"]), digits=4)


@query("""SELECT event_type, count(*) AS n FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5 AND strftime(ts, '%Y-%m-%d') <> '2024-01-15' AND strftime(ts, '%H:%M') BETWEEN '09:00' AND '17:00' GROUP BY 1""")
def business_time(spark, d):
    return merge.business_time(table(spark, d, "events"), holidays=["2024-01-15"], hours=("09:00", "17:00")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT event_type AS k, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_type, count(*) AS n, round(max(value), 4) AS top FROM events JOIN s ON k = event_type WHERE abs(value - m) <= 2 * s GROUP BY 1""")
def outliers_zscore(spark, d):
    return merge.without_outliers(table(spark, d, "events"), ["value"], 2.0, ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('second', ts) ORDER BY event_id DESC) AS k FROM events) SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM k WHERE k = 1 GROUP BY 1""")
def per_second_last(spark, d):
    return merge.per_second(table(spark, d, "events"), "last", ["event_id"], ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH h AS (SELECT user_id, ts, value AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events), s AS (SELECT user_id, avg(abs(r)) FILTER (k <= 3) AS recent, avg(abs(r)) FILTER (k > 3) AS before FROM h GROUP BY 1)
SELECT user_id, round(recent, 6) AS recent, round(before, 6) AS before, round(coalesce((before - recent) / nullif(before, 0), 0), 6) AS "drop" FROM s""")
def silence_acceleration(spark, d):
    from tidemark.operators.evidence import silence_acceleration as run

    return rounded(run(table(spark, d, "events").select("user_id", "ts", F.col("value").alias("r")), ["user_id"]))
