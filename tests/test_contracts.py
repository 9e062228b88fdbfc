"""Queries against their SQL on small tables with the rows that the given ones have only at some size."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import cliques, information, neighbours, pairs, profile, relations, sampling
from tidemark.plans import screening


def same_as_sql(spark, name, folder, **tables):
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = catalog.QUERIES[name](spark, str(folder))
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for table in tables:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        told = db.sql(catalog.ORACLE_SQL[name])
        at = [told.columns.index(c) for c in got.columns]
        want = [tuple(r[i] for i in at) for r in told.fetchall()]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def customers(spark, n):
    return spark.range(n).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "cast(id % 25 AS int) AS c_nationkey", "id * 1.5D AS c_acctbal", "'BUILDING' AS c_mktsegment")


def test_split_70_30_rounds_the_share_as_written(spark, tmp_path):
    rows = same_as_sql(spark, "split_70_30", tmp_path, customer=customers(spark, 90))  # 90 * 0.7 is 62.99... in doubles
    assert sum(part == "discovery" for _, part in rows) == 63


def test_stratified_split_rounds_the_share_as_written(spark, tmp_path):
    rows = same_as_sql(spark, "stratified_split", tmp_path, customer=customers(spark, 45))  # 45 * 0.7 is 31.49... in doubles
    assert sum(part == "discovery" for _, _, part in rows) == 32


def leads(spark):
    """Six customers, of whom three have orders."""
    orders = [(i, i % 3, "O", 60_000.0 * (i + 1), datetime(2001, 5, 1 + i), f"{i % 2}-X") for i in range(9)]
    return {"customer": customers(spark, 6), "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")}


def test_lead_score_of_customers_without_orders(spark, tmp_path):
    assert len(same_as_sql(spark, "lead_score", tmp_path, **leads(spark))) == 6


def test_lead_summary_of_customers_without_orders(spark, tmp_path):
    assert same_as_sql(spark, "lead_summary", tmp_path, **leads(spark))


def test_lead_summary_rounds_ties_as_its_sql(spark, tmp_path):
    """320 customers of one tier whose mean safety is 4.0140625: the SQL's way of rounding makes it 4.014062."""
    tables = leads(spark) | {"customer": customers(spark, 4000)}
    scored = same_as_sql(spark, "lead_score", tmp_path, **tables)
    of = {s: [r[0] for r in sorted(scored) if r[3] == s and r[-1] == "High Priority"] for s in (4.0, 4.5, 5.0)}
    picked = of[4.0][:315] + of[4.5][:1] + of[5.0][:4]
    got = same_as_sql(spark, "lead_summary", tmp_path, customer=tables["customer"].where(F.col("c_custkey").isin(picked)).coalesce(1), orders=tables["orders"])
    assert [(r[0], r[1], r[3]) for r in got] == [("High Priority", 320, 4.014062)]


def test_mann_whitney_of_millions(spark, monkeypatch):
    """Two groups of 5 million values in turn: the product of their counts is beyond a long."""
    n = 5_000_000
    sums = spark.createDataFrame([("O", n, float(n * n)), ("F", n, float(n * n + n))], "g string, n long, ranks double")
    monkeypatch.setattr(pairs, "rank_sums", lambda *_: sums)
    got = pairs.mann_whitney(spark.range(1).selectExpr("'O' AS g", "0D AS v", "id"), "v", "g", "O", "F", ["id"], p_value=False).first()
    u = n * n - n * (n + 1) // 2
    assert (got["n1"], got["u"]) == (n, u) and got["z"] == pytest.approx((u - n * n / 2) / (n * n * (2 * n + 1) / 12) ** 0.5)


def test_components_of_groups_need_a_link_per_member(spark, tmp_path):
    """One day with 300 buyers of one amount, and two days that share a buyer: 300 links do what 45,000 pairs would."""
    rows = [(i, datetime(2024, 1, 1), u, "purchase", 5.0 + u % 2 / 4, None) for i, u in enumerate(range(300))]
    rows += [(900 + i, datetime(2024, 1, day), u, "purchase", 9.5, None) for i, (day, u) in enumerate([(2, 1000), (2, 1001), (3, 1001), (3, 1002), (4, 1003)])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert len(same_as_sql(spark, "components", tmp_path, events=events)) == 303
    assert relations.stars(events.withColumn("v", F.floor("value")), ["ts", "v"], "user_id").count() == 301


def test_bootstrap_sizes_are_those_of_the_rounds(spark):
    frame = spark.range(400).selectExpr("id % 300 AS k")  # some keys have two rows
    want = sampling.bootstrap(frame, "k").groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("distinct"))
    got = sampling.bootstrap_sizes(frame, "k")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 10


@pytest.mark.parametrize("name", ["resample_linear", "resample_carry"])
def test_resampling_of_equal_times_goes_by_the_event(spark, tmp_path, name):
    """Each time has 40 events of other values: the SQL takes the last by its number before a grid point and the first after it."""
    rows = [(t * 40 + i, datetime(2024, 1, 1 + t // 2, 12 * (t % 2), 7 * (t % 2)), i, "view", float((i * 7 + t) % 41), None) for t in range(9) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(5, F.hash("value"))
    assert len(same_as_sql(spark, name, tmp_path, events=events)) == 5


def purchases(spark, copies):
    """Purchases of 40 users and of their copies, which have other numbers and buy for the same amounts on the same days."""
    rows = [(i, datetime(2024, 1, 1 + i % 3, i % 24), i * i % 41 + c * 100, "purchase", None if i % 29 == 0 else float(i * 7 % 60)) for c in range(copies) for i in range(240)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


@pytest.mark.parametrize("name", ["blast_radius", "twin_segments"])
def test_links_of_copied_users(spark, tmp_path, name):
    assert len(same_as_sql(spark, name, tmp_path, events=purchases(spark, 3))) > 20


@pytest.mark.parametrize("name", ["blast_radius", "twin_segments"])
@pytest.mark.parametrize("copies, rows", [(1, 64), (3, 2048)])
def test_graphs_by_groups(spark, tmp_path, monkeypatch, name, copies, rows):
    """Users and their copies in one block and in several; the links are not written."""
    monkeypatch.setattr(screening, "LINKS", 0)
    monkeypatch.setattr(screening, "_linked", None)
    monkeypatch.setattr(cliques, "ROWS", rows)
    monkeypatch.setattr(cliques, "AT_ONCE", 64)
    if rows == 64:
        monkeypatch.setattr(cliques, "BYTES", 1 << 11)  # several parts, too
    few = purchases(spark, copies).union(spark.createDataFrame([(900 + i, datetime(2024, 1, 2, i % 24), 500 + i % 140, "purchase", float(i * i % 17)) for i in range(400)], purchases(spark, 1).schema))
    assert len(same_as_sql(spark, name, tmp_path, events=few)) > 20


def test_crowded_graphs_are_searched_by_groups(spark):
    e = lambda n, m: spark.createDataFrame([(i, i % m, 0) for i in range(n)], "user_id long, day int, v int")
    assert screening._crowded(e(100, 5)) and not screening._crowded(e(100, 20)) and not screening._crowded(e(0, 1))


def test_links_do_not_grow_with_copies_of_users(spark, tmp_path):
    counts = []
    for copies in (1, 4):
        purchases(spark, copies).write.parquet(f"{tmp_path}/{copies}/events.parquet")
        edges, weights, kinds = screening._edges(spark, f"{tmp_path}/{copies}")
        counts.append(edges.count())
        assert kinds.count() == copies * weights.count()
    assert counts[0] == counts[1] > 0


@pytest.mark.parametrize("name", ["referee_mutual_information", "referee_conditional_mi"])
def test_information_of_repeated_points(spark, tmp_path, name):
    assert len(same_as_sql(spark, name, tmp_path, events=purchases(spark, 2).dropna())) == 1


def test_equal_points_are_asked_for_once(spark, monkeypatch):
    asked = []
    nearest = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda grid, queries, *a, **k: asked.append(queries.count()) or nearest(grid, queries, *a, **k))
    for copies in (1, 3):
        rows = [("p", c * 40 + i, float(i % 7), float(i)) for c in range(copies) for i in range(40)]
        information.mutual_information(spark.createDataFrame(rows, "pair string, idx long, x double, y double"))
    assert asked == [40, 40]


def test_quartiles_of_repeated_values(spark, tmp_path):
    rows = [("ANR"[i % 3], float(i * i % 37 + i % 3) + 0.25) for i in range(400)]
    assert len(same_as_sql(spark, "distribution_shape", tmp_path, lineitem=spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double"))) == 3
    plan = profile.shape_stats(spark.createDataFrame(rows, "g string, v double"), "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(__v" in plan and "percentile(v" not in plan


def test_stream_release_of_repeated_events(spark, tmp_path):
    """Events that come twice are let through once, as the SQL says; an event's kind parts it from what it waits for."""
    rows = [(i, datetime(2024, 1, 1), i, "view" if i % 35 else "click", 1.0, None) for i in range(120)]
    path = f"{tmp_path}/events.parquet"  # streams read one file of that name
    spark.createDataFrame(rows + rows[::3], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").toPandas().to_parquet(path, coerce_timestamps="us")
    got = [tuple(r) for r in catalog.QUERIES["stream_release"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
        want = db.sql(catalog.ORACLE_SQL["stream_release"]).fetchall()
    assert sorted(got) == sorted(want) and 90 < len(got) < 120
