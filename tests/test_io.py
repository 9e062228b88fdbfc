"""Readers, writers and streams on files made here, and the entry points."""

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relations
from tidemark.sources import readers, sinks
from tidemark.streaming import streams


def test_delimited_sniffs_and_normalises(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("First Name;Age \n Ann ; 3\nBob;\n")
    got = readers.read_delimited(spark, str(p))
    assert got.columns == ["first_name", "age"] and [tuple(r) for r in got.collect()] == [("Ann", "3"), ("Bob", None)]


def test_fixed_width(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("12345abc\n\n99\n")
    assert [tuple(r) for r in readers.read_fixed_width(spark, str(p), [("id", 0, 5), ("name", 5, 3)]).collect()] == [("12345", "abc"), ("99", "")]


def test_clean_names(spark):
    assert readers.clean_names(spark.createDataFrame([(1, 2, 3)], "`A-b c` int, `a.b_c` int, `x!` int")).columns == ["a_b_c", "a_b_c_1", "x"]


def test_uploads():
    assert readers.upload_problems("a.csv", 10, "text/csv; charset=utf-8") == []
    assert len(readers.upload_problems("a.exe", 60 << 20, "x/y")) == 2 and readers.upload_problems("a.xlsx", 1, "text/csv")
    assert readers.kind_of("/x/FMC_Census_1.csv") == "census"
    with pytest.raises(ValueError):
        readers.kind_of("other.csv")


def test_zip_and_folder(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n")
        z.writestr("x.bin", "no")
    got = readers.unzipped(spark, str(tmp_path / "a.zip")).orderBy("line").collect()
    assert [(r["member"], r["line"], r["value"]) for r in got] == [("x.csv", 1, "a,b"), ("x.csv", 2, "1,2")]
    (tmp_path / "one.csv").write_text("k,v\n1,2\n")
    (tmp_path / "two.csv").write_text("k,v\n3,4\n")
    assert {(r["k"], r["file"]) for r in readers.read_folder(spark, str(tmp_path)).collect()} == {("1", "one.csv"), ("3", "two.csv")}
    assert readers.latest_file(spark, str(tmp_path), "*.csv").endswith(".csv")


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t> Ann </t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Age</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c><c r="C2"><v>9</v></c></row></sheetData></worksheet>')
    got = readers.sheet_table(readers.read_sheet(spark, str(tmp_path / "a.xlsx"))).collect()
    assert [(r["Name"], r["Age"]) for r in got] == [("Ann", "3")]


def test_paged_json(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"p{i}.json").write_text('{"data": {"items": [{"id": "%d", "timestamp": "2024-01-01T00:00:00Z"}, {"x": 1}]}}' % i)
    readers.register(spark)
    rows = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", 2).option("path", "data.items").load()
    got = readers.object_events(rows).collect()
    assert len(got) == 4 and {r["entity_id"] for r in got} >= {"1", "2"}


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", "r1", "1", "x" * 20, 1), ("a", "r2", "2", "y", 2), ("b", "r1", "3", "z", 3)], "kind string, run_id string, id string, payload string, created_at int")
    assert sinks.export(frame, str(tmp_path / "e"), ("csv", "json", "none")) == {"csv": "written", "json": "written", "none": "KeyError: 'none'"}
    sinks.append_artifacts(frame, str(tmp_path / "l"))
    assert [r["id"] for r in sinks.read_artifacts(spark, str(tmp_path / "l"), "a", limit=1).collect()] == ["2"]
    hot, cold = sinks.tiered(frame, "payload", 10)
    assert hot.where("payload LIKE 'blob:%'").count() == cold.count() == 1
    good, bad = sinks.rejected(frame, {"small": F.length("payload") < 10, "kind": F.col("kind") == "a"})
    assert good.count() == 1 and {tuple(r["broken"]) for r in bad.collect()} == {("small",), ("kind",)}


def test_tables_of_a_database(spark):
    """The embedded database that comes with Spark."""
    url, driver = "jdbc:derby:memory:tidemark;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(i if i % 10 else None, f"r{i}", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(100)], "id long, name string, at timestamp")
    rows.write.format("jdbc").options(url=url, dbtable="items", driver=driver).mode("overwrite").save()
    for column in ("id", "at"):
        got = readers.read_table(spark, url, "items", column, 7, driver=driver)
        assert got.rdd.getNumPartitions() == 7 and sorted(r["name"] for r in got.collect()) == sorted(f"r{i}" for i in range(100))
    plan = readers.read_table(spark, url, "items", "id", 7, driver=driver).where("id > 90")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ID,90)" in plan.replace("id", "ID")
    assert readers.read_table(spark, url, "items", driver=driver).count() == readers.read_table(spark, url, "(SELECT * FROM items) picked", "id", driver=driver).count() == 100
    empty = readers.read_table(spark, url, "(SELECT * FROM items WHERE 1 = 0) picked", "id", driver=driver)
    assert empty.count() == 0


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    return streams.events(spark, str(tmp_path), spark.createDataFrame([], schema).schema)


def test_stream_windows_and_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("u", t + timedelta(minutes=m), "c", 1.0) for m in (0, 10, 70, 75)] + [("u", t + timedelta(days=3), "c", 1.0)]
    s = stream(spark, tmp_path, rows, "user_id string, ts timestamp, event_type string, value double")
    got = streams.completed(streams.bucketed(s, "hour"), spark, "t_hours").collect()
    assert sorted((r["bucket"].hour, r["n"]) for r in got if r["bucket"].day == 1) == [(0, 2), (1, 2)]
    runs = streams.completed(streams.sessions(s), spark, "t_sessions").collect()
    assert sorted(r["n"] for r in runs)[:2] in ([1, 2], [2, 2])


def let_through(spark, frame, name, stale=None):
    with streams.stateful(spark):
        return streams.completed(streams.released(frame, stale), spark, name).collect()


def test_stream_release(spark, tmp_path):
    rows = [("s", "b", "a"), ("s", "c", "b"), ("s", "a", None), ("s", "d", "x"), ("t", "b", "a")]
    got = let_through(spark, stream(spark, tmp_path, rows, "scope string, id string, waits_for string"), "t_release")
    assert sorted((r["scope"], r["id"]) for r in got) == [("s", "a"), ("s", "b"), ("s", "c")]


def test_stream_release_over_many_batches(spark, tmp_path):
    """Items wait for one that comes batches later; chains and crowds are let through once."""
    schema = "scope string, id string, waits_for string"
    for n in range(6):
        items = [("s", f"{n}-{i}", f"{n + 1}-{i}" if n < 5 else None) for i in range(40)] + [("s", f"crowd-{n}-{i}", "late") for i in range(30)] + [("t", f"{n}", None)]
        stream(spark, tmp_path, items + ([("s", "late", None)] if n == 4 else []), schema)
    frame = streams.events(spark, str(tmp_path), spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1")
    got = [(r["scope"], r["id"]) for r in let_through(spark, frame, "t_release_many")]
    assert len(got) == len(set(got)) == 6 * 40 + 6 * 30 + 6 + 1


def reached(batches):
    """What comes through: a plain loop over all items, batch after batch."""
    done, items = set(), []
    for batch in batches:
        items, before = items + batch, None
        while before != len(done):
            before = len(done)
            done |= {(s, i) for s, i, need in items if need is None or (s is not None and (s, need) in done)}
    return sorted(done, key=repr)


def test_whole_release_of_chains_circles_and_crowds(spark, tmp_path):
    """Over batches: long chains either way, circles, repeated items, ids with several needs, crowds, nulls; scopes are apart."""
    chain = [("s", f"c{i}", f"c{i - 1}" if i else None) for i in range(37)]
    batches = [
        chain[1::2] + [("s", "x", "y"), ("s", "y", "z"), ("s", "z", "x"), ("s", "m", "never"), ("s", "m2", "m"), ("s", "m3", "m2"), ("t", "c1", "c0"), (None, "n", None), (None, "n2", "n")],
        chain[:0:-2] + [("s", f"w{i}", "late") for i in range(30)] + [("s", "m", "late"), ("s", "z", "w3"), ("t", "c1", "c0"), ("s", None, None), ("s", "self", "self")],
        [("s", "c0", None), ("s", "late", "c36"), ("s", "late", "c36")],
        [("s", "c5", None), ("s", "end", "m3"), ("s", "x", None), ("t", "c0", "c9")],
    ]
    schema = "scope string, id string, waits_for string"
    for rows in batches:
        stream(spark, tmp_path, rows, schema)
    frame = streams.events(spark, str(tmp_path), spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1")
    got = [tuple(r) for r in streams.released_whole(frame, spark, "t_whole").collect()]
    assert sorted(got, key=repr) == reached(batches) and len(got) == len(set(got)) > 70


def test_release_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds, of = [], streams.stored
    monkeypatch.setattr(streams, "stored", lambda df: rounds.append(1) or of(df))
    items = spark.createDataFrame([("s", str(i), str(i - 1) if i else None) for i in range(200)], "scope string, id string, waits_for string")
    through, left = streams.let_through(items, items.limit(0))
    assert through.count() == 200 and left.isEmpty() and len(rounds) <= 3 + 3 * 9


def test_stale_scopes_are_forgotten(spark, tmp_path):
    t, schema = datetime(2024, 1, 1), "scope string, id string, waits_for string, ts timestamp"
    batches = [[("old", "a", None, t), ("old", "b", "late", t), ("new", "b", "late", t)], [("new", "x", None, t + timedelta(minutes=20)), ("other", "y", None, t + timedelta(minutes=20))],
               [("new", "x2", None, t + timedelta(minutes=45)), ("other", "z", None, t + timedelta(minutes=45))], [("other", "w", None, t + timedelta(minutes=46))], [("old", "late", None, t + timedelta(minutes=47)), ("old", "c", "a", t + timedelta(minutes=47)), ("new", "late", None, t + timedelta(minutes=47))]]
    for rows in batches:
        stream(spark, tmp_path, rows, schema)
    frame = streams.events(spark, str(tmp_path), spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1").withWatermark("ts", "0 seconds")
    got = {(r["scope"], r["id"]) for r in let_through(spark, frame, "t_stale", 30)}
    assert {("new", "b"), ("new", "late"), ("old", "a"), ("old", "late")} <= got  # the new scope still knew what waits
    assert ("old", "b") not in got and ("old", "c") not in got  # the old one had forgotten what waited, and what had come


def test_stream_sequence(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1, 0, i % 7), i) for i in range(30)]
    got = streams.completed(streams.sequenced(stream(spark, tmp_path, rows, "session_id string, ts timestamp, event_id long")), spark, "t_sequence").collect()
    order = [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert {r["event_id"]: r["seq"] for r in got} == {i: n + 1 for n, i in enumerate(order)}


def test_drift_guard_parts_batches(spark, tmp_path):
    base = spark.createDataFrame([(float(i % 50), f"k{i % 5}") for i in range(400)], "v double, k string")
    kept, apart = [], []
    check = streams.drift_guard(relations.fingerprint(base, ["v", "k"]), ["v", "k"], lambda b, n: kept.append((n, b.count())), lambda b, n: apart.append((n, b.count())))
    check(base, 1)
    check(spark.createDataFrame([(float(i % 50),) for i in range(300)], "v double"), 2)
    assert kept == [(1, 400)] and apart == [(2, 300)]


def test_entry_points():
    import __spark_entry__

    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "entity_id"
