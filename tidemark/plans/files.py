"""Sources and sinks: a table is written in a foreign form, read back through the library, and compared with itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sampling
from tidemark.plans.registry import query, rounded, table
from tidemark.session import scratch
from tidemark.sources import readers, sinks

_ORDERS = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def _typed(df):
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query(_ORDERS)
def source_delimited(spark, d):
    """Text with another delimiter, found by sniffing; names are normalised, cells trimmed."""
    path = scratch(spark, "delimited")
    padded = _orders(spark, d).withColumns({"o_orderstatus": F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))})
    padded.toDF(" O Orderkey", "O OrderStatus", "o totalprice").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, sep=";")
    return _typed(readers.read_delimited(spark, path))


@query(_ORDERS)
def source_fixed_width(spark, d):
    path = scratch(spark, "fixed")
    _orders(spark, d).select(F.format_string("%-12d%-3s%14.2f", "o_orderkey", "o_orderstatus", "o_totalprice").alias("value")).write.text(path)
    return _typed(readers.read_fixed_width(spark, path, [("o_orderkey", 0, 12), ("o_orderstatus", 12, 3), ("o_totalprice", 15, 14)]))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders) GROUP BY 1")
def source_folder(spark, d):
    """A folder of CSV files, read with their names and counted."""
    path = scratch(spark, "folder")
    _orders(spark, d).repartition(4).write.option("header", True).csv(path)
    got = readers.read_folder(spark, path)
    return rounded(_typed(got).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query("SELECT count(*) AS n_rows, 3 AS n_fields FROM orders")
def source_quick_shape(spark, d):
    path = scratch(spark, "shape")
    _orders(spark, d).write.option("header", True).csv(path)
    n, m = readers.quick_shape(readers.read_delimited(spark, path, ","))
    return spark.createDataFrame([(n, m)], "n_rows bigint, n_fields int")


@query("""SELECT o_orderkey::VARCHAR AS entity_id, k AS field_key, CASE k WHEN 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END AS raw FROM orders, (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS k)""")
def source_wide_events(spark, d):
    """Wide to long: an event per entity and column."""
    return readers.wide_events(table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], "2024-01-01").drop("observed_at")


@query("SELECT 'e' || event_id AS entity_id, date_trunc('second', ts) AS observed_at, event_type AS kind FROM events")
def source_object_events(spark, d):
    """JSON objects: an event per object, by its id and time."""
    e = table(spark, d, "events")
    objects = e.select(F.to_json(F.struct(F.concat(F.lit("e"), "event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("kind"))).alias("record"))
    return readers.object_events(objects).select("entity_id", "observed_at", F.get_json_object("payload", "$.kind").alias("kind"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, form FROM orders, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS form)")
def sink_exports(spark, d):
    """One table in four forms, each read back."""
    path = scratch(spark, "export")
    told = sinks.export(_orders(spark, d), path, ("csv", "json", "orc", "parquet"))
    assert set(told.values()) == {"written"}, told
    read = {"csv": lambda p: spark.read.option("header", True).csv(p), "json": spark.read.json, "orc": spark.read.orc, "parquet": spark.read.parquet}
    out = [_typed(read[form](f"{path}/{form}")).withColumn("form", F.lit(form)) for form in read]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS kind FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 50")
def sink_artifacts(spark, d):
    """A ledger by kind, appended to twice; the newest fifty of a kind."""
    path = scratch(spark, "artifacts")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.lit("run").alias("run_id"), F.col("o_orderkey").cast("string").alias("id"), F.lit("{}").alias("payload"), F.col("o_orderdate").alias("created_at"))
    sinks.append_artifacts(rows.where("id % 2 = 0"), path)
    sinks.append_artifacts(rows.where("id % 2 = 1"), path)
    return sinks.read_artifacts(spark, path, "F", "run", 50).select("id", "kind")


@query("""SELECT page_id, strlen(html) AS bytes, CASE WHEN strlen(html) > 2000 THEN 'blob:' || sha256(html) ELSE sha256(html) END AS body FROM pages WHERE html IS NOT NULL""")
def sink_tiers(spark, d):
    """Large payloads go to a table of their own; hot rows keep their hash, and the payload is found by it again."""
    pages = table(spark, d, "pages").where("html IS NOT NULL").select("page_id", "html")
    hot, cold = sinks.tiered(pages, "html", 2000)
    whole = hot.join(cold.select(F.concat(F.lit("blob:"), "blob").alias("html"), F.col("html").alias("body")), "html", "left")
    large = F.col("body").isNotNull()
    return whole.select("page_id", F.octet_length(F.when(large, F.col("body")).otherwise(F.col("html"))).cast("bigint").alias("bytes"), F.when(large, F.col("html")).otherwise(F.sha2("html", 256)).alias("body"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 500000 >= 0.4 AND o_totalprice >= 100000 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY")
def sink_gate(spark, d):
    """What the gate lets through, within the retention time."""
    o = table(spark, d, "orders")
    passed = sinks.passed_only(o, F.col("o_totalprice") / 500000, F.col("o_totalprice"), 0.4, 100000.0)
    last = o.agg(F.max("o_orderdate").alias("now"))
    return sinks.unexpired(passed.crossJoin(F.broadcast(last)), "o_orderdate", F.col("now"), 400).select("o_orderkey")  # one row


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 50000 THEN 'small' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders WHERE NOT (o_totalprice > 50000 AND o_orderstatus IN ('F', 'O'))""")
def sink_rejected(spark, d):
    o = table(spark, d, "orders")
    return sinks.rejected(o, {"small": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus").isin("F", "O")})[1].select("o_orderkey", F.concat_ws(",", "broken").alias("broken"))


@query("SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def sink_ordered_json(spark, d):
    """A JSON array per group, in order, and parsed again."""
    rows = sinks.ordered_json(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"])
    parsed = F.from_json("rows", "array<struct<n_nationkey:int,n_name:string>>")
    return rows.select("n_regionkey", F.concat_ws(",", F.transform(parsed, lambda x: F.concat_ws(":", x["n_nationkey"].cast("string"), x["n_name"]))).alias("nations"))


@query("SELECT 'entity_' || (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS entity_id, o_orderkey FROM orders")
def synthetic_entity(spark, d):
    """Ids for rows that have none, by their place."""
    return sampling.numbered(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select(F.concat(F.lit("entity_"), F.col("__i").cast("string")).alias("entity_id"), "o_orderkey")
