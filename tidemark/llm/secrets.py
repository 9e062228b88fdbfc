r"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a file is a row: a path (here doc_id) and a text. Its content address is the text's SHA-256.
The ledger holds the (blob, rule, rule version) triples already scanned; a run scans one copy of each blob for those rules
whose triple is missing, appends findings and ledger rows, and joins findings back to all paths of the blob. A changed
rule (a new version) is scanned over all blobs again, the others are not.

Positions: a text splits at a rule's leftmost non-overlapping matches, so running sums of the lengths of pieces and matches
give each match's span in code points, and in bytes for masking. Running sums are taken in chunks of the root of their number, so a text
of a hundred thousand matches is no matter; masking joins the pieces between spans, which are cut out of the bytes.

Nulls and empty texts: the empty blob, no findings. Repeated rows: each path row gets its blob's findings. Null paths are
paths like any other. Very long texts are scanned whole. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import keep, lookup, new_path


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, the least length, and a cheap pattern that any match contains."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# The base patterns.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
# Rules that add spans: the opening line of a private key.
MORE_RULES = (Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),)

#: start and end in code points, first and last in bytes.
SPANS = "array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"
FINDINGS = f"blob string, kind string, version int, spans {SPANS}"
LEDGER = "blob string, kind string, version int"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for which value is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """An array of longs' running totals by op (a sum, a maximum)."""

    def plain(a: Column) -> Column:
        start = F.struct(F.lit(None).cast("bigint").alias("at"), F.expr("cast(array() AS array<bigint>)").alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = F.coalesce(op(s["at"], x), x)
            return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

        return F.aggregate(a, start, step, lambda s: s["out"])

    def in_chunks(a: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / size) - 1, F.lit(0)).cast("int"))
        return bound(F.transform(starts, lambda k: plain(F.slice(a, k * size + 1, size))), joined)

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("bigint")), plain(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.transform(p, lambda v: F.when(b.isNull(), v).otherwise(op(b, v)))))

    return F.when(F.size(values) == 0, F.expr("cast(array() AS array<bigint>)")).otherwise(bound(values, in_chunks))


def spans_of(text: Column, rule: Rule) -> Column:
    """A rule's spans in a text, as SPANS; empty for a null text."""
    # Only runs of the least length matter for one-class patterns, so those are matched at once.
    pattern = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}.get(rule.kind, rule.pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found, F.length)
    pieces = F.split(text, pattern, -1)
    long = lambda c: c.cast("bigint")

    def placed(m: Column) -> Column:
        gaps = F.slice(m["pieces"], 1, F.size(m["found"]))
        ends = running(F.zip_with(gaps, m["found"], lambda p, x: long(F.length(p) + F.length(x))), lambda x, y: x + y)
        lasts = running(F.zip_with(gaps, m["found"], lambda p, x: long(F.octet_length(p) + F.octet_length(x))), lambda x, y: x + y)
        spans = F.zip_with(F.zip_with(ends, lasts, lambda e, b: F.struct(e.alias("e"), b.alias("b"))), m["found"], lambda z, x: F.struct((z["e"] - F.length(x)).alias("start"), z["e"].alias("end"), (z["b"] - F.octet_length(x)).alias("first"), z["b"].alias("last")))
        enough = F.filter(F.zip_with(spans, m["sized"], lambda s, g: F.struct(s.alias("s"), g.alias("g"))), lambda z: z["g"] >= rule.least)
        return F.transform(enough, lambda z: z["s"])

    matched = F.struct(found.alias("found"), sized.alias("sized"), pieces.alias("pieces"))
    return F.when(text.rlike(rule.hint), bound(matched, placed)).otherwise(F.expr(f"cast(array() AS {SPANS})"))


class Ledger:
    """The scanned triples and the findings, as two tables in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", LEDGER)

    def findings(self) -> DataFrame:
        """One row per blob, kind and version with findings. A run that died between its two appends leaves equal rows."""
        return self._read("findings", FINDINGS).dropDuplicates(["blob", "kind", "version"])

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES + MORE_RULES) -> None:
        """Scans what the ledger lacks of versions(path, blob, text)."""
        blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
        wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        pairs = blobs.select("blob", "path", F.explode(wanted).alias("rule")).select("blob", "path", "rule.kind", "rule.version")
        done = self.scanned()
        todo = pairs if not done.take(1) else pairs.join(done, ["blob", "kind", "version"], "left_anti")
        todo = keep(todo.groupBy("blob", "path").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), "blobs-to-scan")
        texts = versions.alias("v").join(
            todo.alias("t").hint("shuffle_hash"), (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.path"))
        ).select(F.col("t.blob").alias("blob"), "kinds", "text")
        made = texts.select("blob", *[F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r)).alias(r.kind) for r in rules])
        each = F.filter(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules]), lambda x: F.size(x["spans"]) > 0)
        made.select("blob", F.explode(each).alias("f")).select("blob", "f.kind", "f.version", "f.spans").write.mode("append").parquet(f"{self.path}/findings")
        versions_of = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        todo.select("blob", F.explode("kinds").alias("kind")).withColumn("version", versions_of[F.col("kind")]).write.mode("append").parquet(f"{self.path}/scanned")


def versions_of(docs: DataFrame) -> DataFrame:
    """path, blob, text of every row; a null text is the empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def current(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and its findings of the rules' present versions, as an array of (start, order, end, kind, first, last) sorted by start."""
    order = {r.kind: i for i, r in enumerate(rules)}
    wanted = " OR ".join(f"(kind = '{r.kind}' AND version = {r.version})" for r in rules)
    number = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    flat = found.where(wanted).select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number[F.col("kind")].alias("order"), s["end"].alias("end"), F.col("kind").alias("kind"), s["first"].alias("first"), s["last"].alias("last"))).alias("spans"))
    return flat.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def find_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES + MORE_RULES) -> DataFrame:
    """path, blob and spans (as current() has them; null if none) of every row of docs, the ledger brought up to date."""
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or new_path(spark, "blob-ledger"))
    versions = versions_of(docs)
    ledger.scan(versions, rules)
    paths = keep(versions.select("path", "blob"), "paths")
    return lookup(paths, current(ledger.findings(), rules), ["blob"], paths.count())


def digest(found: DataFrame, base: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds and the digest columns."""
    spans = F.coalesce(F.col("spans"), F.expr("cast(array() AS array<struct<start:bigint,order:int,end:bigint,kind:string,first:bigint,last:bigint>>)"))
    said = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kinds = [r.kind for r in base]
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in kinds],  # noqa: B023
        F.sha2(said(F.filter(spans, lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
        said(spans).alias("spans"),
    )


def masked(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """docs with each found span replaced by [KIND], n_chars set anew; other columns and rows as they are."""
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or new_path(spark, "blob-ledger"))
    ledger.scan(versions_of(docs))
    found = keep(current(ledger.findings(), RULES + MORE_RULES), "findings-by-blob")  # so that Spark may split a hot blob
    text = F.col("row.text")
    keyed = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
    joined = keyed.join(found.hint("shuffle_hash"), "blob", "left")

    def replaced(m: Column) -> Column:
        """The pieces between spans, each followed by its span's mark; a span that begins within those before it has none."""
        reach = running(F.transform(m["spans"], lambda s: s["last"]), lambda x, y: F.greatest(x, y))
        before = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), reach), 1, F.size(m["spans"]))
        piece = lambda a, n: F.substring(m["bytes"], (a + 1).cast("int"), n.cast("int")).cast("string")
        mark = lambda s, at: F.when(s["first"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        parts = F.zip_with(m["spans"], before, lambda s, at: F.concat(piece(at, F.greatest(s["first"] - at, F.lit(0))), mark(s, at)))
        return F.concat(F.array_join(parts, ""), bound(F.array_max(reach), lambda last: piece(last, F.octet_length(m["bytes"]) - last)))

    masks = bound(F.struct("spans", text.cast("binary").alias("bytes")), replaced)
    out = joined.withColumn("masked", F.when(F.col("spans").isNull(), text).otherwise(masks))
    changed = {"text": F.col("masked"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("masked"))} if "n_chars" in docs.columns else {"text": F.col("masked")}
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
