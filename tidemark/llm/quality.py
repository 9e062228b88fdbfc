r"""Quality rules, with lines that many documents of a host share.

Lines are normalised (ASCII lower case, white-space runs as one space) and hashed. For each host (`source`) and line the
distinct documents are counted; copies of one text are one document. A line above the limits (LEAST documents and a SHARE of
the host's distinct documents) is boilerplate: good() removes it, and a document is rejected if too few of its words remain.
Base rules (length, repeated word windows) reject on their own.

Nulls and empty texts: no words, rejected as too short. A null host is a host of its own. Repeated rows: each gets its
verdict, as copies they count once. Very long texts are taken whole. An empty table gives an empty result. Extra columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import keep, lookup, row_key, small_batches

#: A line is boilerplate in a host if it is in more documents than LEAST and than SHARE of the host's.
LEAST = 10
SHARE = 0.05
#: A document is depleted if fewer than this share of its words is left.
LEFT = 0.3
#: Up to so many boilerplate lines go to the tasks by broadcast; more are joined by a shuffle.
BROADCAST_LINES = 500_000

# The symbols that count.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hashes and word counts of the distinct normalised lines."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    data = text.encode()
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    hashes: list[int] = []
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    n_dup = 0
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        hashes += [digest(w) for w in words]
        if line in seen:
            n_dup += 1
        seen.add(line)
        key = digest(b" ".join(words).lower())
        lines[key] = lines.get(key, 0) + len(words)
    n = len(hashes)
    n_repeat = 0
    if n >= 3:
        h = np.array(hashes, np.uint64)
        # the words of a window are told apart by a mix of their hashes
        w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        n_repeat = int(covered.sum())
    return n, word_chars, n_symbols, n_dup, n_repeat, list(lines), list(lines.values())


MEASURED = "doc_id bigint, __id bigint, __hash bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, words array<int>"


def measured(docs: DataFrame) -> DataFrame:
    """The measures of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [measure(t or "") for t in b.column("text").to_pylist()]
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            lines = pa.array([np.array(r[5], np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "__id", "__hash", "host")), *numbers, lines, pa.array([r[6] for r in rows], pa.list_(pa.int32()))], [x.split()[0] for x in MEASURED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEASURED)


def boilerplate(rows: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host (null as a marked string), line: the lines above the limits, of measured rows."""
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("null")).alias("host")
    distinct = rows.select(host, "__hash", "lines").dropDuplicates(["host", "__hash"])
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    freq = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    freq = keep(freq, "lines")
    return lookup(freq, sizes, ["host"], freq.count()).where(F.col("n") > F.col("docs") * share).select("host", "line")


def judged(docs: DataFrame, least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, __id, __hash, the measures, n_removed_words, cut (hashes of the boilerplate lines or null), base_failed and kept of every row."""
    rows = keep(measured(docs).withColumn("row", F.monotonically_increasing_id()), "measures")
    bad = keep(boilerplate(rows, least, share), "boilerplate").withColumn("bad", F.lit(True))
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("null")).alias("host")
    lines = rows.select("row", host, F.explode(F.arrays_zip("lines", "words")).alias("l")).select("row", "host", F.col("l.lines").alias("line"), "l.words")
    n_bad = bad.count()
    if n_bad <= BROADCAST_LINES:
        hit = lines.join(F.broadcast(bad), ["host", "line"])
    else:
        lines = keep(lines, "document-lines")
        hit = lookup(lines, bad, ["host", "line"], lines.count(), "inner")
    removed = hit.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("cut"))
    out = rows.drop("lines", "words").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words") - F.col("n_removed_words") >= left * F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def without(text: str, cut: set[int]) -> str:
    """The text without its lines whose normalised hash (as measure() has it) is in cut, signed; the other lines stay as they are."""
    import xxhash

    kept = []
    for line in text.encode().split(b"\n"):
        words = line.split()
        h = xxhash.xxh3_64_intdigest(b" ".join(words).lower()) if words else 0
        if not words or (h - (1 << 64) if h >> 63 else h) not in cut:
            kept.append(line)
    return b"\n".join(kept).decode()


def good(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, and their texts without the host's boilerplate lines; n_chars follows.

    Nulls, empty and too short texts are rejected, of repeated rows all or none; an empty table stays empty; other columns, of
    whatever names, stay as they are."""
    small_batches(docs.sparkSession)
    host = lambda c: F.coalesce(F.concat(F.lit("h"), c), F.lit("null")).alias("__host")
    found = judged(docs).where("kept").select(host(F.col("host")), "__id", "__hash", "cut").dropDuplicates(["__host", "__id", "__hash"])
    keyed = docs.select(F.struct("*").alias("kept"), *row_key(docs), host(F.col("source").cast("string")))  # a struct, as docs may have columns of any name
    met = keyed.join(found.hint("shuffle_hash"), ["__host", "__id", "__hash"]).select("kept", "cut")
    names = docs.columns

    def cleaned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            columns = dict(zip(names, b.column("kept").flatten(), strict=True))
            texts = [without(t, set(c)) if c else t for t, c in zip(columns["text"].to_pylist(), b.column("cut").to_pylist(), strict=True)]
            if "n_chars" in columns:
                sizes = [len(t) if c else n for t, c, n in zip(texts, b.column("cut").to_pylist(), columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return met.mapInArrow(cleaned, docs.schema)
