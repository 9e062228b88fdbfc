"""Packing along a space-filling curve.

Each document's tokens are hashed into a vector, projected to three dimensions and given a Hilbert key. Documents in the order
of their keys form one stream that is cut every SEQUENCE tokens: neighbours on the curve, so documents of like tokens, share
sequences, and only the stream's last sequence is padded.

The order is made on small rows (key, row, tokens): a range partitioning sorts them, each partition's total comes to the driver
(one number per partition), and a document's place in the stream is its partition's start plus a running sum. The token ids are
written once, joined with the places and cut; no task sees more than its documents.

Ids are those of the tokenizer's vocabulary file. Most words are encoded once a worker and then looked up: a space between two
characters that aren't white space always begins a new pre-token, so texts are split there. A long run of white space is one
pre-token (without its last character, if a word follows); it is cut out before the coder's pattern, which backtracks over it.

Nulls and empty texts: the final id alone. Repeated rows: each is packed. Null ids are ids like any other. Ties on the curve
(copies) are ordered by row. Very long texts are cut over as many sequences as they need. An empty table gives an empty result.
Extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import keep, mixed, small_batches

SEQUENCE = 1024
BUCKETS = 256
DIMENSIONS, KEY_BITS = 3, 20
#: A worker remembers the ids of so many different words; others are encoded each time.
REMEMBERED = 400_000
#: Runs of white space (Unicode's) that are cut out before the pattern sees them.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


class Encoder(dict):
    """The ids of texts as bytes of 16-bit numbers. As a mapping: from what follows a space to the ids of both."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        # byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the others from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        vocabulary = described["model"]["vocab"]
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in self.special}
        assert max(vocabulary.values()) < 1 << 16
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ordinary(self, text: str) -> list[int]:
        """The ids of a text whose special tokens' strings are plain text."""
        if len(text) < 1000:
            return self.coder.encode_ordinary(text)
        out, at = [], 0
        for run in LONG_BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))  # the last one goes with the word that follows
            out += self.coder.encode_ordinary(text[at : run.start()]) + self.coder._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.coder.encode_ordinary(text[at:])

    def plain(self, text: str) -> bytes:
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        return np.array([i for p in parts for i in ([self.special[p]] if p in self.special else self.ordinary(p))], "<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.ordinary(" " + word), "<u2").tobytes()
        if len(self) < REMEMBERED and len(word) < 40:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if re.search(r"\s | \s", text) or any(s in text for s in self.special):
            return self.plain(text)
        first, *words = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of rows of non-negative integers below 2**bits (the transposed form is untangled bit by bit)."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[n - 1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def projected(vectors: np.ndarray) -> np.ndarray:
    """Rows of hashed token counts as points of the grid: roots of the counts, unit length, fixed random directions."""
    v = np.sqrt(vectors)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    directions = np.random.default_rng(5).standard_normal((vectors.shape[1], DIMENSIONS))
    spread = 0.5 + 0.5 * np.tanh(v @ directions)
    return np.minimum(spread * (1 << KEY_BITS), (1 << KEY_BITS) - 1).astype(np.int64)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key (on the curve), n_tokens and ids (16-bit numbers, the final 0 included) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = encoder(path)
        bucket = (mixed(np.arange(1, e.size + 1, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 1000):
                ids = [(e.ids(t) if t else b"") + b"\0\0" for t in texts[at : at + 1000]]
                vectors = np.stack([np.bincount(bucket[np.frombuffer(i, "<u2")], minlength=BUCKETS) for i in ids]).astype(float)
                keys = hilbert(projected(vectors), KEY_BITS)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(ids)), pa.array(keys), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "n_tokens", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, key bigint, n_tokens bigint, ids binary")


def places(rows: DataFrame) -> DataFrame:
    """row and at (the place of its first token in the stream) of rows(row, key, n_tokens)."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(ends - n), b.column("n_tokens"), pa.array(np.full(len(n), part, np.int32))], ["row", "inside", "n_tokens", "part"])
            at = int(ends[-1]) if len(ends) else at

    ordered = rows.select("row", "key", "n_tokens").repartitionByRange(partitions, "key", "row").sortWithinPartitions("key", "row")
    numbered = keep(ordered.mapInArrow(number, "row bigint, inside bigint, n_tokens bigint, part int"), "places")
    starts, at = [], 0
    for r in sorted(numbered.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts.append((r["part"], at))
        at += r["n"]
    begins = spark.createDataFrame(starts, "part int, begin bigint")
    return numbered.join(F.broadcast(begins), "part").select("row", (F.col("begin") + F.col("inside")).alias("at"))


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents: PIECES, ids as little-endian 32-bit numbers."""
    small_batches(docs.sparkSession)  # ids take four times their place while they are cut
    rows = keep(encoded(docs, path).withColumn("row", F.monotonically_increasing_id()), "ids")
    placed = rows.select("row", "doc_id", "n_tokens", "ids").join(places(rows).hint("shuffle_hash"), "row").select("doc_id", "n_tokens", "ids", "at")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "at")]
            out = []
            for doc_id, n, ids, at in zip(*columns, strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    inside = (at + start) % sequence
                    length = min(n - start, sequence - inside)
                    out.append((doc_id, start, length, wide[4 * start : 4 * (start + length)], n, (at + start) // sequence, inside))
                    start += length
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[i : i + 5000]], k) for j, k in enumerate(kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
