r"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments, each searched with a radius, so that fingerprints at 4 or fewer differing bits agree
within a segment's radius in one of them at least (segments of 23, 23 and 18 bits with radii 1, 1 and 0: otherwise they would
differ in 2 + 2 + 1 bits). Which cut is used depends on how many fingerprints there are: long segments have larger balls to
enumerate and fewer strangers in common (segments_for). For each segment the Hamming ball around a fingerprint's value is
enumerated, the table's entries with those values are fetched by a join, and complete distances are verified inside the join.
Values with many entries are split over tasks. Only different fingerprints are joined; copies share theirs. Linked fingerprints
form components (components.py).

Texts that share 80 % of their 5-word shingles differ in 10 of 64 bits as a rule, too far for any table of Hamming balls to
scale. Where that similarity is asked for (one_of_each), resemblance.py adds the links between such texts.

Nulls and texts without words: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is
one shingle. Repeated rows: each gets its row. Null ids: the least non-null id of the component counts; null if there is none.
Very long texts are hashed whole. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .resemblance import BAND, BANDS, shingle_hashes, similar
from .util import hot_from, keep, lookup, mixed, row_key, small_batches

WORDS = 4
DISTANCE = 4
#: Cuts into segments: bits, from the lowest, and radii.
CUTS = (((23, 1), (23, 1), (18, 0)), ((32, 2), (32, 2)))
assert all(sum(bits for bits, _ in cut) == 64 and sum(r + 1 for _, r in cut) > DISTANCE for cut in CUTS)
#: Entries of a segment value with many go to so many tasks.
SPLIT = 64


def ball(bits: int, radius: int) -> list[int]:
    """The differences of a segment's values within the radius."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def segments_for(n: int) -> tuple[tuple[int, int], ...]:
    """The cut with the least work for n fingerprints: probes, and entries that they meet if the values are even."""
    return min(CUTS, key=lambda cut: sum(len(ball(*s)) * (1 + n / 2 ** s[0]) for s in cut))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash: a bit is 1 if set in over half of the hashes; 0 of none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of BAND least values; none of no hashes."""
    if not len(hashes):
        return []
    draw = np.random.default_rng(11)
    a = draw.integers(1, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)
    least = np.full(BANDS * BAND, np.uint64(2**64 - 1))
    distinct = mixed(np.unique(hashes))
    for at in range(0, len(distinct), 2048):
        least = np.minimum(least, (distinct[at : at + 2048, None] * a + b).min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for i, part in enumerate(mixed(least).reshape(BANDS, BAND).T):
        out = mixed(out + part * np.uint64(2 * i + 1))
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int = WORDS, bands: bool = False) -> DataFrame:
    """doc_id, __id, __hash (util.row_key), fp, a signed long, and keys, its bands' if asked for, of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fp, keys = [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes((t or "").encode(), words)
                fp.append(fingerprint(h))
                keys.append(band_keys(h) if bands else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__id"), b.column("__hash"), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "__id", "__hash", "fp", "keys"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, __id bigint, __hash bigint, fp bigint, keys array<bigint>")


def links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """a < b at `distance` or fewer differing bits, for n distinct longs fp."""
    entries, probes, at = [], [], 0
    for number, (bits, radius) in enumerate(segments_for(n)):
        segment = f"(shiftrightunsigned(fp, {at}) & {(1 << bits) - 1}L)"
        entries.append(f"array(struct({number} AS segment, {segment} AS value))")
        probes.append(f"transform(array({', '.join(f'{d}L' for d in ball(bits, radius))}), d -> struct({number} AS segment, {segment} ^ d AS value))")
        at += bits
    table = fps.select("fp", F.explode(F.expr(f"concat({', '.join(entries)})")).alias("k")).select(F.col("fp").alias("b"), "k.segment", "k.value")
    crowded = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from(n)).select("segment", "value", F.lit(SPLIT).alias("parts"))
    crowded = F.broadcast(keep(crowded, "crowded"))  # HOT_SHARE values of each segment at most
    table = table.join(crowded, ["segment", "value"], "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.expr(f"concat({', '.join(probes)})")).alias("k")).select("a", "k.segment", "k.value").join(crowded, ["segment", "value"], "left")
    asked = asked.select("a", F.col("segment").alias("s"), F.col("value").alias("v"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("p"))
    near = (F.col("segment") == F.col("s")) & (F.col("value") == F.col("v")) & (F.col("part") == F.col("p")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return asked.join(table.hint("shuffle_hash"), near).select("a", "b")


def classes(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """component_id (least doc_id) of each fingerprint of prints(doc_id, fp): fp, component (its label), component_id. more: further links(a, b)."""
    own = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    n = own.count()
    near = links(own.select("fp"), n)
    joined = components(near if more is None else near.union(more.select("a", "b")))
    named = lookup(own, joined.withColumnRenamed("node", "fp"), ["fp"], n).select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = keep(named, "named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return lookup(named, first, ["component"], n).select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """doc_id, __id, __hash, fp, component (a label) and component_id of every row; with a similarity, texts that are that alike are linked too."""
    prints = keep(fingerprints(docs, words, similarity is not None), "simhash")
    more = None if similarity is None else similar(prints, docs, words, similarity)
    prints = prints.drop("keys")
    return lookup(prints, classes(prints, more), ["fp"], prints.count())


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: that of the least id (null counts last; of equal ids, that with the least hash).

    Each component keeps a row, so unlike texts that share an id, or have none, all stay."""
    found = keep(near_duplicates(docs, words, similarity), "near-duplicates")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "__id", "__hash")).alias("first")).select("first.__id", "first.__hash")
    keyed = docs.select(F.struct("*").alias("kept"), *row_key(docs))  # a struct, as docs may have columns of any name
    out = keyed.join(first.hint("shuffle_hash"), ["__id", "__hash"], "left_semi")
    if found.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):  # rows equal in id and text
        out = out.dropDuplicates(["__id", "__hash"])
    return out.select("kept.*")
