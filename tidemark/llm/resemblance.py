"""Links between texts that share a given part of their distinct word shingles (their Jaccard similarity).

1. Bands: the least values of 48 hash functions over a text's shingle hashes, in bands of 4, put like texts into common buckets (a
   pair at .8 meets in one of 12 with a chance of .998). The text of a bucket that shares the most buckets in all (of edited copies,
   their original) is its hub, and each other text is compared with its buckets' hubs, shingle by shingle. So a large group of
   copies takes as many comparisons as it has texts.
2. What hubs don't settle: the texts of buckets that still hold several components are joined with each other exactly, by their
   rarest shingles. Of the shingles ordered by rarity, like texts share one among the first (1 - similarity) of each; boilerplate
   is frequent and comes last. In a bucket of such a shingle, texts outside its largest component become hubs, and are compared
   with the bucket's texts of other components: a few at first, then eight times as many in each round, until a bucket is one
   component or all its texts outside the largest one were hubs. By then each pair of different components was compared.

Each round is a stored join; only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .util import hot_from, keep, lookup, mixed as scrambled, row_key

BANDS, BAND = 12, 4
#: Hubs of a bucket in the first round after the bands, and how their number grows.
HUBS, GROWTH = 4, 8
#: Comparisons of hubs with their buckets' texts, by entry, that one round may make: cheap ones, as most end at the sketches.
AT_ONCE = 64
#: Longs of a set's sketch.
SKETCH = 16
#: A bucket's texts are dealt to so many tasks.
SPLIT = 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of a UTF-8 text's word shingles, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    tokens = text.lower().split()  # bytes: A-Z and the six white-space bytes alone
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    k = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def sketch(h: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of 64 * SKETCH cells, as longs."""
    cells = np.bincount((scrambled(h ^ np.uint64(0x2545F491)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8)).view("<i8")


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The stored pairs(x, y: hashes of texts) whose texts(__hash, text) have `similarity` of their shingles in common, stored."""
    n = pairs.count()
    for side, name in (("x", "ours"), ("y", "theirs")):
        hot = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from(n))
        pairs = lookup(pairs, texts.select(F.col("__hash").alias(side), F.col("text").alias(name)), [side], n, "inner", hot=hot)

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept = []
            last: tuple = (None, None)  # the hub's shingles, as its rows often follow each other
            for ours, theirs in zip(batch.column("ours").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                if last[0] != theirs:
                    last = (theirs, np.unique(shingle_hashes(theirs.encode(), words)))
                own = np.unique(shingle_hashes(ours.encode(), words))
                common = len(np.intersect1d(own, last[1], assume_unique=True))
                kept.append(common >= similarity * (len(own) + len(last[1]) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(kept))

    return keep(pairs.select("x", "y", "ours", "theirs").mapInArrow(verify, "x bigint, y bigint"), "alike")


def labelled(nodes: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The n stored nodes(__hash, component) after the links found(x, y)."""
    named = nodes.select(F.col("__hash"), "component")
    ends = lookup(lookup(found, named.toDF("x", "a"), ["x"], n, "inner", held=n), named.toDF("y", "b"), ["y"], n, "inner", held=n)
    moved = components(ends.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return keep(lookup(nodes, moved, ["component"], n).select("__hash", F.coalesce("to", "component").alias("component")), "labels")


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """__hash and sketch, as settled() has them, of texts(__hash, text). Stored."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            told = [sketch(np.unique(shingle_hashes(text.encode(), words)).astype(np.uint64)) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__hash"), pa.array(told, pa.list_(pa.int64()))], ["__hash", "sketch"])

    return keep(texts.select("__hash", "text").mapInArrow(run, "__hash bigint, sketch array<bigint>"), "sketches")


def prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """__hash, h, place, size: the rarest shingles of texts(__hash, text) that occur in several, as many as a like text must share one
    of; the shingle's place (from 1) in the order by rarity, and the text's number of shingles. Stored."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for key, text in zip(b.column("__hash").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = np.unique(shingle_hashes(text.encode(), words)).view(np.int64)
                for i in range(0, len(h), 50_000):
                    part = h[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key, np.int64)), pa.array(part), pa.array(np.full(len(part), len(h), np.int64))], ["__hash", "h", "size"])

    each = keep(texts.select("__hash", "text").mapInArrow(run, "__hash bigint, h bigint, size bigint"), "shingles")
    n = each.count()
    often = keep(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-shingles")
    ranked = lookup(each, often, ["h"], n, hot=often.where(F.col("n") > hot_from(n))).withColumn("n", F.coalesce("n", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("__hash").orderBy("n", "h"))
    first = ranked.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    return keep(first.where("n > 1").select("__hash", "h", F.col("place").cast("long").alias("place"), "size"), "prefixes")


def settled(entries: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, sketched: DataFrame | None = None) -> list[DataFrame]:
    """Links between texts of different components of nodes(__hash, component) that share an h of entries (as prefixes() has them);
    enough of them to join the components that hold like texts. Two texts are compared only if the shingles from the shared one on
    can still be enough: like texts meet at the first shingle that they share, and there all that they share is yet to come.
    sketched(__hash, sketch): parities of the shingles in each of some cells, as longs; no more of them differ than shingles do."""
    n, n_nodes, hubs = entries.count(), nodes.count(), HUBS
    rest = 1 + F.least(F.col("size") - F.col("place"), F.col("hub_rest"))
    enough = rest >= (F.col("size") + F.col("hub_size")) * (similarity / (1 + similarity)) - 1e-9
    extra = []
    if sketched is not None:
        extra = [F.col("sketch").alias("hub_sketch")]
        differing = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda sum, d: sum + d)
        enough = enough & (differing * (1 + similarity) <= (F.col("size") + F.col("hub_size")) * (1 - similarity) + 1e-6)
    links: list[DataFrame] = []
    done: list[DataFrame] = []
    while True:
        at = keep(lookup(entries, nodes, ["__hash"], n, "inner", held=n_nodes), "bucket-members")
        share = at.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"))
        buckets = share.groupBy("h").agg(F.sum("m").alias("all"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "component")).alias("big")).where("parts > 1")
        buckets = keep(buckets.select("h", (F.col("all") - F.col("big.m")).alias("outside"), F.col("big.component").alias("big"), "all"), "mixed-buckets")
        most, work = buckets.agg(F.max("outside"), F.sum(F.col("outside") * F.col("all"))).first()
        if not most:
            return links
        if work <= AT_ONCE * n:  # so few that one round will do
            hubs = max(hubs, most)
        mixed = lookup(at, buckets, ["h"], n, "inner", hot=buckets.where(F.col("all") > hot_from(n)))
        mixed = keep(mixed, "mixed-members")
        if sketched is not None:
            mixed = keep(lookup(mixed, sketched, ["__hash"], mixed.count(), "inner"), "mixed-members")
        drawn = F.pmod(F.xxhash64("__hash", F.lit(7)), F.lit(1 << 30)) * F.col("outside") < F.lit(hubs << 30)
        hub = mixed.where((F.col("component") != F.col("big")) & drawn).select("h", F.col("__hash").alias("hub"), F.col("component").alias("of"), (F.col("size") - F.col("place")).alias("hub_rest"), F.col("size").alias("hub_size"), *extra, F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("part"))
        # not left to Spark, which takes the hubs for as small as before they were dealt to SPLIT parts, and a sketch for one long
        met = mixed.withColumn("part", F.pmod(F.xxhash64("__hash"), F.lit(SPLIT)).cast("int")).join(hub.hint("merge"), ["h", "part"]).where((F.col("component") != F.col("of")) & enough)
        pairs = met.select(F.least("__hash", "hub").alias("x"), F.greatest("__hash", "hub").alias("y")).distinct()
        if done:
            pairs = pairs.join(reduce(DataFrame.union, done), ["x", "y"], "left_anti")
        pairs = keep(pairs, "pairs")
        done.append(pairs)
        found = alike(pairs, texts, words, similarity)
        links.append(found)
        if most <= hubs:
            return links
        nodes, hubs = labelled(nodes, found, n_nodes), hubs * GROWTH


def similar(prints: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: fingerprints that link those of different texts with a common share of distinct shingles of `similarity` or more."""
    texts = keep(prints.groupBy("__hash").agg(F.min("__id").alias("__id"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    rows = keep(texts.select("__hash", "__id", F.posexplode("keys").alias("band", "key")), "bands")
    n = rows.count()
    sizes = keep(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = keep(lookup(rows, sizes, ["band", "key"], n, "inner", hot=sizes.where(F.col("n") > hot_from(n))), "shared-buckets")
    score = shared.groupBy("__hash").agg(F.sum("n").alias("score"))
    hubs = shared.join(score, "__hash").groupBy("band", "key").agg(F.max(F.struct("score", "__hash")).alias("hub"))
    m = shared.count()
    met = lookup(shared, hubs, ["band", "key"], m, "inner").where("__hash <> hub.__hash")
    pairs = keep(met.select(F.col("__hash").alias("x"), F.col("hub.__hash").alias("y")).distinct(), "candidates")
    wanted = shared.select("__id", "__hash").distinct()
    keyed = docs.select(*row_key(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bodies = keep(keyed.join(wanted.hint("shuffle_hash"), ["__id", "__hash"]).select("__hash", "text").dropDuplicates(["__hash"]), "candidate-texts")
    found = [alike(pairs, bodies, words, similarity)]
    nodes = keep(wanted.select("__hash", F.col("__hash").alias("component")), "nodes")
    nodes = labelled(nodes, found[0], n)
    at = keep(lookup(shared.select("__hash", "band", "key", "n"), nodes, ["__hash"], m, "inner"), "labelled-buckets")
    mixed = at.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("n").alias("n")).where("least <> most")
    left = lookup(at.drop("n"), mixed, ["band", "key"], m, "inner", hot=mixed.where(F.col("n") > hot_from(m))).select("__hash").distinct()
    left = keep(bodies.join(left.hint("shuffle_hash"), "__hash", "left_semi"), "left-over-texts")
    if left.take(1):
        entries = prefixes(left, words, similarity)
        found += settled(entries, nodes, left, words, similarity, sketches(left, words))
    every = keep(reduce(DataFrame.union, found), "text-links")
    k = every.count()
    print_of = texts.select("__hash", "fp")
    named = lookup(lookup(every, print_of.toDF("x", "a"), ["x"], k, "inner"), print_of.toDF("y", "b"), ["y"], k, "inner", hot=every.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from(k)))
    return named.select("a", "b")
