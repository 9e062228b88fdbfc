r"""Exact Jaccard join of documents' shingle sets by partitioning the universe of shingles.

Sets are banded by size, so that partners (no smaller than SIMILARITY of each other) lie in one band or in two that adjoin. A band with
sizes up to t has H = t / 9 or so, the most shingles that a set of it and a like set of its size or more have not in common; shingles are
hashed to H + 1 segments, and a set's part in a segment is its subset. Of H + 1 subsets one must be equal (pigeonhole). More sharply: if
a set gives its segments weights of 0, 1 or 2 that sum to H + 1 or more, a partner has the same subset in a segment of weight 1 or 2, or
one that differs by one shingle in a segment of weight 2 (one has the other among its one-deletion neighbourhood).

Weights are allotted by cost, per set and band: subsets that no other set has are free and come first; if they are enough, the set
has no partner at all, whatever frequent subsets it shares. What is still needed is taken from the shared subsets with the fewest
holders; where those have more than UPGRADE holders, subsets that no one shares get weight 2 instead, which asks for their neighbourhoods.
So frequent passages are skipped, not compared.

Sets (one for all texts with equal shingles) that meet under an asked key form buckets. The buckets' hubs are compared with their members,
shingle by shingle; what is still in several components is joined as resemblance.settled does: exactly, with more and more hubs, until
no bucket holds two components that could be linked. So groups of copies take as many comparisons as they have members, and no link
between different components is lost. Before texts are fetched, the parities of the shingles in 64 * SKETCH cells are compared: no more
of them differ than shingles do.

Sets are told apart, and shingles compared, by 64-bit hashes. Nulls, texts without words: empty sets, linked with nothing. Fewer words than
a shingle: the whole sequence is one. Null ids: the least non-null id of the component counts; null if there is none. Repeated rows: each
gets its row. Very long texts are taken whole. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .resemblance import alike, labelled, settled, shingle_hashes, sketch
from .util import bitmap_of, hot_from, in_bitmap, keep, lookup, mixed, row_key, small_batches

WORDS = 3
PERCENT = 90
#: What a neighbourhood costs, in candidates. Candidates of one subset are compared with a hub, each once, while neighbourhoods take a further pass
#: over all documents; so they are for subsets that very many sets hold.
UPGRADE = 1 << 14
#: Bits of the bitmaps that thin out keys before a join; their size is fixed.
BITS = 26


def bands(percent: int, largest: int) -> list[int]:
    """The least sizes of the bands up to a size: partners of a band's sizes lie in it or in the next ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return out


def apart(a: int, b: int, percent: int) -> int:
    """The most elements that sets of these sizes have not in common if their similarity is `percent` or more."""
    return (a + b) * (100 - percent) // (100 + percent)


def asked_bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, segments, weight needed) of the bands in which a set looks for partners of its size or less."""
    starts = bands(percent, size)
    own = bisect_right(starts, size) - 1
    out = []
    for band in (own, own - 1):
        if band < 0:
            continue
        top = starts[band + 1] - 1
        partner = min(size, top)
        if partner * 100 >= size * percent:
            out.append((band, apart(top, top * 100 // percent, percent) + 1, apart(size, partner, percent) + 1))
    return out


def salt(band: int, segments: int) -> np.ndarray:
    return mixed(np.arange(1, segments + 1, dtype=np.uint64) + np.uint64(band << 40))


class Subsets:
    """A set's subsets in the segments of a band: their keys, and those of their one-deletion neighbourhoods."""

    def __init__(self, h: np.ndarray, band: int, segments: int):
        token = mixed(h)  # so that a key isn't the sum of the hashes that deal shingles to segments
        self.segment = (mixed(h ^ np.uint64(0x5BD1E995)) % np.uint64(segments)).astype(np.int64)
        sums = np.zeros(segments, np.uint64)
        np.add.at(sums, self.segment, token)
        own = salt(band, segments)
        self.keys = mixed(sums + own)
        self.deleted = mixed(sums[self.segment] - token + own[self.segment])  # of each shingle's subset without it


def set_of(text: str | None, words: int) -> tuple[np.ndarray, int]:
    """A text's distinct shingles' hashes, in order, and the set's own hash."""
    import xxhash

    h = np.unique(shingle_hashes((text or "").encode(), words)).astype(np.uint64)
    return h, xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, __id, __hash, size, node (the set's hash), sketch and, for each band asked, needed and keys, of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("needed", pa.int32()), ("keys", pa.list_(pa.int64()))]))
        for b in batches:
            sizes, nodes, sketches, asked = [], [], [], []
            for t in b.column("text").to_pylist():
                h, node = set_of(t, words)
                sizes.append(len(h))
                nodes.append(node)
                sketches.append(sketch(h))
                asked.append([{"needed": needed, "keys": Subsets(h, band, n).keys.view(np.int64)} for band, n, needed in asked_bands(len(h), percent)] if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__id"), b.column("__hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(asked, kind)], ["doc_id", "__id", "__hash", "size", "node", "sketch", "asked"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, __id bigint, __hash bigint, size bigint, node bigint, sketch array<bigint>, asked array<struct<needed:int,keys:array<bigint>>>")


def hits(rows: DataFrame, bitmap: np.ndarray, own_alone: bool) -> DataFrame:
    """node, asked (0: the set's own band, by which it is indexed; 1: the next smaller), place and key of the rows' keys in the bitmap."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists = b.column("keys")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[at[0] : at[-1]]
            found = np.flatnonzero(in_bitmap(held.value, flat.view(np.uint64)))
            row = np.searchsorted(at - at[0], found, side="right") - 1
            node, band = (b.column(c).to_numpy()[row] for c in ("node", "band"))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(band), pa.array((found - (at - at[0])[row]).astype(np.int32)), pa.array(flat[found])], ["node", "band", "place", "key"])

    own = rows.select("node", F.posexplode("asked").alias("band", "a")).select("node", "band", F.col("a.keys").alias("keys"))
    return (own.where("band = 0") if own_alone else own).mapInArrow(run, "node bigint, band int, place int, key bigint")


def shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subsets that several sets have, one of them in its own band: key and holders (how many have it there); and their
    entries: node, band, place, key. Both stored."""
    each = rows.select("node", F.posexplode("asked").alias("band", "a")).select("node", "band", F.explode("a.keys").alias("key"))
    several = each.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min("band").alias("band")).where("a <> b AND band = 0")
    several = keep(several.select("key"), "shared-keys")
    entries = keep(hits(rows, bitmap_of(several, "key", BITS), False).distinct(), "entries")
    holders = entries.groupBy("key").agg(F.sum(F.expr("if(band = 0, 1L, 0L)")).alias("holders"), F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"))
    holders = keep(holders.where("a <> b AND holders > 0").select("key", "holders", "n"), "holders")
    n = entries.count()
    return holders, keep(lookup(entries, holders, ["key"], n, "inner", hot=holders.where(F.col("n") > hot_from(n))), "shared-entries")


def allotted(rows: DataFrame, entries: DataFrame, upgrade: int) -> tuple[DataFrame, DataFrame]:
    """By cost, the asked keys of the shared entries: node, key; and the neighbourhoods asked: node, band, number (how many unshared
    subsets get weight 2). Both stored."""
    wanted = rows.select("node", F.posexplode("asked").alias("band", "a")).select("node", "band", "a.needed", F.size("a.keys").alias("segments")).distinct()
    by_cost = Window.partitionBy("node", "band").orderBy("holders", "place")  # of one set's segments
    others = entries.withColumn("holders", F.expr("holders - if(band = 0, 1, 0)")).where("holders > 0")
    costs = others.withColumn("turn", F.row_number().over(by_cost)).withColumn("n_shared", F.count(F.lit(1)).over(Window.partitionBy("node", "band")))
    told = costs.join(wanted.hint("shuffle_hash"), ["node", "band"])
    free = F.col("segments") - F.col("n_shared")
    told = told.withColumn("lack", F.col("needed") - free).where("lack > 0").withColumn("free", free)
    chosen = told.where("turn <= lack")
    dear = F.sum((F.col("holders") > upgrade).cast("int")).over(Window.partitionBy("node", "band"))
    chosen = keep(chosen.withColumn("upgraded", F.least("free", dear)), "chosen")
    asked = chosen.where(F.col("turn") <= F.col("lack") - F.col("upgraded")).select("node", "key").distinct()
    return keep(asked, "asked-keys"), keep(chosen.where("turn = 1 AND upgraded > 0").select("node", "band", F.col("upgraded").alias("number")), "asked-neighbourhoods")


def neighbourhoods(docs: DataFrame, rows: DataFrame, entries: DataFrame, asked: DataFrame, words: int, percent: int) -> DataFrame:
    """key, node: who meets by one-deletion neighbourhoods. A set asks, for the first `number` of its unshared subsets in a band, for sets that
    have the subset without one shingle, and for sets that have the subset after a deletion of theirs."""
    spark = rows.sparkSession
    askers = spark.sparkContext.broadcast(bitmap_of(asked, "node", BITS))

    def asking(batches: Iterator) -> Iterator:
        for b in batches:
            import pyarrow as pa

            yield b.filter(pa.array(in_bitmap(askers.value, b.column("node").to_numpy().view(np.uint64))))

    each = rows.select("node", F.posexplode("asked").alias("band", "a")).select("node", "band", F.col("a.keys").alias("keys"))
    each = each.mapInArrow(asking, "node bigint, band int, keys array<bigint>").select("node", "band", F.posexplode("keys").alias("place", "key"))
    own = keep(each.join(asked, ["node", "band"]).distinct(), "subsets-of-askers")
    held = entries.where(F.expr("holders - if(band = 0, 1, 0)") > 0).select("node", "band", "key", F.lit(1).alias("held"))
    alone = own.join(held.hint("shuffle_hash"), ["node", "band", "key"], "left").where("held IS NULL")
    turn = F.row_number().over(Window.partitionBy("node", "band").orderBy("place"))
    whole = keep(alone.withColumn("turn", turn).where("turn <= number").select("node", "key"), "upgraded-subsets")
    held = spark.sparkContext.broadcast(bitmap_of(whole, "key", BITS))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []  # node, kind (0: after a deletion of its own, indexed; 1: asks for it), key, of
            for t in b.column("text").to_pylist():
                h, node = set_of(t, words)
                for turn, (band, segments, _) in enumerate(asked_bands(len(h), percent) if len(h) else ()):
                    s = Subsets(h, band, segments)
                    if turn == 0:
                        found = in_bitmap(held.value, s.deleted)
                        out += [(node, 0, k, k) for k in np.unique(s.deleted[found]).view(np.int64).tolist()]
                    found = in_bitmap(held.value, s.keys)[s.segment]
                    out += [(node, 1, k, o) for k, o in zip(s.deleted[found].view(np.int64).tolist(), s.keys[s.segment[found]].view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["node", "kind", "key", "of"])

    made = keep(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node bigint, kind int, key bigint, of bigint").distinct(), "deletions")
    m = made.count()
    subsets = keep(whole.select("key").distinct(), "upgraded-keys")
    after = lookup(made.where("kind = 0").select("node", "key"), subsets.withColumn("met", F.lit(1)), ["key"], m, "inner").select("key", "node")
    asks = made.where("kind = 1").join(whole.select("node", F.col("key").alias("of")).hint("shuffle_hash"), ["node", "of"], "left_semi").select("key", "node")
    asks = keep(asks.distinct(), "deletion-keys")
    found = keep(hits(rows, bitmap_of(asks, "key", BITS), True).select("key", "node").distinct(), "deletion-holders")
    one = lookup(found, asks.select("key").distinct().withColumn("met", F.lit(1)), ["key"], found.count(), "inner").select("key", "node")
    return whole.select("key", "node").union(after).union(asks).union(one).distinct()


def buckets(docs: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT, upgrade: int = UPGRADE) -> DataFrame:
    """key, node: sets that may have partners, under the keys by which any two partners meet. Stored."""
    several, entries = shared(rows)
    asked, near = allotted(rows, entries, upgrade)
    keys = asked.groupBy("key").agg(F.count(F.lit(1)).alias("askers"))
    n = entries.count()
    met = lookup(entries.select("node", "band", "key", "n"), keys, ["key"], n, "inner", hot=several.where(F.col("n") > hot_from(n)))
    # holders in their own band can be found; of the others, those who ask
    found = met.where("band = 0").select("key", "node").union(asked.select("key", "node")).distinct()
    if near.take(1):
        found = found.union(neighbourhoods(docs, rows, entries, near, words, percent)).distinct()
    return keep(found, "bucket-entries")


def linked(docs: DataFrame, rows: DataFrame, entries: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component of the sets in the stored entries(key, node)."""
    n = entries.count()
    size = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    size = keep(size.where("n > 1"), "bucket-sizes")
    members = keep(lookup(entries, size, ["key"], n, "inner", hot=size.where(F.col("n") > hot_from(n))), "bucket-members")
    first = rows.groupBy("node").agg(F.min(F.struct("__id", "__hash", "size")).alias("first"))  # a row of each set
    wanted = keep(first.join(members.select("node").distinct(), "node").select("node", "first.*"), "candidates")
    keyed = docs.select(*row_key(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = keyed.join(wanted.hint("shuffle_hash"), ["__id", "__hash"]).select(F.col("node").alias("__hash"), "text").dropDuplicates(["__hash"])
    texts = keep(texts, "candidate-texts")
    m = members.count()
    score = members.groupBy("node").agg(F.sum("n").alias("score")).join(wanted.select("node", "size"), "node")
    told = keep(members.select("key", "node", "n").join(score.hint("shuffle_hash"), "node"), "scored-members")
    hub = told.groupBy("key").agg(F.max(F.struct("score", "node", "size")).alias("hub"))
    met = lookup(told, hub, ["key"], m, "inner", hot=size.where(F.col("n") > hot_from(m)))
    like = (F.col("size") * 100 >= F.col("hub.size") * percent) & (F.col("hub.size") * 100 >= F.col("size") * percent)
    pairs = keep(met.where((F.col("node") != F.col("hub.node")) & like).select(F.col("node").alias("x"), F.col("hub.node").alias("y")).distinct(), "hub-pairs")
    similarity = percent / 100
    found = alike(pairs, texts, words, similarity)
    nodes = keep(wanted.select(F.col("node").alias("__hash"), F.col("node").alias("component")), "nodes")
    nodes = labelled(nodes, found, wanted.count())
    rest = told.select(F.col("node").alias("__hash"), F.col("key").alias("h"), F.lit(1).cast("long").alias("place"), "size")
    links = found
    sketches = keep(rows.select("node", "sketch").join(wanted.select("node").hint("shuffle_hash"), "node").groupBy(F.col("node").alias("__hash")).agg(F.first("sketch").alias("sketch")), "sketches")
    for more in settled(keep(rest, "members-to-settle"), nodes, texts, words, similarity, sketches):
        links = links.union(more)
    return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, upgrade: int = UPGRADE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    own = keep(sets(docs, words, percent), "sets")
    n = own.count()
    of = linked(docs, own, buckets(docs, own, words, percent, upgrade), words, percent)
    told = own.select("doc_id", "size", "node").withColumn("alone", F.when(F.col("size") == 0, F.monotonically_increasing_id()))
    told = keep(lookup(told, of, ["node"], n).select("doc_id", "size", "alone", F.coalesce("component", "node").alias("component")), "labelled")
    least = keep(told.where("size > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "least-ids")
    out = lookup(told, least.drop("n"), ["component"], n, hot=least.where(F.col("n") > hot_from(n)))
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
