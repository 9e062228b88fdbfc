"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A byte is eight binary decisions, each with a context tree of its own over the preceding bytes. A node's block probability is
the even mixture of its Krichevsky-Trofimov estimate and the product over its children; the prediction for a new bit mixes the
estimates of all depths on its path by the weights that follow. All training bytes are counted: tasks count the grams of
DEPTH + 1 bytes, aggregations sum them and derive every depth. Every context is a node of the tree, however rare: a level's
nodes are a stored table, weights go up and estimates down the levels by aggregations and joins, and each gram of any text
gets its log probability. Grams with at least 1/GRAMS of all bytes (at most GRAMS of them) are broadcast with theirs; a text's
other grams are joined. Before a text's first byte stand DEPTH zero bytes.

The unigram base needs every word's count at every token. Words with at least 1/HEAD of the training tokens (at most HEAD of
them) are broadcast as hashes; the other words of a document are joined with the counts by hash. Words are told apart by
64-bit hashes.

Nulls count as empty texts: one token (the end), no bytes, score 0. A null id counts as '' for the split. Repeated rows are
each counted and scored. Very long texts are worked through in parts (with the bytes before a part as its context), whose sums are added.
An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import columns_of_binary, keep, mixed

DEPTH = 4
HEAD = 1 << 22
GRAMS = 1 << 21
#: Bytes of texts that are worked on at once, and different keys that a task holds back to add up.
PART, HELD = 1 << 21, 1 << 23
HELD_OUT, PARTS = 2, 7
#: Stands for the end of a text among the hashes of words; no word is empty.
END = b""


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes) -> list[int]:
    """Hashes of a text's lower-cased words (A-Z alone)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return [digest(w) for w in text.lower().split()]


@dataclass
class Part:
    """Texts d to e - 1 of a batch, or a part of the one text d: the raw bytes, their bounds among themselves, the places of their own
    bytes in data, where each text's context stands before them, and the hashes of each text's words, with the end's at its end."""

    d: int
    e: int
    bounds: np.ndarray
    data: np.ndarray
    where: np.ndarray
    words: list[list[int]]
    first: bool = True


def parts_of(raw: np.ndarray, at: np.ndarray, depth: int, most: int) -> Iterator[Part]:
    """A batch's texts in parts of about `most` bytes; a longer text in several, cut where words end (a longer word stays whole)."""
    end = [word_hashes_of_end()]
    d = 0
    while d < len(at) - 1:
        e = d + 1
        while e < len(at) - 1 and at[e + 1] - at[d] <= most:
            e += 1
        own = at[d : e + 1]
        if e > d + 1 or own[-1] - own[0] <= most:
            bounds = own - own[0]
            data, where = padded(raw[own[0] : own[-1]], bounds, depth)
            yield Part(d, e, bounds, data, where, [word_hashes(raw[x:y].tobytes()) + end for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
        else:
            low, high = int(own[0]), int(own[-1])
            begin = low
            while begin < high:
                stop = min(begin + most, high)
                while stop < high and not _BLANK.match(raw[stop : stop + 1].tobytes()):
                    ahead = _BLANK.search(raw[stop : min(stop + most, high)].tobytes())
                    stop = stop + ahead.start() if ahead else min(stop + most, high)
                lead = min(depth, begin - low)
                data = np.concatenate((np.zeros(depth - lead, np.uint8), raw[begin - lead : stop]))
                words = word_hashes(raw[begin:stop].tobytes()) + (end if stop == high else [])
                yield Part(d, e, np.array([0, stop - begin]), data, np.arange(depth, len(data)), [words], begin == low)
                begin = stop
        d = e


def word_hashes_of_end() -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(END)


def padded(raw: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with `depth` zero bytes before each, and the places of their own bytes."""
    sizes = np.diff(at)
    where = np.arange(len(raw)) + np.repeat(np.arange(1, len(at)) * depth, sizes)
    out = np.zeros(len(raw) + (len(at) - 1) * depth, np.uint8)
    out[where] = raw
    return out, where


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not any(map(len, keys)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.argsort(k := np.concatenate(keys), kind="stable")
    k, n = k[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n, first)


def grams_of(data: np.ndarray, where: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The grams that end at data[where], the last byte lowest."""
    code = np.zeros(len(where), np.uint64)
    for k in range(depth + 1):
        code |= data[where - k].astype(np.uint64) << np.uint64(8 * k)
    return code


def counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind (0: gram, the predicted byte lowest; 1: word hash), key, n over all training texts(text binary) and n_all with the texts
    marked held_out, where there is such a column. Their grams are listed (n is 0 if no training text has them), their words aren't."""
    if "held_out" not in texts.columns:
        texts = texts.withColumn("held_out", F.lit(False))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept: list[tuple[list, list]] = [([], []), ([], []), ([], [])]  # the last: grams of held-out texts

        def merged() -> Iterator[pa.RecordBatch]:
            for kind, (keys, ns) in enumerate(kept):
                k, n = _merged(keys, ns)
                keys.clear()
                ns.clear()
                for i in range(0, len(k), 50_000):
                    part = k[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i : i + 50_000].astype(np.int64))], ["kind", "key", "n"])

        for b in batches:
            raw, at = columns_of_binary(b.column("text"))
            held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for p in parts_of(raw, at, depth, PART):
                code = grams_of(p.data, p.where, depth)
                out = np.repeat(held[p.d : p.e], np.diff(p.bounds))
                words = [w for own, h in zip(p.words, held[p.d : p.e].tolist(), strict=True) if not h for w in own]
                for (keys, ns), values in zip(kept, (code[~out], np.array(words, np.uint64), code[out]), strict=True):
                    u, n = np.unique(values, return_counts=True)
                    keys.append(u)
                    ns.append(n)
                if sum(len(k) for keys, _ in kept for k in keys) > HELD:
                    yield from merged()
        yield from merged()

    each = texts.select("text", "held_out").mapInArrow(run, "kind int, key bigint, n bigint")
    train = F.when(F.col("kind") < 2, F.col("n")).otherwise(0).alias("n")
    return each.select((F.col("kind") % 2).alias("kind"), "key", train, F.col("n").alias("n_all")).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def _lgamma(x: Column) -> Column:
    """Log gamma of positive numbers: Stirling's series at x + 8."""
    z = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - shift


def _block() -> Column:
    """Log of the Krichevsky-Trofimov probability of a block with the counts in the columns zeros and ones."""
    z, o = F.col("zeros").cast("double"), F.col("ones").cast("double")
    return _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1) - float(np.log(np.pi))


def probabilities(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, log10p: the log probability of each gram's last byte after the others, of grams(key, n) whose n may be 0.

    A level has a row for each context of so many bytes and binary node on the way to one of its bytes. A context has 256 bytes
    and 256 longer contexts at most, so no group is large, whatever the corpus."""
    named = grams.select(F.expr("shiftright(key, 8)").alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n").repartition("context")
    steps = ", ".join(f"struct(cast({1 << k} | shiftright(byte, {8 - k}) AS smallint) AS node, shiftright(byte, {7 - k}) & 1 AS bit)" for k in range(8))
    each = named.select("context", "n", F.explode(F.expr(f"array({steps})")).alias("s")).select("context", "s.node", "s.bit", "n")
    level = each.groupBy("context", "node").agg(F.sum(F.expr("if(bit = 0, n, 0L)")).alias("zeros"), F.sum(F.expr("if(bit = 1, n, 0L)")).alias("ones"), F.bit_or(F.expr("cast(1 + bit AS tinyint)")).alias("seen"))
    levels = [keep(level, "contexts")]
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    weighted = _block()
    for d in range(depth - 1, -1, -1):
        up = F.col("context").bitwiseAND((1 << (8 * d)) - 1).alias("context")
        sums = levels[-1].select(up, "node", "zeros", "ones", weighted.alias("weighted")).groupBy("context", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        levels.append(keep(sums.withColumn("estimate", _block()), "contexts"))
        high = F.greatest("estimate", "below")
        weighted = high + F.log(F.exp(F.col("estimate") - high) + F.exp(F.col("below") - high)) - float(np.log(2))
    share = F.exp(F.col("estimate") - weighted - float(np.log(2)))  # of the node's own estimate
    above = None
    for d in range(depth):
        own = levels[depth - d].select("context", "node", kt.alias("kt"), share.alias("share"))
        if above is None:
            above = own.select("context", "node", (F.col("share") * F.col("kt")).alias("mix"), (1 - F.col("share")).alias("left"))
        else:
            met = _with_above(own, above, d)
            above = met.select("context", "node", (F.col("mix") + F.col("left") * F.col("share") * F.col("kt")).alias("mix"), (F.col("left") * (1 - F.col("share"))).alias("left"))
    leaves = _with_above(levels[0].select("context", "node", "seen", kt.alias("kt")), above, depth)
    leaves = leaves.groupBy("context").agg(F.collect_list(F.struct("node", "seen", (F.col("mix") + F.col("left") * F.col("kt")).alias("one"))).alias("nodes"))  # 255 at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            nodes = b.column("nodes")
            flat = nodes.flatten()
            row = np.repeat(np.arange(len(b)), np.diff(nodes.offsets.to_numpy()))
            node, seen, one = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            heap = np.full((len(b), 256), 0.5)
            heap[row, node] = one
            parts = []
            for bit in (0, 1):
                last = (node >= 128) & (seen & (1 + bit) > 0)
                parts.append((row[last], (node[last].astype(np.int64) - 128) * 2 + bit))
            of, byte = (np.concatenate(x) for x in zip(*parts, strict=True))
            log = np.zeros(len(of))
            for k in range(8):
                p = heap[of, (1 << k) | (byte >> (8 - k))]
                log += np.log10(np.where((byte >> (7 - k)) & 1, p, 1 - p))
            context = b.column("context").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(context[of] << 8 | byte), pa.array(log.astype(np.float32))], ["key", "log10p"])

    return leaves.mapInArrow(run, "key bigint, log10p float")


def _with_above(level: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """level with mix and left of the contexts that are a byte shorter."""
    up = above.select(F.col("context").alias("up"), F.col("node").alias("at"), "mix", "left").hint("shuffle_hash")
    return level.join(up, (F.col("context").bitwiseAND((1 << (8 * (depth - 1))) - 1) == F.col("up")) & (F.col("node") == F.col("at"))).drop("up", "at")


class Known:
    """Numbers by key, found in arrays at the key's hash or soon after."""

    NONE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(size, self.NONE)
        self.values = np.zeros(size, np.float32)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.keys[slot] == self.NONE
            self.keys[slot[free]] = keys[left[free]]
            done = self.keys[slot] == keys[left]
            self.values[slot[done]] = values[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its number or 0."""
        slot = self.slots(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], np.float32(0))
        left = np.flatnonzero(~hit & (there != self.NONE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            same = there == keys[left]
            hit[left[same]] = True
            out[left[same]] = self.values[slot[same]]
            more = ~same & (there != self.NONE)
            left, slot = left[more], slot[more]
        return hit, out


def _distinct(values: np.ndarray, of: np.ndarray, n: int) -> tuple:
    """Two Arrow lists for each of n texts: its distinct values, and how often each occurs."""
    import pyarrow as pa

    by = np.lexsort((values, of))
    values, of = values[by], of[by]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(values))).astype(np.int32)
    cuts = pa.array(np.searchsorted(of[first], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(values[first].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte (code length) of every row."""
    spark = docs.sparkSession
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT).alias("held_out"),
    )
    counted = keep(counts(own), "counts")
    grams = counted.where("kind = 0")
    likely = keep(probabilities(grams.select("key", "n")).join(grams.select("key", "n_all"), "key"), "probabilities")
    many = (grams.agg(F.sum("n_all")).first()[0] or 0) // GRAMS + 1
    often = likely.where(F.col("n_all") >= many).select("key", "log10p").toPandas()
    frequent = spark.sparkContext.broadcast(Known(often["key"].to_numpy(np.int64).view(np.uint64), often["log10p"].to_numpy(np.float32)))
    words = counted.where("kind = 1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = total // HEAD + 1
    head = words.where(F.col("n") >= least).toPandas()
    keys = head["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], np.log10(head["n"].to_numpy(float)[order] + 1)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        head_keys, head_logs = known.value
        number = TaskContext.get().partitionId() << 33  # of a text
        for b in batches:
            raw, at = columns_of_binary(b.column("text"))
            for p in parts_of(raw, at, DEPTH, PART):
                m = p.e - p.d
                code = grams_of(p.data, p.where)
                here, log10p = frequent.value.find(code)
                total_so_far = np.concatenate(([0], np.cumsum(log10p, dtype=np.float64)))
                score = total_so_far[p.bounds[1:]] - total_so_far[p.bounds[:-1]]
                seldom = np.repeat(np.arange(m), np.diff(p.bounds))[~here]
                n_tokens = [len(w) for w in p.words]
                doc = np.repeat(np.arange(m), n_tokens)
                h = np.array([x for w in p.words for x in w], np.uint64)
                place = np.searchsorted(head_keys, h)
                hit = np.zeros(len(h), bool)
                if len(head_keys):
                    hit = head_keys[np.minimum(place, len(head_keys) - 1)] == h
                logs = np.bincount(doc[hit], head_logs[place[hit]], m) if hit.any() else np.zeros(m)
                n_known = np.bincount(doc[hit], minlength=m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(p.d, p.e)), b.column("doc_id").slice(p.d, m), b.column("held_out").slice(p.d, m), pa.array(np.array(n_tokens, np.int64)), pa.array(n_known.astype(np.int64)), pa.array(logs), pa.array(score), pa.array(np.diff(p.bounds)),
                     *_distinct(h[~hit], doc[~hit], m), *_distinct(code[~here], seldom, m)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "rare", "times", "grams", "gram_times"],
                )
            number += len(at) - 1

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, n_bytes bigint, rare array<bigint>, times array<int>, grams array<bigint>, gram_times array<int>"
    rows = keep(own.mapInArrow(run, schema), "scored")  # a text has a row for each of its parts
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), "w.times")
    more = rare.join(words.where(F.col("n") < least), "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known"))
    seldom = rows.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select("row", F.col("g.grams").alias("key"), "g.gram_times")
    more_score = seldom.join(likely.where(F.col("n_all") < many), "key").groupBy("row").agg(F.sum(F.col("gram_times") * F.col("log10p").cast("double")).alias("more_score"))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score", "n_bytes")]
    out = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums).join(more, "row", "left").join(more_score, "row", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        "score", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("score") / F.col("n_bytes") / F.log10(F.lit(2.0))).otherwise(0.0).alias("bits_per_byte"),
    )
