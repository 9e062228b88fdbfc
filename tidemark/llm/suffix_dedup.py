"""Removal of long repeated byte strings by refining q-gram buckets.

Suffixes start in buckets of their first 200 bytes; a bucket is refined by the bucket identifiers of later offsets of its
members: a string of 400 bytes is known by the identifiers at offsets 0 and 200. Three facts keep this far below a full
suffix array (whose sorted suffixes would take many times the input on disk):

1. Of the 201 buckets in a 400-byte window, the one with the least hash (leftmost if tied) is the window's anchor. Equal
   windows have their anchors at equal places, so only windows with an anchor in the same bucket can be equal. Windows that
   follow each other mostly share an anchor; an anchor with its run of windows is one row. About one byte in 100 is an anchor.
2. Buckets with one member hold no repeat and are dropped at once (their hashes meet in one aggregation).
3. Members of a bucket whose whole runs are equal form one class: a class of two or more is repeated in full, and one member
   stands for it from then on. Only buckets with several classes are refined: runs are cut into pieces of 16 windows, pieces
   grouped by the identifiers of the string that all their windows share, and only pieces of groups with several classes are
   refined to single windows.

Which rows take part in the next refinement is told to the tasks by a bitmap of fixed size if it holds them with few false hits
(MARKS of them); more are joined with their documents, whose texts are then shuffled. Both give the same result: a false hit
costs rows, not correctness, as every count is of windows that exist. The bitmap of the first buckets, however full, lets through
one row per anchor at most. Groups are only ever counted by aggregation: no pairs, no group in a task.

Bucket identifiers are 64-bit rolling hashes; a string is told apart by two of them or by one and a 64-bit hash of three.

The same refinement runs over words (WORDS: 50 words, buckets of 25) to tell passages: 50 words are often fewer than 400 bytes, so
removal alone doesn't see them. Words are those of the text as it is, by white space; nothing is removed for them.

Nulls and empty texts: no bytes, nothing removed. Repeated rows: two rows of equal id and text are two documents, so their
windows are repeats of each other; their equal spans are gathered once. Null ids count as an id. Texts shorter than 400 bytes
are never changed by others. Very
long texts are worked through in pieces. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import bitmap_of, columns_of_binary, hot_from, in_bitmap, keep, lookup, mixed, row_key, small_batches


@dataclass(frozen=True)
class Unit:
    """What strings are made of: `length` symbols make a string that is looked for, q (half of them) a bucket's."""

    name: str
    length: int
    piece: int

    @property
    def q(self) -> int:
        return self.length // 2


BYTES = Unit("bytes", 400, 16)
WORDS = Unit("words", 50, 8)
CHUNK = 1 << 19
BITS = 26
#: A bitmap is used for so many marks at most (one bit in 16 is set); more go to their documents by a join.
MARKS = 1 << (BITS - 4)
#: A chunk's positions fit into so many bits.
PLACE_BITS = 21

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
#: The value of a word's byte depends on its place up to here, and then on the place in turn.
_WORD_PLACES = 1 << 16


def _ready() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, of its inverse, and a value for each byte."""
    if not _powers:
        n = CHUNK + 2 * BYTES.length + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["byte"] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _powers["up"], _powers["down"], _powers["byte"]


def symbols(unit: Unit, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts (bytes raw, offsets at): the bytes themselves or hashes of the words, and the texts' offsets in symbols."""
    if unit == BYTES or not len(raw):
        return raw, at
    up, _, byte = _ready()
    space = _SPACE[raw]
    first = ~space
    after = np.append(True, space[:-1])
    after[at[:-1][at[:-1] < len(raw)]] = True
    first &= after
    starts = np.flatnonzero(first)
    out = np.zeros(len(starts), np.uint64)
    for b in range(0, len(raw) if len(starts) else 0, 1 << 20):
        e = min(b + (1 << 20), len(raw))
        i, j = np.searchsorted(starts, (b, e))
        owner, cuts = np.arange(i, j), starts[i:j]
        if i == j or cuts[0] > b:  # the rest of a word that began before, or spaces
            owner, cuts = np.append(max(i - 1, 0), owner), np.append(b, cuts)
        place = np.arange(b, e) - np.repeat(starts[owner], np.diff(np.append(cuts, e)))
        value = byte[raw[b:e]] * up[place & (_WORD_PLACES - 1)]
        value[space[b:e]] = 0
        np.add.at(out, owner, np.add.reduceat(value, cuts - b))
    return mixed(out), np.searchsorted(starts, at)


def buckets(data: np.ndarray, q: int) -> np.ndarray:
    """The identifier of the q symbols at each position."""
    up, down, byte = _ready()
    values = byte[data] if data.dtype == np.uint8 else data
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=sums[1:])
    return mixed((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])


def anchors(ids: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window: the place of the least of its `width` identifiers, leftmost if tied."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    x = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return (x & low).astype(np.int64)


def runs(raw: np.ndarray, at: np.ndarray, unit: Unit) -> Iterator[tuple]:
    """For chunks of documents (symbols raw, offsets at): document number, anchor, first and last window of each run, all counted
    from the document's start; the chunk's identifiers; the places of anchor, first and last window in it."""
    n, d, length = len(at) - 1, 0, unit.length
    while d < n:
        e = d + 1  # documents d to e-1, or a piece of one that is longer than a chunk
        while e < n and at[e + 1] - at[d] <= CHUNK:
            e += 1
        for begin in range(int(at[d]), max(int(at[e]) - length + 1, int(at[d])), CHUNK):
            data = raw[begin : min(begin + CHUNK + length - 1, int(at[e]))]
            if len(data) < length:
                continue
            ids = buckets(data, unit.q)
            anchor = anchors(ids, length - unit.q + 1)
            m = len(anchor)
            ends = at[d + 1 : e + 1] - begin
            out = np.zeros(m + 1, np.int32)  # windows over a document's end
            np.add.at(out, np.clip(ends - length + 1, 0, m), 1)
            np.add.at(out, np.clip(ends, 0, m), -1)
            good = np.cumsum(out[:m]) == 0
            new = np.ones(m, bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:] - 1, m - 1)
            of = np.searchsorted(ends, first, side="right")
            # a run of one anchor may go on over a document's start only if no invalid window lies between: never
            use = good[first]
            first, last, of = first[use], last[use], of[use]
            start = at[d : e][of] - begin
            place = anchor[first]
            yield of + d, place - start, first - start, last - start, ids, place, first, last
        d = e


def string_hash(*parts: np.ndarray) -> np.ndarray:
    """A hash of tuples of identifiers."""
    out = np.zeros(len(parts[0]), np.uint64)
    for i, p in enumerate(parts):
        out = mixed(out + p * np.uint64(2 * i + 3))
    return out


def text_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, q: int) -> np.ndarray:
    """A hash of the strings from begin to end, 2 q to 3 q symbols long."""
    return string_hash(ids[begin], ids[begin + q], ids[end - q])


def core_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, q: int) -> np.ndarray:
    """A hash of the strings from begin to end, q to 2 q symbols long."""
    return string_hash(ids[begin], ids[end - q])


def ticket(h: np.ndarray, row_hash: np.ndarray, row_id: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return h ^ row_hash ^ row_id ^ (anchor.astype(np.uint64) << np.uint64(13))


def ticket_column(h: str) -> Column:
    """As ticket(): what names a member to the tasks."""
    return F.expr(f"`{h}` ^ __hash ^ __id ^ shiftleft(anchor, 13)")


def classes_of(rows: DataFrame, shape: list[str], h: str) -> DataFrame:
    """Rows of equal shape with their number n and the ticket of one of them."""
    return keep(rows.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.min(ticket_column(h)).alias("rep")), "classes")


def shared_rows(rows: DataFrame, classes: DataFrame, shape: list[str], n: int) -> DataFrame:
    """The rows whose class has more than one."""
    again = classes.where("n > 1").select(*shape, F.lit(True).alias("again"))
    return lookup(rows, again, shape, n, "inner", hot=classes.where(F.col("n") > hot_from(n)))


def marked(texts: DataFrame, rows: DataFrame, reps: DataFrame, n: int, passing: list) -> tuple[DataFrame, Callable, bool]:
    """For the n members of rows whose tickets are reps(rep): the texts to scan for them (all, or those of their documents), a
    function of a batch of those texts that gives the test of tickets, and whether that test holds for batches of any texts. passing: gets
    the broadcast."""
    if n <= MARKS:
        bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(reps, "rep", BITS))
        passing.append(bitmap)
        return texts, lambda b: lambda tickets: in_bitmap(bitmap.value, tickets), True
    owners = rows.select("__id", "__hash", ticket_column("string").alias("rep")).join(reps.select("rep"), "rep", "left_semi")
    asked = owners.groupBy("__id", "__hash").agg(F.collect_set("rep").alias("tickets"))  # at most one for each run or piece of a text

    def known(b) -> Callable:
        tickets = np.unique(b.column("tickets").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        return lambda t: np.isin(t, tickets)

    return texts.join(asked.hint("shuffle_hash"), ["__id", "__hash"]), known, False


def _long(x: np.ndarray):
    return np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def _batch(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(_long(v)) for v in columns.values()], list(columns))


def _longs(*names: str) -> str:
    return ", ".join(f"{n} bigint" for n in names)


def _joined(parts: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(n)]


def repeated(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """__id, __hash, lo, hi: runs of windows (by their first symbols) that occur elsewhere too. Runs may overlap."""
    spark, length, q, size = docs.sparkSession, unit.length, unit.q, unit.piece
    small_batches(spark)
    texts = docs.select(*row_key(docs), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator) -> Iterator:
        for b in batches:
            found = [ids[place] for _, _, _, _, ids, place, _, _ in runs(*symbols(unit, *columns_of_binary(b.column("text"))), unit)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield _batch({"bucket": h, "n": np.minimum(n, 2)})

    shared = texts.mapInArrow(count, _longs("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    first = spark.sparkContext.broadcast(bitmap_of(shared, "bucket", BITS))
    passing = [first]  # broadcasts that nothing needs once the windows are stored

    def member_runs(b) -> Iterator[tuple]:
        """Runs in shared buckets with the hashes of their strings."""
        row_id, row_hash = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("__id", "__hash"))
        for doc, anchor, lo, hi, ids, place, p, r in runs(*symbols(unit, *columns_of_binary(b.column("text"))), unit):
            use = in_bitmap(first.value, ids[place])
            if use.any():
                doc, anchor, lo, hi, place, p, r = (x[use] for x in (doc, anchor, lo, hi, place, p, r))
                yield (row_id[doc], row_hash[doc], ids[place], text_of(ids, p, r + length, q), anchor, lo, hi), ids, place

    names = ("__id", "__hash", "bucket", "string", "anchor", "lo", "hi")

    def members(batches: Iterator) -> Iterator:
        for b in batches:
            if parts := [row for row, _, _ in member_runs(b)]:
                yield _batch(dict(zip(names, _joined(parts, 7), strict=True)))

    member = keep(texts.mapInArrow(members, _longs(*names)), "runs")
    n_members = member.count()
    shape = ["bucket", "string", "before", "after"]
    member = member.withColumns({"before": F.col("anchor") - F.col("lo"), "after": F.col("anchor") - F.col("hi")})
    of_run = classes_of(member, shape, "string")
    whole = shared_rows(member, of_run, shape, n_members).select("__id", "__hash", "lo", "hi")

    several = of_run.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    n_classes = of_run.count()
    reps = lookup(of_run.select("bucket", "rep"), several, ["bucket"], n_classes, "inner", hot=several.where(F.col("classes") > hot_from(n_classes)))
    unsettled, in_second, anywhere = marked(texts, member, reps, several.agg(F.sum("classes")).first()[0] or 0, passing)

    def pieces(b, left: Callable | None) -> Iterator[tuple]:
        """Pieces of the runs that refinement is left for: those whose tickets pass the test, or all."""
        for (row_id, row_hash, _, string, anchor, lo, hi), ids, place in member_runs(b):
            use = left(ticket(string, row_hash, row_id, anchor)) if left else np.ones(len(anchor), bool)
            if not use.any():
                continue
            row_id, row_hash, anchor, lo, hi, place = (x[use] for x in (row_id, row_hash, anchor, lo, hi, place))
            d0, d1 = (anchor - hi) // size, (anchor - lo) // size
            times = d1 - d0 + 1
            at = np.repeat(np.arange(len(times)), times)
            k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + d0[at]
            near, far = np.maximum(k * size, (anchor - hi)[at]), np.minimum(k * size + size - 1, (anchor - lo)[at])
            place = place[at]
            core = core_of(ids, place - k * size, place - np.minimum(k * size + size - 1, length - q) + length, q)
            yield (row_id[at], row_hash[at], k, core, text_of(ids, place - far, place - near + length, q), near, far, anchor[at]), ids, place

    piece_names = ("__id", "__hash", "k", "core", "string", "near", "far", "anchor")

    def cut(batches: Iterator) -> Iterator:
        for b in batches:
            if parts := [row for row, _, _ in pieces(b, in_second(b))]:
                yield _batch(dict(zip(piece_names, _joined(parts, 8), strict=True)))

    piece = keep(unsettled.mapInArrow(cut, _longs(*piece_names)), "pieces")
    n_pieces = piece.count()
    shape = ["k", "core", "string", "near", "far"]
    of_piece = classes_of(piece, shape, "string")
    part = shared_rows(piece, of_piece, shape, n_pieces).selectExpr("__id", "__hash", "anchor - far AS lo", "anchor - near AS hi")
    several = of_piece.groupBy("k", "core").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    n_classes = of_piece.count()
    reps = lookup(of_piece.select("k", "core", "rep"), several, ["k", "core"], n_classes, "inner", hot=several.where(F.col("classes") > hot_from(n_classes)))
    unsettled, in_third, _ = marked(texts, piece, reps, several.agg(F.sum("classes")).first()[0] or 0, passing)

    def windows(batches: Iterator) -> Iterator:
        for b in batches:
            parts, left = [], in_third(b)
            for (row_id, row_hash, _, _, string, near, far, anchor), ids, place in pieces(b, in_second(b) if anywhere else None):
                use = left(ticket(string, row_hash, row_id, anchor))
                if not use.any():
                    continue
                row_id, row_hash, near, far, anchor, place = (x[use] for x in (row_id, row_hash, near, far, anchor, place))
                times = far - near + 1
                at = np.repeat(np.arange(len(times)), times)
                d = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + near[at]
                p = place[at] - d
                parts.append((row_id[at], row_hash[at], ids[p], ids[p + q], anchor[at] - d))
            if parts:
                yield _batch(dict(zip(("__id", "__hash", "s1", "s2", "lo"), _joined(parts, 5), strict=True)))

    window = keep(unsettled.mapInArrow(windows, _longs("__id", "__hash", "s1", "s2", "lo")), "windows")
    n_windows = window.count()
    for bitmap in passing:
        bitmap.destroy()
    of_window = keep(window.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    single = shared_rows(window, of_window, ["s1", "s2"], n_windows).selectExpr("__id", "__hash", "lo", "lo AS hi")
    return whole.union(part).union(single)


def covered(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of symbols that the windows starting at lo to hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], hi[order] + length
    reach = np.maximum.accumulate(end)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    begins = np.flatnonzero(new)
    return lo[begins], reach[np.append(begins[1:] - 1, len(lo) - 1)]


FOUND = "doc_id bigint, kept binary, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, passages array<struct<begin:bigint,end:bigint>>"


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that remain), n_bytes, spans (array of begin, end: the bytes removed) and passages (the same in words, of
    passages of 50 words that start elsewhere too; they aren't removed for it) of every row."""
    found = [keep(repeated(docs, unit), f"repeats-{unit.name}").withColumn("words", F.lit(unit == WORDS)) for unit in (BYTES, WORDS)]
    runs_of = lambda words: F.collect_set(F.when(F.col("words") == words, F.struct("lo", "hi")))  # noqa: E731  sets: rows equal in id and text share them
    spans = found[0].union(found[1]).groupBy("__id", "__hash").agg(runs_of(False).alias("runs"), runs_of(True).alias("word_runs"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    joined = keyed.join(spans.hint("shuffle_hash"), ["__id", "__hash"], "left").select("doc_id", "text", "runs", "word_runs")

    def merged(runs, length: int) -> tuple[np.ndarray, np.ndarray]:
        if not runs.is_valid or not len(runs.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return covered(*(runs.values.field(f).to_numpy() for f in ("lo", "hi")), length)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            kept, sizes, spans, passages = [], [], [], []
            for text, by_bytes, by_words in zip(b.column("text").to_pylist(), b.column("runs"), b.column("word_runs"), strict=True):
                sizes.append(len(text))
                begins, ends = merged(by_bytes, BYTES.length)
                kept.append(b"".join(text[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True)) if len(begins) else text)
                for out, (x, y) in ((spans, (begins, ends)), (passages, merged(by_words, WORDS.length))):
                    out.append([{"begin": i, "end": j} for i, j in zip(x.tolist(), y.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(passages, kind)], ["doc_id", "kept", "n_bytes", "spans", "passages"])

    return joined.mapInArrow(cut, FOUND)


def digest(found: DataFrame) -> DataFrame:
    size = lambda spans: F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"]), F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        size("passages").alias("n_passage_words"),
    )
