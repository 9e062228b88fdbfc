r"""Alignment of two tokenizers' tokens over the same bytes, corpus-wide.

Both sides' tokens cover a document's bytes. Where a token of A and one of B end together there is a cut (and a link of the two);
cuts part the tokens into groups. The work is relational: posexplode the tokens, cumulate their lengths in a window, equi-join the sides on
text and end, count the cuts before a token for its group's number, and group. Texts are dealt out once; all of this stays where they are
(the full outer equi-join is written as a grouping of both sides' rows by text and end, as Spark forgets how such a join's rows are dealt).

What is exploded are not the documents but the corpus' different stretches. Both tokenizers always end a token before a space that follows
a character other than white space, and none of theirs goes beyond: so a document's alignment is that of its stretches (a word
with the white space before it, as a rule) one after the other, and a stretch is aligned once, however often it occurs. Counts of
links weigh a stretch by its occurrences.

Documents get their figures back from their stretches: the most frequent short ones, HEAD at most, are broadcast; a text's others are joined
by stretch, gathered by text, and joined with the texts. So are the corpus-wide counts of id pairs: the most frequent, PAIRS at most, are
broadcast, the others joined.

Nulls, empty texts and texts that B can't reproduce (those with its mark for the space, U+2581) have no tokens: zeros and ''. Texts of
white space alone are one stretch. Repeated rows: each counts and gets its row. Null ids are ids like any other. Very long texts are taken
whole; a text without spaces is one stretch, whose tokens are rows. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import _encoders, encoder
from .util import columns_of_binary, head_of, hot_from, keep, lookup, row_key, small_batches, sorted_aggregates

#: So many stretches at most are broadcast, of up to LONG bytes; and so many id pairs.
HEAD, LONG, PAIRS = 400_000, 32, 1 << 19
#: So many stretches a task holds before it counts them and hands them on.
COUNTED = 5_000_000
#: Stands for the space in the pieces of B.
MARK = "▁"
#: The bytes of white space: of characters of one byte, of two and of three.
BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
BLANK_2 = np.array([0xC285, 0xC2A0])
BLANK_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: So many bytes of texts are told at once, or one text.
TOLD = 4 << 20


def cut(texts):
    """The stretches of an Arrow array of texts, as bytes: a space and the text, parted before each space that follows a character other
    than white space. And n+1 offsets: those of text i are at[i] to at[i+1]. A text without tokens has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    empty, space = pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())
    none = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring(texts, MARK))
    raw, ends = columns_of_binary(pc.if_else(none, empty, pc.binary_join_element_wise(empty, texts, space)))
    at = np.flatnonzero(raw == 32)
    last = raw[at - 1]
    parted = ~BLANK[last]
    high = np.flatnonzero(last >= 128)  # the character has its two or three bytes in the same text
    code = sum(raw[at[high] - k].astype(np.int32) << 8 * (k - 1) for k in (1, 2, 3))
    parted[high] = ~(np.isin(code & 0xFFFF, BLANK_2) | np.isin(code, BLANK_3))
    parted[np.searchsorted(at, ends[:-1][ends[1:] > ends[:-1]])] = True
    at = np.append(at[parted], len(raw)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))]), np.searchsorted(at, ends)


def listed(array) -> list:
    """An Arrow array of strings or bytes as a list, in a tenth of the time that to_pylist() takes."""
    return array.to_numpy(zero_copy_only=False).tolist()


def stretches(text: str | None) -> list[str]:
    """The stretches of a text, each without the space that it begins with."""
    import pyarrow as pa

    return [s[1:].decode() for s in listed(cut(pa.array([text], pa.string()))[0])]


class Pieces:
    """Tokens of B: a SentencePiece model that takes texts as they are and falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        self.sizes = np.array([1 if self.coder.is_byte(i) else len(self.coder.id_to_piece(i).replace(MARK, " ").encode()) for i in range(n)], np.int32)
        # Else a document's tokens weren't those of its stretches.
        assert sum(map(self.coder.is_byte, range(n))) == 256 and not any(MARK in self.coder.id_to_piece(i).lstrip(MARK) for i in range(n))

    def ids(self, stretches: list[str]) -> list[list[int]]:
        """The ids of stretches, whose first space the model adds."""
        space = [self.coder.piece_to_id(MARK)]
        return [ids if s else space for s, ids in zip(stretches, self.coder.encode(stretches, num_threads=1), strict=True)]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def forget() -> None:
    """A worker that did encode needs its place for the figures."""
    _pieces.clear()
    _encoders.clear()


def counted(docs: DataFrame) -> DataFrame:
    """stretch, n (occurrences) of the corpus."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(found: list) -> Iterator:
            told = pc.value_counts(pa.chunked_array(found, pa.large_binary()))
            raw, ends = columns_of_binary(told.field("values"))
            raw, ends = np.delete(raw, ends[:-1]), ends - np.arange(len(ends))  # without their first spaces
            bare = pa.LargeStringArray.from_buffers(len(told), pa.py_buffer(ends), pa.py_buffer(raw))
            for i in range(0, len(told), 20_000):
                yield pa.RecordBatch.from_arrays([bare[i : i + 20_000].cast(pa.string()), told.field("counts")[i : i + 20_000]], ["stretch", "n"])

        found, held = [], 0
        for b in batches:
            found.append(cut(b.column("text"))[0])
            held += len(found[-1])
            if held > COUNTED:
                yield from out(found)
                found, held = [], 0
        yield from out(found)

    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "stretch string, n bigint").groupBy("stretch").agg(F.sum("n").alias("n"))


#: A token is its id and, in the lowest bits, its size in bytes.
SIZE_BITS = 10


def encoded(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """n, n_a and tokens of found(stretch, n): the tokens of A, n_a of them, and then those of B. Those of A tell the stretch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a, b = encoder(path_a), pieces(path_b)
        size_a = np.zeros(a.size, np.int32)
        for token, i in a.coder._mergeable_ranks.items():
            size_a[i] = len(token)
        assert max(size_a.max(), b.sizes.max()) < 1 << SIZE_BITS
        for batch in batches:
            texts = listed(batch.column("stretch"))
            flat, counts = [], []
            for own_a, own_b in zip((a.ordinary(" " + t) for t in texts), b.ids(texts), strict=True):
                flat += own_a
                flat += own_b
                counts += (len(own_a), len(own_b))
            flat, counts = np.array(flat, np.int32), np.array(counts, np.int64)
            of_b = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
            flat[~of_b] = flat[~of_b] << SIZE_BITS | size_a[flat[~of_b]]
            flat[of_b] = flat[of_b] << SIZE_BITS | b.sizes[flat[of_b]]
            at = pa.array(np.concatenate(([0], np.cumsum(counts)[1::2])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(counts[::2].astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(flat))], ["n", "n_a", "tokens"])

    return found.select("stretch", "n").mapInArrow(run, "n bigint, n_a int, tokens array<int>")


def ends(texts: DataFrame) -> DataFrame:
    """key, n, side (0: A, 1: B), id and end (in bytes) of all tokens of texts(key, n, n_a, tokens)."""
    each = texts.select("key", "n", "n_a", F.posexplode("tokens").alias("pos", "t")).select("key", "n", (F.col("pos") >= F.col("n_a")).cast("int").alias("side"), "pos", "t")
    before = Window.partitionBy("key", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("key", "n", "side", F.shiftright("t", SIZE_BITS).alias("id"), F.sum(F.col("t").bitwiseAND((1 << SIZE_BITS) - 1)).over(before).alias("end"))


def numbered(texts: DataFrame) -> DataFrame:
    """key, n, end, a, b (the tokens that end there, one of them null if it isn't a cut) and group, the number of cuts before."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))  # noqa: E731  no token is empty, so a side has one there
    met = ends(texts).groupBy("key", "end").agg(F.max("n").alias("n"), of(0).alias("a"), of(1).alias("b"))
    so_far = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("group", F.coalesce(F.sum(F.expr("if(a IS NOT NULL AND b IS NOT NULL, 1, 0)")).over(so_far), F.lit(0)))


def groups(texts: DataFrame) -> DataFrame:
    """n, size (in bytes), n_a, n_b, n_groups, groups ('a1,a2|b1;a3|b2': the tokens between cuts, in order) and links (the pairs that end
    together) of texts(key, n, n_a, tokens)."""
    token = lambda side, c: F.when(F.col(c).isNotNull(), F.struct("group", F.lit(side).alias("side"), "end", F.col(c).alias("id")))
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    each = numbered(texts).groupBy("key").agg(
        F.max("n").alias("n"), F.max("end").alias("size"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(cut).alias("n_groups"), F.collect_list(token(0, "a")).alias("of_a"), F.collect_list(token(1, "b")).alias("of_b"), F.collect_list(F.when(cut, F.struct("a", "b"))).alias("links")
    )
    each = each.withColumn("told", F.sort_array(F.concat("of_a", "of_b")))
    before = lambda t, last: F.when(last.isNull(), "").when(last["group"] != t["group"], ";").when(last["side"] != t["side"], "|").otherwise(",")
    said = F.array_join(F.transform("told", lambda t, i: F.concat(before(t, F.get("told", i - 1)), t["id"].cast("string"))), "")
    return each.select("n", "size", "n_a", "n_b", "n_groups", said.alias("groups"), "links")


def _code(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def counts(aligned: DataFrame) -> DataFrame:
    """code (of the pair), rows, count (links corpus-wide) and best (1 if no pair with this id of B has more). Stored."""
    each = aligned.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("rows"))
    each = keep(each, "counts")
    most = keep(each.groupBy("b").agg(F.max("count").alias("most")), "highest")
    told = lookup(each, most, ["b"], each.count())
    return keep(told.select(_code(F.col("a"), F.col("b")).alias("code"), "rows", "count", (F.col("count") == F.col("most")).cast("long").alias("best")), "counts-and-highest")


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


class Scorer:
    """Turns rows of the stored groups() into stretch, n and FIGURES, with the corpus-wide counts of their links."""

    def __init__(self, aligned: DataFrame, path_a: str, pairs: int):
        self.path_a = path_a
        self.count = counts(aligned)
        self.frequent = head_of(self.count, "rows", pairs)
        often = self.count.where(self.frequent).select("code", "count", "best").toArrow()
        order = np.argsort(often["code"].to_numpy())
        self.known = aligned.sparkSession.sparkContext.broadcast(tuple(often[c].to_numpy()[order] for c in ("code", "count", "best")))
        self.all_known = not self.count.where(~self.frequent).take(1)

    def told(self, aligned: DataFrame) -> DataFrame:
        known, path_a = self.known, self.path_a

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            code, count, best = known.value
            token = {str(i): t for t, i in encoder(path_a).coder._mergeable_ranks.items()}
            for b in batches:
                stretch = [b"".join([token[i] for g in s.split(";") for i in g[: g.index("|")].split(",")])[1:].decode() for s in listed(b.column("groups"))]
                lists = b.column("links")
                at = lists.offsets.to_numpy().astype(np.int64)
                a_of, b_of = (x.to_numpy().astype(np.int64) for x in lists.values[at[0] : at[-1]].flatten())
                flat = (a_of << 32) + b_of
                at -= at[0]
                place = np.minimum(np.searchsorted(code, flat), max(len(code) - 1, 0))
                hit = code[place] == flat if len(code) else np.zeros(len(flat), bool)
                sums = [np.concatenate(([0], np.cumsum(np.where(hit, x[place], 0) if len(code) else hit.astype(np.int64)))) for x in (best, count)]
                n_rare = np.concatenate(([0], np.cumsum(~hit)))
                rare = pa.ListArray.from_arrays(pa.array(n_rare[at].astype(np.int32)), pa.array(flat[~hit]))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(stretch, pa.string()), *(pa.array(x[at[1:]] - x[at[:-1]]) for x in (np.arange(len(flat) + 1), *sums)), rare], [*b.schema.names[:6], "stretch", "n_links", "n_best", "count_sum", "rare"])

        own = aligned.select(F.monotonically_increasing_id().alias("key"), "n", "n_a", "n_b", "n_groups", "groups", "links")
        schema = "key bigint, n bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, stretch string, n_links bigint, n_best bigint, count_sum bigint, rare array<bigint>"
        told = own.mapInArrow(run, schema)
        if not self.all_known:
            told = keep(told, "figures")
            left = keep(told.select("key", F.explode("rare").alias("code")), "rare-links")
            met = lookup(left, self.count.where(~self.frequent).select("code", "best", "count"), ["code"], left.count(), "inner")
            more = met.groupBy("key").agg(F.sum("best").alias("more_best"), F.sum("count").alias("more_sum"))
            told = told.join(more.hint("shuffle_hash"), "key", "left")
            told = told.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
        return told.select("stretch", "n", *FIGURES)


class Told:
    """Figures by stretch, from Arrow columns of stretches and groups, FIGURES without groups, and the tokens of A."""

    def __init__(self, stretches, numbers: list[np.ndarray], groups, tokens: dict[bytes, int]):
        import pyarrow.compute as pc

        self.names = pc.binary_join_element_wise("", stretches, " ").combine_chunks()
        self.small = np.stack(numbers[:-1], axis=1).astype(np.uint8)  # a stretch has LONG bytes at most
        self.sums = numbers[-1]
        self.groups = pc.binary_join_element_wise(groups, "", ";").combine_chunks().cast("large_binary")
        self.token = {str(i): t for t, i in tokens.items()}

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {s: i for i, s in enumerate(map(str.encode, listed(self.names)))}

    def places(self, names: list[bytes]) -> np.ndarray:
        """Where the stretches' figures are; -1 if they are rare."""
        return np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))

    def unpacked(self, row: str) -> tuple[bytes, tuple]:
        """A rare stretch, its figures and groups, from packed()."""
        best, total, groups = row.split(" ")
        a = [i for p in groups.split(";") for i in p[: p.index("|")].split(",")]
        n = groups.count(";") + 1  # each group ends with a link
        return b"".join([self.token[i] for i in a]), (len(a), groups.count(",") + 2 * n - len(a), n, n, int(best), int(total), f"{groups};".encode())

    def of(self, texts, more) -> tuple[np.ndarray, list[str]]:
        """The sums and the groups' hashes of an Arrow array of texts; more: lists of their rare stretches' packed()."""
        import pyarrow as pa

        each, at = cut(texts)
        coded = each.dictionary_encode()
        names, index = listed(coded.dictionary), coded.indices.to_numpy()
        place = self.places(names)
        known, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        own = dict(map(self.unpacked, listed(more.flatten())))
        rows = [own[names[i]] for i in rare.tolist()]
        numbers = np.zeros((len(names), 6), np.int64)
        numbers[known, :5], numbers[known, 5] = self.small[place[known]], self.sums[place[known]]
        numbers[rare] = np.array([r[:6] for r in rows], np.int64).reshape(-1, 6)
        groups = pa.concat_arrays([self.groups.take(pa.array(place[known])), pa.array([r[6] for r in rows], pa.large_binary())])
        order = np.empty(len(names), np.int64)
        order[np.concatenate((known, rare))] = np.arange(len(names))
        raw, ends = columns_of_binary(groups.take(pa.array(order[index])))
        ends = ends[at]
        sums = np.zeros((len(texts), 6), np.int64)
        for c in range(6):
            so_far = np.concatenate(([0], np.cumsum(numbers[index, c])))
            sums[:, c] = so_far[at[1:]] - so_far[at[:-1]]
        return sums, [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def packed() -> Column:
    """What Told.unpacked() takes: the groups tell the stretch and the other figures."""
    return F.concat_ws(" ", "n_best", "count_sum", "groups")


def joined_apart(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str) -> DataFrame:
    """left with right's columns by the key; rows of the stored hot keys (few) meet theirs by a broadcast. right, where it is dealt by the
    key, stays."""
    if not hot.take(1):
        return left.join(right, key, how)
    hot = F.broadcast(hot.select(key))
    cold = left.join(hot, key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how))


def aligned(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD, pairs: int = PAIRS) -> DataFrame:
    """doc_id, FIGURES without groups, and groups_sha256 of every row."""
    spark = docs.sparkSession
    coded = keep(encoded(counted(docs), path_a, path_b).withColumn("key", F.monotonically_increasing_id()), "tokens")
    with sorted_aggregates(spark):
        each = keep(groups(coded.repartition("key")), "stretches-aligned")
    scorer = Scorer(each, path_a, pairs)
    short = F.col("size") <= LONG
    frequent = head_of(each.where(short), "n", head) & short
    often = scorer.told(each.where(frequent)).select("stretch", *FIGURES).toArrow()
    known = spark.sparkContext.broadcast(Told(often["stretch"], [often[c].to_numpy() for c in FIGURES[:-1]], often["groups"], encoder(path_a).coder._mergeable_ranks))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs)[1], F.col("text").cast("string").alias("text"))

    def seldom(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        forget()
        for b in batches:
            each, at = cut(b.column("text"))
            coded = each.dictionary_encode()
            names, index = listed(coded.dictionary), coded.indices.to_numpy()
            rare = known.value.places(names) < 0
            hashes = np.zeros(len(names), np.uint64)  # as Spark has them
            hashes[rare] = [xxhash.xxh64_intdigest(names[i][1:], 42) for i in np.flatnonzero(rare).tolist()]
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            asked = rare[index]
            of, index = np.divmod(np.unique(of[asked] * len(names) + index[asked]), max(len(names), 1))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(at))).astype(np.int32)), pa.array(hashes[index].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("__hash"), lists], ["__hash", "rare"])

    def pressed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__hash"), pa.array([press.compress(t.encode()) if t else None for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "__hash", "text"])

    rare = keep(texts.select("__hash", "text").mapInArrow(seldom, "__hash bigint, rare array<bigint>"), "rare-stretches")
    n_rows, n_rare = rare.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("rare")), F.lit(0))).first()
    copies = rare.groupBy("__hash").agg(F.count(F.lit(1)).alias("n"), F.first("rare").alias("rare"))  # of a text
    asked = copies.select("__hash", F.explode("rare").alias("stretch"))
    # joined by hashes: the figures tell their stretch, so those of another with the same hash do no harm
    rest = scorer.told(each.where(~frequent)).select(F.xxhash64("stretch").alias("stretch"), packed().alias("figures"))
    few = each.where(~short & (F.col("n") > hot_from(n_rare)))  # a short one's occurrences are less than HEAD others' have
    met = joined_apart(asked, rest, "stretch", keep(scorer.told(few).select(F.xxhash64("stretch").alias("stretch")).distinct(), "hot-stretches"), "inner")
    more = met.groupBy("__hash").agg(F.collect_list("figures").alias("more"))
    hot = keep(rare.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from(n_rows)), "hot-texts")
    joined = joined_apart(texts.mapInArrow(pressed, "doc_id bigint, __hash bigint, text binary"), more, "__hash", hot, "left")

    def told_of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        forget()
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([t and press.decompress(t) for t in batch.column("text").to_pylist()], pa.large_binary())
            more, bound = batch.column("more"), columns_of_binary(texts)[1]
            told, i = [], 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(bound, bound[i] + TOLD, "right")) - 1)
                told.append(known.value.of(texts[i:j], more[i:j]))
                i = j
            sums = np.concatenate([np.zeros((0, 6), np.int64), *(x for x, _ in told)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(sums[:, i].copy()) for i in range(6)), pa.array([x for _, own in told for x in own], pa.string())], ["doc_id", *FIGURES[:-1], "groups_sha256"])

    kinds = ", ".join(f"{f} bigint" for f in FIGURES[:-1])
    return joined.select("doc_id", "text", "more").mapInArrow(told_of, f"doc_id bigint, {kinds}, groups_sha256 string")
