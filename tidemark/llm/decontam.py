"""Benchmark decontamination by spaced seeds.

Texts become lower-cased tokens (ASCII punctuation and white space separate) and token hashes. A seed is a fixed mask of
positions; the hash of the tokens at its ones ignores the others, so a substituted token at an ignored place doesn't hide a hit.
The three masks are lossless: any 13 tokens with up to 2 substitutions, 15 with 3 or 20 with 4 hold a hit of one of them.
Seed hashes of benchmark items are joined with those of all documents; each hit fixes a diagonal (places in item and
document), along which the longest overlap with a share of equal tokens of IDENTITY or more is found. It counts if it is LENGTH
tokens long, or most (IDENTITY) of a shorter item. Of a document's and item's overlaps that with the most equal tokens counts, then
the first in the document.

The benchmark is the small side: its items are dealt into blocks of about BLOCK_BYTES of text, and each block's seeds are
broadcast and joined with all documents in one pass; a benchmark of any size takes as many passes as it has blocks. Documents
are never shuffled. A document and item have fewer diagonals than tokens; where repeated tokens make more hits than that, the
diagonals are compared and the hits not listed, so that work and memory stay in proportion to the texts.

Nulls and empty texts match nothing, as do items of fewer than 5 tokens. Repeated rows (documents or items) give their rows
each. Very long texts are scanned whole. Empty tables give an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import keep, keep_rows, mixed, row_key

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5))
IDENTITY = 0.8
LENGTH = 13
BLOCK_BYTES = 8_000_000
CHUNK_TOKENS = 1 << 19

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def token_hashes(text: str) -> list[int]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return [digest(w) for w in text.lower().encode().translate(_PLAIN).split()]


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed hash at each position with a whole mask."""
    n = max(0, len(tokens) - mask[-1])
    out = np.zeros(n, np.uint64)
    for i, k in enumerate(mask):
        out = out * np.uint64(0xD1342543DE82EF95) + tokens[k : k + n] * np.uint64(2 * i + 1)
    return mixed(out)


class Block:
    """Seeds of some items, sorted by hash and item, with a bitmap to skip most of the documents' hashes."""

    BITS = 22

    def __init__(self, items: list[tuple[int | None, str]]):
        tokens = [np.array(token_hashes(t), np.uint64) for _, t in items]
        self.ids = [i for i, _ in items]
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.tables = []
        self.bitmap = np.zeros(1 << self.BITS, bool)
        for mask in MASKS:
            found = [(seeds(t, mask), b) for t, b in zip(tokens, self.bounds, strict=False)]
            h = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            at = np.concatenate([b + np.arange(len(x)) for x, b in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            item = np.searchsorted(self.bounds, at, side="right") - 1
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
            first = np.flatnonzero(new)  # of the groups of equal seed and item
            self.tables.append((h[first], at, item[first], first, np.diff(np.append(first, len(h)))))
            self.bitmap[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def groups(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        """Places in tokens and groups of the table with equal seeds, a bounded number at a time."""
        for mask, table in zip(MASKS, self.tables, strict=True):
            own = seeds(tokens, mask)
            maybe = np.flatnonzero(self.bitmap[(own & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            first = np.searchsorted(table[0], own[maybe], "left")
            n = np.searchsorted(table[0], own[maybe], "right") - first
            maybe, first, n = maybe[n > 0], first[n > 0], n[n > 0]
            for part in _portions(n):
                yield np.repeat(maybe[part], n[part]), _ranges(first[part], n[part]), table


def _portions(n: np.ndarray, most: int = 1 << 22) -> Iterator[slice]:
    """Slices of n with sums of about `most`."""
    sums, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + most, "right")))
        yield slice(begin, end)
        begin = end


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of n[i] numbers each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def longest(equal: np.ndarray, identity: float = IDENTITY) -> tuple[int, int]:
    """Begin and end of the longest stretch with a share of equal tokens of `identity` or more; the first of equal ones."""
    scale = 1000
    sums = np.concatenate(([0], np.cumsum(np.where(equal, scale - round(identity * scale), -round(identity * scale)))))
    low = np.minimum.accumulate(sums)
    high = np.maximum.accumulate(sums[::-1])[::-1]
    # for each begin the last end not below it; `high` falls, so that is a search in its reverse
    ends = len(high) - 1 - np.searchsorted(high[::-1], sums, "left")
    width = np.where(sums == low, ends - np.arange(len(sums)), 0)
    begin = int(np.argmax(width))
    return begin, int(ends[begin])


def best_overlap(item: np.ndarray, text: np.ndarray, shifts: np.ndarray | None) -> tuple[int, int, int, int] | None:
    """text begin, item begin, length and equal tokens of the best overlap (most equal tokens; then first in the text, then least
    shift) on the diagonals text place - item place in shifts, or on all that hold a hit (None)."""
    n = len(item)
    if shifts is None:  # whole diagonals are compared, so a hit is seen in them
        wide = np.concatenate([np.zeros(n - 1, np.uint64), text, np.zeros(n - 1, np.uint64)])
        windows = np.lib.stride_tricks.sliding_window_view(wide, n)
        total, hit, rows = np.zeros(len(windows), np.int64), np.zeros(len(windows), bool), max(1, (1 << 22) // n)
        for a in range(0, len(windows), rows):
            equal = windows[a : a + rows] == item
            total[a : a + rows] = equal.sum(1)
            for mask in MASKS:
                if n > mask[-1]:
                    hit[a : a + rows] |= np.logical_and.reduce([equal[:, k : n - mask[-1] + k] for k in mask]).any(1)
        at = np.flatnonzero(hit)
        at = at[np.argsort(-total[at], kind="stable")]
        todo = [(int(i) - n + 1, int(total[i])) for i in at]
    else:
        todo = [(s, n) for s in shifts.tolist()]
    best, key = None, (-1, 0, 0)
    for shift, most in todo:
        begin, end = max(0, -shift), min(n, len(text) - shift)
        if (most, -(begin + shift)) < key[:2]:  # it can't become better
            continue
        equal = item[begin:end] == text[begin + shift : end + shift]
        if (int(equal.sum()), -(begin + shift)) < key[:2]:
            continue
        a, b = longest(equal)
        if b - a >= LENGTH or n < LENGTH and b - a >= 5 and b - a >= IDENTITY * n:
            found = (int(equal[a:b].sum()), -(begin + a + shift), -shift)
            if found > key:
                best, key = (begin + a + shift, begin + a, b - a, found[0]), found
    return best


def overlaps(block: Block, tokens: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """document, item, document begin, item begin, length, equal tokens; the best overlap of each document and item.

    The work is bounded by the number of diagonals: a document and item with more hits than those (repetitive texts) have all
    their diagonals compared instead, and their hits aren't listed."""
    items = len(block.ids)
    pair_of = lambda ours, group, table: (np.searchsorted(bounds, ours, side="right") - 1) * items + table[2][group]
    keys, sums = [], []
    for ours, group, table in block.groups(tokens):
        pair, back = np.unique(pair_of(ours, group, table), return_inverse=True)
        keys.append(pair)
        sums.append(np.bincount(back, table[4][group]))
    if not keys:
        return []
    pairs, back = np.unique(np.concatenate(keys), return_inverse=True)
    hits = np.bincount(back, np.concatenate(sums))
    dense = hits > np.diff(bounds)[pairs // items] + np.diff(block.bounds)[pairs % items]
    diagonals = []
    if not dense.all():
        for ours, group, table in block.groups(tokens):
            pair = pair_of(ours, group, table)
            use = ~dense[np.searchsorted(pairs, pair)]
            ours, group, pair = ours[use], group[use], pair[use]
            for part in _portions(table[4][group]):
                n = table[4][group[part]]
                theirs = table[1][_ranges(table[3][group[part]], n)]
                p = np.repeat(pair[part], n)
                shift = (np.repeat(ours[part], n) - bounds[p // items]) - (theirs - block.bounds[p % items])
                diagonals.append(np.unique(np.stack([p, shift]), axis=1))
    found = np.unique(np.concatenate(diagonals, axis=1), axis=1) if diagonals else np.zeros((2, 0), np.int64)
    cuts = np.searchsorted(found[0], pairs), np.searchsorted(found[0], pairs, "right")
    out = []
    for pair, whole, x, y in zip(pairs.tolist(), dense.tolist(), *(c.tolist() for c in cuts), strict=True):
        d, i = divmod(pair, items)
        text, item = tokens[bounds[d] : bounds[d + 1]], block.tokens[block.bounds[i] : block.bounds[i + 1]]
        if whole or y > x:
            if (met := best_overlap(item, text, None if whole else found[1, x:y])) is not None:
                out.append((d, i, *met))
    return out


FOUND = "doc_id bigint, __id bigint, __hash bigint, item_id bigint, doc_begin int, item_begin int, length int, equal int, item_tokens int"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text) and of items(item_id, text) that overlap: the place and size of the best overlap in tokens."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = []
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in part.toLocalIterator()]))
        out.append(texts.mapInArrow(_scan(shared), FOUND))
    return reduce(DataFrame.union, out)


def _scan(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = shared.value
        kinds = [pa.int64()] * 4 + [pa.int32()] * 5
        for b in batches:
            ids, keys, hashes = (b.column(c).to_pylist() for c in ("doc_id", "__id", "__hash"))
            rows, tokens, starts, first = [], [], [0], 0

            def flush(first: int, tokens: list[int], starts: list[int]) -> list[tuple]:
                found = overlaps(block, np.array(tokens, np.uint64), np.array(starts))
                return [(ids[first + d], keys[first + d], hashes[first + d], block.ids[i], x, y, n, e, int(block.bounds[i + 1] - block.bounds[i])) for d, i, x, y, n, e in found]

            for i, text in enumerate(b.column("text")):
                tokens += token_hashes(text.as_py())
                starts.append(len(tokens))
                if len(tokens) >= CHUNK_TOKENS:
                    rows += flush(first, tokens, starts)
                    tokens, starts, first = [], [0], i + 1
            if len(starts) > 1:
                rows += flush(first, tokens, starts)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return run


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "item_id", "doc_begin", "item_begin", "length", "equal", "item_tokens")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that overlap with an item."""
    return keep_rows(docs, keep(contaminated(docs, items), "overlaps").select("__id", "__hash").distinct())
