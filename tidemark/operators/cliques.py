"""Reach and likeness of nodes that are linked because they are in common groups, without a table of the links.

A group of m members makes m (m - 1) / 2 links, so links grow with the square of the groups. Here nodes are numbered and packed in blocks,
and each task holds one part of the nodes (the sources) and is passed all blocks, a few at a time, once for every step that it takes. It
keeps what its sources have reached of each group: bits, or counts. So a task's memory is bounded by BYTES, the shuffle is the blocks times
the parts, and all pairs of nodes are looked at, but none is written.

members(node, group columns) without repeats and nulls; weights(node, weight): as many nodes with the same groups as a node stands for. Two
nodes' effect is half the number of their common groups, 1 at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import numbered
from tidemark.session import stored

#: Nodes of a block, and what a task may hold for its sources.
ROWS, BYTES = 2048, 1 << 27
#: Entries of a block that are looked at together.
AT_ONCE = 4096


class Blocks:
    """nodes(node, i, weight, gs: its groups' numbers), and rows(block, weights, sizes, gs) of `rows` nodes each; all stored. Groups
    without a link are left out, and so are nodes without a group."""

    def __init__(self, members: DataFrame, group: Sequence[str], node: str, weights: DataFrame) -> None:
        known = members.select(F.col(node).alias("node"), *group).join(weights.select("node", "weight"), "node")
        large = known.groupBy(*group).agg(F.sum("weight").alias("m")).where("m > 1").select(*group)
        groups = stored(numbered(large, list(group), "g"))
        self.groups = groups.count()
        each = known.join(groups, list(group)).groupBy("node").agg(F.first("weight").alias("weight"), F.sort_array(F.collect_list(F.col("g").cast("int"))).alias("gs"))
        self.nodes = stored(numbered(each, ["node"], "i"))
        self.n = self.nodes.count()

    def passed(self, rows: int, parts: int, passes: int, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
        """run, of the blocks of `rows` nodes as each part of the sources sees them: `parts` blocks of its own (pass -1), then all blocks in
        every pass. Stored."""
        spark = self.nodes.sparkSession
        each = self.nodes.select(F.floor(F.col("i") / rows).cast("int").alias("block"), F.struct("i", "weight", "gs").alias("r")).groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r"))
        blocks = stored(each.select("block", F.col("r.weight").alias("weights"), F.transform("r", lambda r: F.size(r["gs"])).alias("sizes"), F.flatten("r.gs").alias("gs")))
        many = -(-self.n // (rows * parts))
        dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(many, 1) - 1))))
        own = F.floor(F.col("block") / parts) == F.col("part")
        turns = dealt.withColumn("pass", F.explode(F.when(own, F.sequence(F.lit(-1), F.lit(passes - 1))).otherwise(F.sequence(F.lit(0), F.lit(passes - 1)))))
        turns = turns.repartitionById(max(many, 1), "part").sortWithinPartitions("part", "pass", "block")
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(name)
        spark.conf.set(name, "16")
        try:
            return stored(turns.mapInArrow(run, schema))
        finally:
            spark.conf.set(name, before)


class Block:
    """A block's nodes: numbers from `first` on, weights, and groups (of node at[k], groups[k])."""

    def __init__(self, first: int, weights: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> None:
        self.first, self.weights, self.sizes, self.groups = first, weights, sizes, groups
        self.at = np.repeat(np.arange(len(sizes)), sizes)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes in the order of their groups, where each group begins, and the groups."""
        order = np.argsort(self.groups, kind="stable")
        names, starts = np.unique(self.groups[order], return_index=True)
        return self.at[order], starts, names

    def by_turn(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and a group of each, no group twice at a time: every group's first node, its second one, and so on."""
        at, starts, names = self.sorted()
        sizes = np.diff(np.append(starts, len(at)))
        turn = np.arange(len(at)) - np.repeat(starts, sizes)
        order, groups = np.argsort(turn, kind="stable"), np.repeat(names, sizes)
        ends = np.cumsum(np.bincount(turn))
        for first, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(at) else ():
            for k in range(first, end, AT_ONCE // 16):
                some = order[k : min(k + AT_ONCE // 16, end)]
                yield at[some], groups[some]

    def padded(self, none: int) -> np.ndarray:
        """A row of groups for each node, filled up by `none`."""
        out = np.full((len(self.sizes), int(self.sizes.max(initial=0))), none, np.int64)
        out[self.at, np.arange(len(self.groups)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)] = self.groups
        return out


def turns(batches: Iterator, rows: int) -> Iterator[tuple[int, int, Block]]:
    """part, pass and block, one by one."""
    for b in batches:
        part, turn, block = (b.column(c).to_pylist() for c in ("part", "pass", "block"))
        lists = [b.column(c) for c in ("weights", "sizes", "gs")]
        for k in range(b.num_rows):
            yield part[k], turn[k], Block(block[k] * rows, *[np.asarray(c[k].values.to_numpy(zero_copy_only=False), np.int64) for c in lists])


def reach(blocks: Blocks, depths: Sequence[int]) -> DataFrame:
    """node, degree, mean_effect, and reach_d for each depth d: how many other nodes are within d steps; of nodes with a link."""
    n_groups, last = blocks.groups, max(depths)
    rows = int(np.clip(BYTES // 4 // max(n_groups, 1) * 8, 64, ROWS)) // 64 * 64
    parts = int(np.clip(BYTES // 4 * 8 // (max(n_groups, 1) * rows), 1, 8))
    total = blocks.n

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[Block] = []
        now = turned = 0
        part = None

        def told() -> pa.RecordBatch:
            own = np.concatenate([b.weights for b in held])
            names = ["i", "degree", "effects", *[f"reach_{d}" for d in depths]]
            first = held[0].first
            cols = [np.arange(first, first + len(own)), counts[0] - 1, effects - np.minimum(1, np.concatenate([b.sizes for b in held]) / 2), *[counts[d - 1] - 1 for d in depths]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for p, turn, block in turns(batches, rows):
            if p != part:
                if part is not None:
                    yield told()
                part, held, turned = p, [], -1
            if turn < 0:
                held.append(block)
                continue
            if turn > turned:
                if turn == 0:  # bit k of a group's row: whether the part's k-th node is in it
                    size = min(rows * parts, total - held[0].first)
                    mask = np.zeros((n_groups + 1, rows * parts // 8), np.uint8)
                    for b in held:
                        k = b.at + b.first - held[0].first
                        np.bitwise_or.at(mask, (b.groups, k >> 3), (128 >> (k & 7)).astype(np.uint8))
                    counts, effects = np.zeros((last, size), np.int64), np.zeros(size)
                else:
                    mask = after
                after, turned = mask.copy(), turn
            one, two = np.zeros((len(block.sizes), mask.shape[1]), np.uint8), np.zeros((len(block.sizes), mask.shape[1]), np.uint8)
            for of in block.padded(n_groups).T:
                more = mask[of]
                if turn == 0:
                    two |= one & more
                one |= more
            counts[turn] += weighed(one, block.weights, size)
            if turn == 0:
                effects += (weighed(one, block.weights, size) + weighed(two, block.weights, size)) / 2
            if turn + 1 < last:
                for at, groups in block.by_turn():
                    after[groups] |= one[at]
        if part is not None:
            yield told()

    each = blocks.passed(rows, parts, last, run, "i bigint, degree bigint, effects double, " + ", ".join(f"reach_{d} bigint" for d in depths))
    out = each.join(blocks.nodes.select("i", "node"), "i")
    return out.select("node", "degree", (F.col("effects") / F.col("degree")).alias("mean_effect"), *[f"reach_{d}" for d in depths])


def weighed(bits: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """For each of the first `size` bits, the weights of the rows where it is set."""
    out = np.zeros(size, np.int64)
    for i in range(0, len(bits), 255):  # sums of bytes
        out += np.unpackbits(bits[i : i + 255], axis=1, count=size).sum(axis=0, dtype=np.uint8)
    for k in np.flatnonzero(weights > 1):
        out += np.unpackbits(bits[k], count=size) * (weights[k] - 1)
    return out


def _spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of lengths[k] numbers each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _promising(blocks: Blocks, share: float) -> DataFrame:
    """i, j, n: pairs of nodes of which j's groups hold `share` of i's neighbours or more, neighbours in several of them counted as often; and for
    each i a row without a j. n: the number of i's neighbours."""
    n_groups = blocks.groups
    rows = int(np.clip(BYTES // 8 // max(n_groups, 1), 16, ROWS))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, turned = None, -1
        for p, turn, block in turns(batches, rows):
            if turn < 0:
                part, own, turned = p, block, -1
                size = len(own.sizes)
                held = np.zeros((n_groups + 1, size), np.int64 if blocks_weight > 2**31 - 1 else np.int32)  # of each group, how many neighbours of each source
                degree = np.zeros(size, np.int64)
                members, begin, names = own.sorted()
                starts, lengths = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
                starts[names], lengths[names] = begin, np.diff(np.append(begin, len(members)))
                continue
            if turn == 0:
                met = np.zeros((len(block.sizes), size), bool)
                for k in range(0, len(block.at), AT_ONCE // 2):
                    at, groups = block.at[k : k + AT_ONCE // 2], block.groups[k : k + AT_ONCE // 2]
                    met[np.repeat(at, lengths[groups]), members[_spread(lengths[groups], starts[groups])]] = True
                heavy = met * block.weights[:, None].astype(held.dtype)
                same = np.arange(max(own.first, block.first), min(own.first + size, block.first + len(block.sizes)))
                heavy[same - block.first, same - own.first] -= 1  # a node is no neighbour of its own
                degree += heavy.sum(axis=0)
                for at, groups in block.by_turn():
                    held[groups] += heavy[at]
                continue
            if turned != turn:
                turned = turn
                yield pa.RecordBatch.from_arrays([pa.array(own.first + np.arange(size)), pa.nulls(size, pa.int64()), pa.array(degree)], ["i", "j", "n"])
            columns = block.padded(n_groups).T
            for k in range(0, len(block.sizes), AT_ONCE // 32):
                sums = sum(held[of[k : k + AT_ONCE // 32]] for of in columns)
                j, i = np.nonzero(sums >= degree * share - 1e-6)
                j += block.first + k
                keep = (j != i + own.first) & (degree[i] > 0)
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(own.first + i), pa.array(j), pa.array(degree[i])], ["i", "j", "n"])

    blocks_weight = blocks.nodes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return blocks.passed(rows, 1, 2, run, "i bigint, j bigint, n bigint")


def twins(blocks: Blocks, least: float) -> DataFrame:
    """u, v, shared, similarity as relations.twins has them (u = v: of different nodes that u stands for).

    What two nodes share are neighbours of the one that are in groups of the other, so counts by groups bound it. The few pairs whose bound is
    high enough are counted exactly."""
    found = _promising(blocks, 2 * least - 1)
    degree = stored(found.where("j IS NULL").select("i", "n"))
    pairs = found.where("j IS NOT NULL").select("i", "j").join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("n").alias("nj")), "j").where("n < nj OR (n = nj AND i < j)")
    nodes = blocks.nodes
    pairs = stored(pairs.join(nodes.select(F.col("i").alias("j"), F.col("gs").alias("theirs")), "j").select("i", "j", "n", "theirs"))
    asked = nodes.join(pairs.select("i").distinct(), "i").select("i", F.explode("gs").alias("g"))
    near = asked.join(nodes.select(F.col("i").alias("b"), F.explode("gs").alias("g")), "g").groupBy("i", "b").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 2).alias("eu"))
    near = stored(near.join(nodes.select(F.col("i").alias("b"), "weight", "gs"), "b"))
    common = F.size(F.array_intersect("theirs", "gs"))
    less = lambda c: F.when(F.col("b") == F.col(c), 1).otherwise(0)
    met = pairs.join(near, "i").withColumn("c", common).where("c > 0").withColumn("w", F.least(F.col("weight") - less("i"), F.col("weight") - less("j"))).where("w > 0")
    gap = F.sum(F.abs(F.col("eu") - F.least(F.lit(1.0), F.col("c") / 2)) * F.col("w")) / F.sum("w")
    counted = met.groupBy("i", "j").agg(F.first("n").alias("n"), F.sum("w").alias("shared"), gap.alias("gap"))
    out = counted.select("i", "j", "shared", ((F.col("shared") / F.col("n") + 1 - F.col("gap")) / 2).alias("similarity"))
    alone = nodes.where("weight > 1").join(degree, "i").where("n > 1")
    out = out.union(alone.select("i", F.col("i").alias("j"), (F.col("n") - 1).alias("shared"), (((F.col("n") - 1) / F.col("n") + 1) / 2).alias("similarity"))).where(F.col("similarity") >= least)
    return out.join(nodes.select("i", F.col("node").alias("u")), "i").join(nodes.select(F.col("i").alias("j"), F.col("node").alias("v")), "j").select("u", "v", "shared", "similarity")
