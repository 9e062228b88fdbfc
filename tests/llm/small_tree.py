"""Context-tree weighting of a small table in one process: what the distributed form is held against."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ctw import DEPTH


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - np.log(np.pi)


def decisions(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones at the 255 binary nodes (numbered as in a heap, from 1; column 0 is unused) of rows of byte counts."""
    rows = len(byte_counts)
    heap = np.zeros((rows, 512))
    heap[:, 256:] = byte_counts
    for k in range(7, -1, -1):
        heap[:, 1 << k : 2 << k] = heap[:, 2 << k : 4 << k : 2] + heap[:, (2 << k) + 1 : 4 << k : 2]
    return heap[:, 0::2][:, :256], heap[:, 1::2][:, :256]


class Tree:
    """The weighted tree of a small table in one process: `child` leads from a node and a preceding byte to the deeper node or -1; `log10p` has the log
    probability of each next byte for contexts that end at the node."""

    def __init__(self, nodes: list[tuple[int, int]], byte_counts: np.ndarray):
        """nodes: (depth, context), the nearest byte lowest, shallow ones first, the root (0, 0) at 0; byte_counts: a row for each."""
        index = {node: i for i, node in enumerate(nodes)}
        self.child = np.full((len(nodes), 256), -1, np.int32)
        parent = np.full(len(nodes), -1)
        for i, (d, context) in enumerate(nodes):
            if d:
                parent[i] = index[d - 1, context & ((1 << (8 * (d - 1))) - 1)]
                self.child[parent[i], context >> (8 * (d - 1))] = i
        depth = np.array([d for d, _ in nodes])
        rest = byte_counts.astype(float)
        np.subtract.at(rest, parent[1:], byte_counts[1:])
        own = decisions(byte_counts)
        pooled = decisions(rest)
        inner = np.zeros(len(nodes), bool)
        inner[parent[1:]] = True
        estimate = block(*own)
        below = block(*pooled)  # the pooled child; the kept ones are added from the deepest on
        weighted = estimate.copy()
        share = np.ones_like(estimate)  # of the node's own estimate
        for d in range(int(depth.max()), -1, -1):
            at = np.flatnonzero((depth == d) & inner)
            weighted[at] = np.log(0.5) + np.logaddexp(estimate[at], below[at])
            share[at] = np.exp(np.log(0.5) + estimate[at] - weighted[at])
            if d:
                at = np.flatnonzero(depth == d)
                np.add.at(below, parent[at], weighted[at])
        kt = (own[1] + 0.5) / (own[0] + own[1] + 1)
        kt_rest = (pooled[1] + 0.5) / (pooled[0] + pooled[1] + 1)
        mix, left = np.zeros_like(kt), np.ones_like(kt)
        for d in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            up = parent[at]
            mix[at] = mix[up] + left[up] * share[up] * kt[up]
            left[at] = left[up] * (1 - share[up])
        one = mix + left * (share * kt + (1 - share) * kt_rest)
        log = np.zeros((len(nodes), 1))
        for k in range(8):
            p = one[:, 1 << k : 2 << k]
            log = np.stack([log + np.log10(1 - p), log + np.log10(p)], axis=2).reshape(len(nodes), -1)
        self.log10p = log.astype(np.float32)

    def score(self, data: np.ndarray, where: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """The log probability of each byte data[where]; `depth` bytes precede each."""
        child = self.child.reshape(-1)
        node = np.zeros(len(where), np.int64)
        live = np.ones(len(where), bool)
        for d in range(1, depth + 1):
            to = child[node * 256 + data[where - d]]
            live &= to >= 0
            node = np.where(live, to, node)
        return self.log10p.reshape(-1)[node * 256 + data[where]]


def grow(grams: DataFrame, depth: int = DEPTH, contexts: int = 1 << 40) -> Tree:
    """The tree of grams(key, n), all contexts with at least 1/contexts of the bytes; collected."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    masks = ", ".join(f"struct({d} AS depth, key & {(1 << (8 * (d + 1))) - 1}L AS gram)" for d in range(depth + 1))
    each = grams.select("n", F.explode(F.expr(f"array({masks})")).alias("g")).groupBy("g.depth", "g.gram").agg(F.sum("n").alias("n"))
    each = (each.select("depth", F.expr("shiftright(gram, 8)").alias("context"), (F.col("gram").bitwiseAND(255)).cast("int").alias("byte"), "n"))
    enough = each.groupBy("depth", "context").agg(F.sum("n").alias("all")).where((F.col("depth") == 0) | (F.col("all") * contexts >= total)).select("depth", "context")
    table = each.join(F.broadcast(enough), ["depth", "context"]).toPandas().sort_values(["depth", "context", "byte"])
    nodes = [(0, 0)] + [x for x in table[["depth", "context"]].drop_duplicates().itertuples(index=False, name=None) if x[0]]
    index = {node: i for i, node in enumerate(nodes)}
    byte_counts = np.zeros((len(nodes), 256))
    at = np.fromiter((index[x] for x in zip(table["depth"], table["context"], strict=True)), np.int64, len(table))
    byte_counts[at, table["byte"].to_numpy(np.int64)] = table["n"]
    return Tree(nodes, byte_counts)
