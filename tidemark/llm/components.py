"""Connected components of a link table, by contraction.

Each round every node of the remaining graph points to that node of its closed neighbourhood with the least rank; nodes are merged
along the pointers and links between merged nodes survive. In the first round the rank is by the number of links, most first, so that
stars (copies around a hub) are merged at once. Later ranks are random: the number of nodes falls by a constant factor a round in
expectation, whatever the shape (chains, stars, cliques). Per-round pointers are small stored tables, composed at the end. Nothing
but the count of remaining links comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import keep, lookup


def components(links: DataFrame) -> DataFrame:
    """node, component (one node of it, the same for all) of the nodes in links(a, b) of longs. Repeated links and loops are allowed."""
    edges = keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    left = edges.count()
    pointers: list[tuple[DataFrame, int]] = []
    while left:
        turn = len(pointers)
        if turn:
            sided = edges.select("a", "b", F.lit(0).alias("na"), F.lit(0).alias("nb"))
        else:
            degree = edges.select("a").union(edges.select("b")).groupBy("a").agg((-F.count(F.lit(1))).alias("n"))
            degree = keep(degree, "degrees")
            sided = lookup(edges, degree.select("a", F.col("n").alias("na")), ["a"], left, held=2 * left)
            sided = lookup(sided, degree.select(F.col("a").alias("b"), F.col("n").alias("nb")), ["b"], left, held=2 * left)
        rank = lambda n, c: F.struct(n, F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = sided.select("a", "b", "na", "nb").union(sided.select("b", "a", "nb", "na"))
        near = both.groupBy("a").agg(F.min(rank(F.col("nb").alias("n"), "b")).alias("near"), F.first("na").alias("na"))
        least = near.select(F.col("a").alias("node"), F.least(F.col("near"), rank(F.col("na").alias("n"), "a"))["node"].alias("to"))
        to = keep(least, "pointers")
        pointers.append((to, left))
        moved = lookup(edges, to.select(F.col("node").alias("a"), F.col("to").alias("x")), ["a"], left, held=2 * left)
        moved = lookup(moved, to.select(F.col("node").alias("b"), F.col("to").alias("y")), ["b"], left, held=2 * left)
        edges = keep(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        left = edges.count()
    if not pointers:
        return links.sparkSession.createDataFrame([], "node bigint, component bigint")
    out = pointers[0][0].select("node", F.col("to").alias("component"))
    for to, n in pointers[1:]:
        out = keep(out, "pointers")
        out = lookup(out, to.select(F.col("node").alias("component"), F.col("to").alias("__to")), ["component"], 2 * n, held=2 * n)
        out = out.select("node", F.coalesce("__to", "component").alias("component"))
    return keep(out, "components")
