"""Exact nearest neighbours and counts within a distance, over all points of each key.

Coordinates are whole numbers (scaled() makes them), so distances are exact and don't depend on how rows are dealt. A key's space is
cut into cells of about CELL different points, coordinate by coordinate at quantiles; points of equal coordinates are one point with a
weight. nearest() finds a query's neighbours in its own cell first. The k-th distance there bounds the true one, so only the cells that
the box of that size meets are visited then, and the least distances of all visits are exact. within() visits the cells that a box meets
and adds up. No task holds more than a cell's points and a share of its visitors.

Distances are the largest of the coordinates' differences; with `euclidean` their root of squares (the box is the same bound).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import Written, stored

CELL = 512
#: Slabs into which a step cuts a cell at most.
SLABS = 64
#: A table of so many slabs is broadcast to those who ask; a larger one is joined, each slab in so many copies.
BROADCAST_ROWS, COPIES = 100_000, 16
#: Visitors of a cell are dealt to tasks of so many.
VISITORS = 8192
UNITS = 1 << 40


def scaled(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with the columns as whole numbers, UNITS to a deviation within the keys (0 for a constant): steps of 2**-30 of the range, or a bit
    more, times a whole number. Only the latter depends on the deviation, so equal distances stay equal, in whatever order it is summed."""
    keys = list(keys)
    of = rows.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("l", F.min), ("h", F.max), ("d", F.stddev_pop))])
    told = {}
    for c in columns:
        steps = F.pow(F.lit(2.0), F.lit(30) - F.ceil(F.log2(F.col(f"__h_{c}") - F.col(f"__l_{c}"))))
        whole = F.round((F.col(c) - F.col(f"__l_{c}")) * steps).cast("long") * F.round(F.lit(float(UNITS)) / (F.col(f"__d_{c}") * steps)).cast("long")
        told[c] = F.when((F.col(f"__h_{c}") > F.col(f"__l_{c}")) & (F.col(f"__d_{c}") > 0), whole).otherwise(F.lit(0).cast("long"))
    return rows.join(of, keys).withColumns(told).drop(*[f"__{n}_{c}" for c in columns for n in "lhd"])


class Grid:
    """Cells of points(key, c, w, t): c an array of whole coordinates, w a weight, t a sum that goes with the point. Rows of equal
    coordinates are added up."""

    def __init__(self, points: DataFrame, dimensions: int, cell: int = CELL):
        self.dimensions, self.cell = dimensions, cell
        own = points.groupBy("key", "c").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
        held = Written(own.withColumn("path", F.array().cast("array<int>")), "points")
        #: For each step, the cut coordinate, cuts(key, path, cuts) and slabs(key, path, slab, lo, hi), by which a value finds its slabs.
        self.steps: list[tuple[int, DataFrame, DataFrame]] = []
        stuck = 0
        for step in range(64):
            axis, left, placed = step % dimensions, max(1, dimensions - step), held.rows
            sizes = placed.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * cell)
            if not sizes.take(1):
                break
            wanted = F.least(F.lit(SLABS), F.ceil(F.pow(F.col("n") / cell, F.lit(1.0 / left)))).cast("int")
            v = F.element_at("c", axis + 1)
            # evenly spaced ones of SLABS - 1 quantiles
            quantiles = placed.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(v, [i / SLABS for i in range(1, SLABS)], 1000).alias("q")).where(F.col("n") > 2 * cell)
            cuts = quantiles.withColumn("g", wanted).select("key", "path", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("g") - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.round(i * SLABS / F.col("g")).cast("int")))))).alias("cuts"))
            cuts = stored(cuts)
            moved = Written(self._stepped(placed, cuts, axis), "points")
            after = moved.rows
            slabs = after.where(F.size("path") == step + 1).groupBy("key", F.slice("path", 1, step).alias("path"), F.element_at("path", -1).alias("slab")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
            self.steps.append((axis, cuts, stored(slabs)))
            stuck = 0 if after.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] < placed.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] else stuck + 1
            held.dropped()
            held = moved
            if stuck >= dimensions:
                break
        self.points = held.rows

    @staticmethod
    def _stepped(rows: DataFrame, cuts: DataFrame, axis: int) -> DataFrame:
        v = F.element_at("c", axis + 1)
        met = rows.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS // SLABS else cuts, ["key", "path"], "left")
        slab = F.size(F.filter("cuts", lambda cut: cut < v))
        return met.withColumn("path", F.when(F.col("cuts").isNull(), F.col("path")).otherwise(F.concat("path", F.array(slab)))).drop("cuts")

    def placed(self, queries: DataFrame) -> DataFrame:
        """queries(key, c, ...) with the path of the cell that they lie in."""
        out = queries.withColumn("path", F.array().cast("array<int>"))
        for axis, cuts, _ in self.steps:
            out = self._stepped(out, cuts, axis)
        return out

    def met(self, queries: DataFrame, box: str) -> DataFrame:
        """A row of queries(key, id, c, ...) for each cell whose points may lie within the distance in the column box (null: any); path is
        the cell's."""
        out = queries.withColumn("path", F.array().cast("array<int>"))
        for axis, _, slabs in self.steps:
            few = slabs.count() <= BROADCAST_ROWS
            held = (lambda df: F.broadcast(df)) if few else (lambda df: df)
            cut = slabs.select("key", "path").distinct().withColumn("cut", F.lit(True))
            out = out.join(held(cut), ["key", "path"], "left")  # others are in a cell that this step left whole
            copies = slabs.withColumn("copy", F.lit(0) if few else F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
            named = copies.select(F.col("key").alias("__key"), F.col("path").alias("__path"), "copy", "slab", "lo", "hi")
            out = out.withColumn("__copy", F.lit(0) if few else F.pmod(F.xxhash64("id"), F.lit(COPIES)).cast("int"))
            v = F.element_at("c", axis + 1)
            near = F.col(box).isNull() | ((F.col("lo") <= v + F.col(box)) & (F.col("hi") >= v - F.col(box)))
            gone = out.join(held(named), (F.col("key") == F.col("__key")) & (F.col("path") == F.col("__path")) & (F.col("copy") == F.col("__copy")) & near, "left")
            gone = gone.where("cut IS NULL OR slab IS NOT NULL").withColumn("path", F.when(F.col("cut").isNull(), F.col("path")).otherwise(F.concat("path", F.array("slab"))))
            out = gone.select(*queries.columns, "path")
        return out

    def visited(self, visitors: DataFrame, kernel, result: str) -> DataFrame:
        """kernel(points, visitors) of each cell and a part of its visitors, as Arrow tables."""
        many = visitors.groupBy("key", "path").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
        dealt = visitors.join(many, ["key", "path"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        held = self.points.join(many, ["key", "path"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        held, dealt = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (held, dealt))  # columns of their own, though they come from one table
        by = ["key", "path", "part"]
        return held.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda p, q: kernel(p, q), result)


def _column(table, name: str, kind) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind, copy=False)


def _coordinates(table) -> np.ndarray:
    flat = table.column("c").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(flat), -1)


def _distances(q: np.ndarray, p: np.ndarray, euclidean: bool) -> np.ndarray:
    if euclidean:
        out = np.zeros((len(q), len(p)))
        for j in range(p.shape[1]):
            out += (q[:, j, None] - p[None, :, j]).astype(float) ** 2
        return np.ceil(np.sqrt(out)).astype(np.int64)
    out = np.zeros((len(q), len(p)), np.int64)
    for j in range(p.shape[1]):
        np.maximum(out, np.abs(q[:, j, None] - p[None, :, j]), out=out)
    return out


FAR = np.int64(1 << 62)
NEAR = "array<struct<d:bigint,w:bigint,t:double>>"


def nearest(grid: Grid, queries: DataFrame, k: int, euclidean: bool = False) -> DataFrame:
    """key, id and near (d, w, t of the nearest different points, as many as have a weight of k together, nearest first; fewer
    where the key has no more) of queries(key, id, c, self, t). self: the query is one of the points, which then lacks a weight of 1
    and the query's t. Euclidean distances are rounded up to whole units."""

    def kernel(points, asked):
        import pyarrow as pa

        keys, ids = asked.column("key").combine_chunks(), asked.column("id").combine_chunks()
        sizes = np.zeros(len(asked), np.int64)
        flat: list[tuple[np.ndarray, ...]] = []
        if len(points) and len(asked):
            p, w, t = _coordinates(points), _column(points, "w", np.int64), _column(points, "t", float)
            q, own, ours = _coordinates(asked), _column(asked, "self", bool), _column(asked, "t", float)
            away = "box" in asked.column_names
            most = asked.column("box").fill_null(FAR - 1).to_numpy() if away else np.full(len(asked), FAR - 1)
            m = min(k, len(p))
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                d = _distances(q[part], p, euclidean)
                rows, cols = np.nonzero((d == 0) & own[part, None])  # the query's own point: a weight of 1 less
                gone = w[cols] == 1
                d[rows[gone], cols[gone]] = FAR
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                far = np.take_along_axis(d, near, 1)
                order = np.argsort(far, axis=1, kind="stable")
                near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
                mine = (far == 0) & own[part, None]
                weight, total = w[near] - mine, t[near] - mine * ours[part, None]
                kept = far <= most[part, None]  # farther ones than the k-th at home aren't among the nearest
                sizes[part] = kept.sum(axis=1)
                flat.append((far[kept], weight[kept], total[kept]))
            if away:
                some = pa.array(sizes > 0)
                keys, ids, sizes = keys.filter(some), ids.filter(some), sizes[sizes > 0]
        else:
            keys, ids, sizes = keys.slice(0, 0), ids.slice(0, 0), sizes[:0]
        d, w, t = (np.concatenate(c) for c in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        told = pa.StructArray.from_arrays([pa.array(d, pa.int64()), pa.array(w, pa.int64()), pa.array(t, pa.float64())], ["d", "w", "t"])
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.table([keys, ids, pa.ListArray.from_arrays(pa.array(ends), told)], ["key", "id", "near"])

    kind = f"key {queries.schema['key'].dataType.simpleString()}, id bigint, near {NEAR}"
    placed = Written(grid.placed(queries.select("key", "id", "c", "self", F.col("t").cast("double").alias("t"))), "queries").rows
    home = Written(grid.visited(placed, kernel, kind), "home").rows
    # the distance at which a weight of k is reached at home; null: not there
    reach = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("w"), F.lit(None).cast("long").alias("d")), lambda s, x: F.struct((s["w"] + x["w"]).alias("w"), F.when(s["d"].isNull() & (s["w"] + x["w"] >= k), x["d"]).otherwise(s["d"]).alias("d")), lambda s: s["d"])
    bounds = home.select(F.col("key").alias("__k"), F.col("id").alias("__i"), reach.alias("box"))
    away = placed.withColumnRenamed("path", "home").join(bounds, (F.col("key") == F.col("__k")) & (F.col("id") == F.col("__i")), "left").drop("__k", "__i")
    away = grid.met(away, "box").where("path <> home").drop("home")
    found = home.unionByName(grid.visited(away, kernel, kind))
    every = found.groupBy("key", "id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("every"))  # k a visit
    return every.select("key", "id", first_of(F.col("every"), k).alias("near"))


def first_of(near, k: int):
    """As many of the sorted neighbours as have a weight of k together."""
    before = lambda i: F.aggregate(F.slice(near, 1, i), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    return F.filter(near, lambda x, i: before(i) < k)


def within(grid: Grid, queries: DataFrame, box: str = "box") -> DataFrame:
    """key, id and n, the weight of the points nearer than the distance in the column box, of queries(key, id, c, box)."""

    def kernel(points, asked):
        import pyarrow as pa

        if not len(points):
            asked = asked.slice(0, 0)
        counts = np.zeros(len(asked), np.int64)
        if len(asked):
            p, w = _coordinates(points), _column(points, "w", np.int64)
            q, reach = _coordinates(asked), _column(asked, box, np.int64)
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                counts[part] = (_distances(q[part], p, False) < reach[part, None]) @ w
        return pa.table([asked.column("key"), asked.column("id"), pa.array(counts)], ["key", "id", "n"])

    kind = f"key {queries.schema['key'].dataType.simpleString()}, id bigint, n bigint"
    own = queries.select("key", "id", "c", F.col(box).alias(box))
    some = grid.visited(grid.met(own, box), kernel, kind)
    return some.groupBy("key", "id").agg(F.sum("n").alias("n"))


def within_line(points: DataFrame, queries: DataFrame, ranges: int = 64) -> DataFrame:
    """key, id and n, the weight of the points(key, v, and w; 1 without it) nearer than box, of queries(key, id, v, box): whole numbers on a line. Points and
    the ends of the queries' ranges are put in order together; counts run within ranges of values, each from those before it."""
    ends = queries.select("key", "id", F.explode(F.array(F.struct((F.col("v") - F.col("box")).alias("v"), F.lit(1).alias("kind")), F.struct((F.col("v") + F.col("box")).alias("v"), F.lit(-1).alias("kind")))).alias("e")).select("key", "id", "e.v", "e.kind")
    ends = stored(ends)  # the lower end comes after the points of its value (kind 1), the upper before them (-1)
    counted = points.groupBy("key", "v").agg((F.sum("w") if "w" in points.columns else F.count(F.lit(1))).alias("w")).select("key", "v", F.lit(0).alias("kind"), "w")
    every = stored(counted.unionByName(ends.select("key", "v", "kind").distinct().withColumn("w", F.lit(0).cast("long"))))
    cuts = every.groupBy("key").agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 1000).alias("cuts"))
    dealt = every.join(cuts, "key").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    starts = dealt.groupBy("key", "part").agg(F.sum("w").alias("n"))
    starts = starts.select("key", "part", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("start"))  # a row per range
    order = Window.partitionBy("key", "part").orderBy("v", "kind")
    run = dealt.withColumn("run", F.sum("w").over(order)).where("kind <> 0").join(starts, ["key", "part"]).select("key", "v", "kind", (F.col("run") + F.col("start")).alias("run"))
    told = ends.join(run, ["key", "v", "kind"]).groupBy("key", "id").agg(F.sum(-F.col("kind") * F.col("run")).alias("n"))
    return told.withColumn("n", F.greatest("n", F.lit(0)))  # a range of no length holds nothing
