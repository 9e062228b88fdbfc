import numpy as np
import pytest

from tidemark import session
from tidemark.operators import information, neighbours


def digamma(n):
    return np.array([-0.5772156649015329 + sum(1 / i for i in range(1, int(v))) for v in np.ravel(n)]).reshape(np.shape(n))


def whole(v):
    steps = 2.0 ** (30 - np.ceil(np.log2(v.max() - v.min())))
    return np.round((v - v.min()) * steps).astype(np.int64) * np.int64(np.round(neighbours.UNITS / (v.std() * steps)))


def chebyshev(c):
    return np.max([np.abs(v[:, None] - v[None]) for v in c], axis=0)


def plain_reach(c, k):
    d = chebyshev(c)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    k = min(k, len(d) - 1)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def shapes(n, seed=4):
    """Coordinates with ties, far points, a constant and a hot point that a third of all rows share."""
    r = np.random.default_rng(seed)
    x, y = r.normal(0, 1, n), r.standard_t(2, n)
    x[: n // 3], y[: n // 3] = 0.25, -0.5
    y[n // 3 : n // 2] = np.round(y[n // 3 : n // 2])
    return [whole(x), whole(y), whole(np.round(x + r.normal(0, 0.5, n), 1))]


def frame(spark, c, key="a"):
    rows = [(key, i, [int(v[i]) for v in c], 1, float(i % 7), True) for i in range(len(c[0]))]
    return spark.createDataFrame(rows, "key string, id long, c array<long>, w long, t double, self boolean").repartition(6)


@pytest.mark.parametrize("dimensions,cell", [(1, 20), (2, 16), (2, 512), (3, 24)])
def test_nearest_and_within_equal_all_pairs(spark, monkeypatch, dimensions, cell):
    if cell < 20:  # also where slabs are too many to broadcast
        monkeypatch.setattr(neighbours, "BROADCAST_ROWS", 0)
    c = shapes(900)[:dimensions]
    small = [v[:4] for v in c]
    points = frame(spark, c).unionByName(frame(spark, small, "b")).cache()
    grid = neighbours.Grid(points, dimensions, cell)
    for k in (1, 5):
        near = {(r["key"], r["id"]): r["near"] for r in neighbours.nearest(grid, points, k).collect()}
        assert len(near) == 904
        for key, own in (("a", c), ("b", small)):
            reach = plain_reach(own, k)
            for i in range(len(own[0])):
                told = near[key, i]
                assert told[-1]["d"] == reach[i] and sum(x["w"] for x in told[:-1]) < k
    d = chebyshev(c)
    box = plain_reach(c, 5) + 3
    asked = points.where("key = 'a'").join(spark.createDataFrame([(i, int(b)) for i, b in enumerate(box)], "id long, box long"), "id")
    counts = {r["id"]: r["n"] for r in neighbours.within(grid, asked).collect()}
    assert counts == {i: int((d[i] < box[i]).sum()) for i in range(900)}


def test_weights_and_sums_of_equal_points(spark):
    rows = [("a", i, [0, 0], 1, 2.0 + i, True) for i in range(4)] + [("a", 9, [3, 4], 1, 7.0, True)]
    points = spark.createDataFrame(rows, "key string, id long, c array<long>, w long, t double, self boolean")
    near = {r["id"]: [tuple(x) for x in r["near"]] for r in neighbours.nearest(neighbours.Grid(points, 2), points, 4, euclidean=True).collect()}
    assert near[0] == [(0, 3, 12.0), (5, 1, 7.0)] and near[9] == [(5, 4, 14.0)]
    strangers = points.where("id = 0").withColumn("self", points["self"] & False)
    assert [tuple(x) for x in neighbours.nearest(neighbours.Grid(points, 2), strangers, 4).first()["near"]] == [(0, 4, 14.0)]


def test_counts_on_a_line(spark):
    r = np.random.default_rng(1)
    v = np.concatenate([r.integers(-50, 50, 400), np.zeros(300, np.int64), r.integers(-10_000, 10_000, 100)])
    box = r.integers(0, 60, len(v))
    points = spark.createDataFrame([("a", i, int(x), int(b)) for i, (x, b) in enumerate(zip(v, box, strict=True))], "key string, id long, v long, box long")
    got = {x["id"]: x["n"] for x in neighbours.within_line(points.select("key", "v"), points, 8).collect()}
    assert got == {i: int((np.abs(v - v[i]) < box[i]).sum()) for i in range(len(v))}


def pairs(spark, columns, parts=3, pair="p"):
    names = list(columns)
    rows = [(pair, i, *(float(v) for v in row)) for i, row in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "pair string, idx long, " + ", ".join(f"{n} double" for n in names)).repartition(parts)


def plain_mutual(x, y, k=5):
    c = [whole(x), whole(y)]
    reach = plain_reach(c, k)[:, None]
    nx, ny = ((np.abs(v[:, None] - v) < reach).sum(1) for v in c)
    return max(0, (digamma(k) + digamma(len(x)) - digamma(np.maximum(nx, 1)) - digamma(np.maximum(ny, 1))).mean())


def plain_conditional(a, b, c, k=5):
    reach = plain_reach([a, b, c], k)[:, None]
    at = lambda *v: digamma(np.maximum((chebyshev(v) < reach).sum(1), 1))
    return digamma(k) - at(a, c) - at(b, c) + at(c)


def test_mutual_information_of_all_points(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, 2500)
    y = 0.5 * x + r.normal(0, 1, 2500)
    told = [information.mutual_information(pairs(spark, {"x": x, "y": y}, parts)).first()["statistic"] for parts in (1, 5)]
    assert told[0] == pytest.approx(plain_mutual(x, y), abs=1e-9) and told[1] == pytest.approx(told[0], abs=1e-12)
    monkeypatch.setattr(neighbours, "CELL", 64)
    assert abs(told[0] + 0.5 * np.log(1 - 0.2)) < 0.05


def test_equal_distances_stay_equal(spark):
    """Values of few steps, in several orders: the same figure to the last digit."""
    r = np.random.default_rng(5)
    x, y = r.integers(0, 30, 600) + 0.1, np.round(r.normal(50, 20, 600), 2)
    told = {information.mutual_information(pairs(spark, {"x": x, "y": y}, parts)).first()["statistic"] for parts in (1, 3, 7)}
    assert max(told) - min(told) < 1e-12 and told.pop() == pytest.approx(plain_mutual(x, y), abs=1e-9)


def test_conditional_information_takes_the_best_confounder(spark):
    r = np.random.default_rng(9)
    z = r.normal(0, 1, 700)
    x, y, noise = z + r.normal(0, 0.5, 700), z + r.normal(0, 0.5, 700), r.normal(0, 1, 700)
    frame = pairs(spark, {"x": x, "y": y, "z": z, "z2": noise})
    got = information.conditional_information(frame, ("z", "z2")).first()
    plain = {n: plain_conditional(whole(x), whole(y), whole(c)).mean() for n, c in (("z", z), ("z2", noise))}
    assert got["statistic"] == pytest.approx(max(0, min(plain.values())), abs=1e-9) and plain["z"] < plain["z2"]
    assert information.conditional_information(frame).first()["passed"]


def test_transfer_entropy_tells_the_driver(spark):
    r = np.random.default_rng(2)
    n = 800
    x = r.normal(0, 1, n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.3 * y[t - 1] + 0.9 * x[t - 1] + 0.2 * r.normal()
    got = information.transfer_entropy(pairs(spark, {"x": x, "y": y}), lags=(1, 2)).first()
    w = [whole(x), whole(y)]

    def flow(a, b):
        return np.mean([max(0, plain_conditional(a[:-lag], b[lag:], b[:-lag]).mean()) for lag in (1, 2)])

    assert got["there"] == pytest.approx(flow(*w), abs=1e-9) and got["back"] == pytest.approx(flow(*w[::-1]), abs=1e-9)
    assert got["passed"] and got["p"] < 0.001 and got["statistic"] > 1.1
    assert not information.transfer_entropy(pairs(spark, {"x": y, "y": x}), lags=(1,)).first()["passed"]


def plain_skill(manifold, target, members):
    c = np.stack(manifold, 1).astype(float)
    d = np.ceil(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)))
    np.fill_diagonal(d, np.inf)
    d[:, ~members] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : len(manifold) + 1]
    dist = np.take_along_axis(d, near, 1)
    weight = np.exp(-dist / np.maximum(dist[:, :1], 1))
    told = (weight * target[near]).sum(1) / weight.sum(1)
    return np.corrcoef(told, target)[0, 1]


def test_cross_mapping_grows_with_the_library(spark):
    n = 600
    x, y = np.full(n, 0.4), np.full(n, 0.2)
    for t in range(1, n):
        x[t] = x[t - 1] * (3.8 - 3.8 * x[t - 1])
        y[t] = y[t - 1] * (3.5 - 3.5 * y[t - 1] - 0.1 * x[t - 1])
    frame = pairs(spark, {"x": x, "y": y})
    skill = {(r["way"], r["fraction"]): r for r in information.cross_mapping_skill(frame).collect()}
    assert len(skill) == 10 and skill["there", 0.1]["skill"] < skill["there", 1.0]["skill"] and skill["there", 1.0]["library"] == n - 2
    wx, wy = whole(x), whole(y)
    told = plain_skill([wy[2:], wy[1:-1], wy[:-2]], wx[2:].astype(float), np.ones(n - 2, bool))
    assert skill["there", 1.0]["skill"] == pytest.approx(told, abs=1e-6)
    got = information.cross_mapping(frame).first()
    assert got["statistic"] > 0.9 and got["statistic"] == pytest.approx(told, abs=1e-6)


def test_no_rows(spark):
    none = spark.createDataFrame([], "pair string, idx long, x double, y double, z double")
    few = spark.createDataFrame([("p", i, 1.0, None, 2.0) for i in range(30)], "pair string, idx long, x double, y double, z double")
    for rows in (none, few):
        assert information.mutual_information(rows).count() == information.transfer_entropy(rows, (1,)).count() == information.cross_mapping(rows).count() == information.conditional_information(rows, ("z",)).count() == 0


def test_disk_and_rows_of_a_search(spark, monkeypatch):
    """Each step's points go once the next ones are written, and visits to other cells bring back only what may be among the nearest."""
    made, gone, away = [], [], []
    monkeypatch.setattr(session.Written, "__init__", lambda self, df, name, init=session.Written.__init__: made.append(name) or init(self, df, name))
    monkeypatch.setattr(session.Written, "dropped", lambda self, dropped=session.Written.dropped: gone.append(self.path) or dropped(self))
    visited = neighbours.Grid.visited
    monkeypatch.setattr(neighbours.Grid, "visited", lambda grid, visitors, *a: [df := visited(grid, visitors, *a), away.append(df) if "box" in visitors.columns else None][0])
    r = np.random.default_rng(5)
    rows = [("k", i, [int(x) for x in c], True, 1.0, 1) for i, c in enumerate(r.integers(0, 1 << 20, (600, 2)))]
    points = spark.createDataFrame(rows, "key string, id long, c array<long>, self boolean, t double, w long")
    grid = neighbours.Grid(points, 2, 16)
    assert made.count("points") == len(gone) + 1 > 2
    near = {x["id"]: [n["d"] for n in x["near"]] for x in neighbours.nearest(grid, points, 3).collect()}
    at = np.array([x[2] for x in rows])
    d = np.abs(at[:, None] - at[None]).max(2)
    assert near == {i: sorted(np.delete(d[i], i).tolist())[:3] for i in range(len(rows))}
    assert away[0].count() > 0 == away[0].where("size(near) = 0").count()
