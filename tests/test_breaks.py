import numpy as np
import pytest

from tidemark.operators import breaks


def frame(spark, x, y, pair="p"):
    return spark.createDataFrame([(pair, i * 2 + 5, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pair string, idx long, x double, y double").repartition(4)


def sse(x, y):
    return np.polyfit(x, y, 1, full=True)[1].sum() if len(set(x)) > 1 else ((y - y.mean()) ** 2).sum()


def test_breakpoint_equals_that_of_all_cuts(spark):
    r = np.random.default_rng(3)
    x = np.round(r.uniform(0, 10, 400), 1)
    y = np.where(x <= 6.2, x, 6.2 - 2 * (x - 6.2)) + r.normal(0, 0.3, 400)
    order = np.lexsort((np.arange(400), x))
    a, b = x[order], y[order]
    f = {k: (sse(a, b) - sse(a[:k], b[:k]) - sse(a[k:], b[k:])) / 2 / ((sse(a[:k], b[:k]) + sse(a[k:], b[k:])) / 396) for k in range(60, 341) if a[k] > a[k - 1]}
    best = max(f, key=f.get)
    got = breaks.breakpoints(frame(spark, x, y)).first()
    assert got["breakpoint"] == a[best - 1] and got["statistic"] == pytest.approx(f[best]) and got["found"] and got["n"] == 400
    assert got["left"] == pytest.approx(np.polyfit(a[:best], b[:best], 1)[0]) and got["right"] == pytest.approx(np.polyfit(a[best:], b[best:], 1)[0])
    assert not breaks.breakpoints(frame(spark, x, x + r.normal(0, 0.3, 400)), limit=12).first()["found"]


def test_loops_and_gaps_of_paths(spark):
    t = np.linspace(0, 6 * np.pi, 600, endpoint=False)
    circle = breaks.hysteresis(frame(spark, np.cos(t), np.sin(t))).first()
    assert circle["loop"] == pytest.approx(3 * np.pi / 4, rel=0.01) and circle["found"] and circle["gap"] < -1 and abs(circle["rising"] - circle["falling"]) <= 3
    line = breaks.hysteresis(frame(spark, np.cos(t), 2 * np.cos(t))).first()
    assert abs(line["loop"]) < 1e-9 and not line["found"] and line["n"] == 600


def test_odd_pairs(spark):
    none = spark.createDataFrame([], "pair string, idx long, x double, y double")
    flat = frame(spark, [1.0] * 40, range(40))
    assert breaks.breakpoints(none).count() == breaks.hysteresis(none).count() == breaks.breakpoints(flat).count() == 0
    assert breaks.hysteresis(flat).first()["loop"] == 0 and not breaks.hysteresis(flat).first()["found"]
