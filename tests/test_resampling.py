import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import referees, resampling, sampling


def frame(spark, columns):
    names = list(columns)
    rows = [("p", i, *(float(v) for v in row)) for i, row in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "pair string, idx long, " + ", ".join(f"{n} double" for n in names)).repartition(5)


def residual(v, controls):
    a = np.column_stack([np.ones(len(v)), *controls])
    return v - a @ np.linalg.lstsq(a, v, rcond=None)[0]


@pytest.mark.parametrize("n", [60, 3000])
def test_partial_correlation_equals_that_of_residuals(spark, n):
    r = np.random.default_rng(3)
    z = [r.normal(5, 2, n) for _ in range(3)]
    x = z[0] - 2 * z[1] + r.normal(0, 1, n)
    y = 3 * z[0] + z[2] + r.normal(0, 1, n)
    got = referees.partial(frame(spark, {"x": x, "y": y, "z1": z[0], "z2": z[1], "z3": z[2]}), ("z1", "z2", "z3")).first()
    told = np.corrcoef(residual(x, z), residual(y, z))[0, 1]
    assert got["statistic"] == pytest.approx(told, abs=1e-9) and got["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["n"] == n
    refits = []
    for _ in range(400):
        at = r.integers(0, n, n)
        c = [v[at] for v in z]
        refits.append(np.corrcoef(residual(x[at], c), residual(y[at], c))[0, 1])
    low, high = np.percentile(refits, (2.5, 97.5))
    assert got["low"] == pytest.approx(low, abs=0.25 * (high - low)) and got["high"] == pytest.approx(high, abs=0.25 * (high - low))
    assert got["passed"] == (got["low"] > -0.3 and got["high"] < 0.3)


def test_partial_passes_where_the_control_tells_all(spark):
    r = np.random.default_rng(5)
    z = r.normal(0, 1, 2000)
    x, y = z + r.normal(0, 0.1, 2000), z + r.normal(0, 0.1, 2000)
    rows = {"x": x, "y": y, "z": z, "twice": 2 * z, "constant": np.ones(2000)}
    assert referees.partial(frame(spark, rows), ("z", "twice", "constant")).first()["passed"]
    kept = referees.partial(frame(spark, rows | {"z": r.normal(0, 1, 2000)})).first()
    assert not kept["passed"] and kept["statistic"] > 0.9
    assert not referees.partial(frame(spark, rows), ()).first()["passed"]


def test_partial_leaves_out_null_rows(spark):
    rows = spark.createDataFrame([("p", i, float(i), float(i % 3), None if i % 2 else float(i % 5)) for i in range(40)] + [("q", 1, None, 1.0, 1.0)], "pair string, idx long, x double, y double, z double")
    got = referees.partial(rows).collect()
    assert [(r["pair"], r["n"]) for r in got] == [("p", 20)]


def test_gates_need_statistic_and_certainty(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 2000)
    strong, weak = frame(spark, {"x": x, "y": 2 * x + r.normal(0, 0.05, 2000)}), frame(spark, {"x": x, "y": r.normal(0, 1, 2000)})
    for name in ("monotonic", "leave_one_out"):
        told = referees.CLOSED[name](strong).first()
        assert told["passed"] and told["p"] < 0.01
        assert referees.CLOSED[name](strong).first()["p"] == told["p"]  # seeded
    assert not referees.monotonic(weak).first()["passed"]
    few = frame(spark, {"x": x[:12], "y": (2 * x + r.normal(0, 3, 2000))[:12]})
    assert referees.leave_one_out(few).first()["p"] > 0.05
    calm = referees.cusum(frame(spark, {"x": x, "y": x + 0.1 * np.sin(np.arange(2000) * 2.0)})).first()
    assert calm["passed"] and calm["p"] < 0.001
    drifting = referees.cusum(frame(spark, {"x": x, "y": x + np.arange(2000) / 300 + r.normal(0, 0.3, 2000)})).first()
    assert not drifting["passed"] and drifting["p"] > 0.5
    noise = referees.cusum(frame(spark, {"x": x, "y": r.normal(0, 1, 2000)})).first()
    assert 0.0005 < noise["p"] < 0.05


def test_slope_spread_from_powers_equals_that_of_fits():
    r = np.random.default_rng(2)
    x, y = r.normal(0, 1, 240), r.normal(0, 1, 240)
    table = np.column_stack([x**i * y**j for j, top in ((0, 4), (1, 3), (2, 2)) for i in range(top + 1)])
    finish = referees._slope_stability(0.8)
    whole = np.arange(240)[None]

    def plain(limit):
        slopes = [np.polyfit(np.delete(x, i), np.delete(y, i), 1)[0] for i in range(240)]
        return 1 / (1 + np.std(slopes) / abs(np.mean(slopes))) <= limit

    told = [referees._slope_stability(limit)(table, whole)[0] == plain(limit) for limit in np.linspace(0.05, 0.99, 40)]
    assert sum(told) >= 39 and finish(table, whole)[0] in (0.0, 1.0)


def test_weights_are_counts_of_drawn_blocks():
    table = np.arange(12.0).reshape(6, 2)
    draws = np.array([[0, 0, 1, 5, 5, 5], [1, 2, 3, 4, 5, 0]])
    assert (resampling.weighted(table, draws) == np.stack([table[d].sum(0) for d in draws])).all()


def test_numbers_within_keys(spark):
    rows = [(k, v) for k in "aab" for v in range(50)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, r struct<k:string,v:int>").select("r.k", "r.v", "i").repartition(7)
    got = sampling.numbered_within(df, ["k"], ["v", "i"], "at").collect()
    want = {}
    for i, (k, v) in enumerate(rows):
        want.setdefault(k, []).append((v, i))
    assert {(r["k"], r["i"]): r["at"] for r in got} == {(k, i): n + 1 for k, x in want.items() for n, (v, i) in enumerate(sorted(x))}


@pytest.mark.parametrize("stretch", [4096, 16, 5])
def test_series_by_stretches_equal_whole_ones(spark, monkeypatch, stretch):
    from tidemark.operators import merge

    r = np.random.default_rng(6)
    days = np.sort(r.choice(np.arange(0, 300 * 24), 400, replace=False)) / 24  # whole hours
    values = [None if i % 9 == 4 else float(v) for i, v in enumerate(r.normal(0, 5, 400))]
    rows = [("s", float(round(t * 86_400)), v) for t, v in zip(days, values, strict=True)] + [("t", 0.0, 1.0), ("t", 86_400.0 * 5, 2.0), ("u", 7.0, None)]
    points = spark.createDataFrame(rows, "series string, ts double, value double").selectExpr("series", "timestamp_micros(cast(ts * 1000000 AS bigint)) AS ts", "value").repartition(3)
    monkeypatch.setattr(merge, "STRETCH", stretch)
    known = [(t, v) for t, v in zip(days, values, strict=True) if v is not None]
    got = {x["bucket"] / 86_400: x["value"] for x in merge.resampled(points.where("series = 's'"), "day").collect()}
    line = {x["bucket"] / 86_400: x["value"] for x in merge.resampled(points.where("series = 's'"), "day", linear=True).collect()}
    at = [days[0] + k for k in range(int(days[-1] - days[0]) + 1)]
    assert len(got) == len(line) == len(at)
    for b in at:
        key = min(got, key=lambda g: abs(g - b))
        before = [v for t, v in known if t <= b + 1e-9]
        assert got[key] == (before[-1] if before else None)
        if before:
            assert line[min(line, key=lambda g: abs(g - b))] == pytest.approx(np.interp(b, *zip(*known, strict=True)) if b <= known[-1][0] else before[-1], abs=1e-6)
    assert {x["series"]: x["n"] for x in merge.resampled(points, "day").groupBy("series").agg(F.count("bucket").alias("n")).collect()} == {"s": len(at), "t": 6, "u": 1}


def test_splines_in_pieces_equal_whole_ones(spark, monkeypatch):
    from tidemark.operators import merge

    r = np.random.default_rng(7)
    seen = {int(k): float(np.sin(k / 9) + r.normal(0, 0.1)) for k in np.sort(r.choice(1500, 700, replace=False))}
    rows = [("s", float(k), seen.get(k), k in seen) for k in range(1500)] + [("t", float(k), float(k) if k in (0, 5) else None, k in (0, 5)) for k in range(6)] + [("none", 1.0, None, False)]
    grid = spark.createDataFrame(rows, "series string, bucket double, value double, observed boolean").repartition(4)
    whole = {(x["series"], x["bucket"]): x["value"] for x in merge.spline(grid).collect()}
    monkeypatch.setattr(merge, "STRETCH", 100)
    parts = {(x["series"], x["bucket"]): x["value"] for x in merge.spline(grid).collect()}
    assert whole.keys() == parts.keys() and len(parts) == len(rows)
    inside = {k: v for k, v in whole.items() if k[0] != "none" and min(seen) <= k[1] <= max(seen)}
    assert all(parts[k] == pytest.approx(v, abs=1e-9) for k, v in inside.items()) and all(parts["s", float(k)] == pytest.approx(v) for k, v in seen.items())
    assert [parts["t", float(k)] for k in range(6)] == pytest.approx(range(6))
