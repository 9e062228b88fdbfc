import numpy as np
import pytest

from tidemark.operators import complexity, vectors


def frame(spark, x, y):
    return spark.createDataFrame([("p", i + 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pair string, idx long, x double, y double").repartition(4)


def series(n, seed=3):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    common = np.sin(2 * np.pi * t / 17) + 0.5 * np.sin(2 * np.pi * t / 45)
    return common + 0.3 * r.normal(size=n), common + 0.3 * r.normal(size=n)


@pytest.mark.parametrize("method", ["welch", "periodogram", "multitaper"])
def test_spectra_do_not_depend_on_chunks(spark, monkeypatch, method):
    rows = frame(spark, *series(1500)).cache()
    whole = vectors.judged(rows, vectors.spectral(method, rounds=0)).first()["statistic"]
    monkeypatch.setattr(vectors, "CHUNK", 400)
    assert vectors.judged(rows, vectors.spectral(method, rounds=0)).first()["statistic"] == pytest.approx(whole, abs=1e-9)


@pytest.mark.parametrize("form,close", [("morlet", 1e-4), ("paul", 1e-3), ("dog", 1e-4)])
def test_wavelets_do_not_depend_on_chunks(spark, monkeypatch, form, close):
    rows = frame(spark, *series(3000)).cache()
    monkeypatch.setattr(vectors, "CHUNK", 10_000)
    whole = vectors.judged(rows, vectors.wavelet(form, rounds=0)).first()["statistic"]
    monkeypatch.setattr(vectors, "CHUNK", 1000)
    assert vectors.judged(rows, vectors.wavelet(form, rounds=0)).first()["statistic"] == pytest.approx(whole, abs=close)


def test_forms_tell_signal_from_noise(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=900), r.normal(size=900)
    for test in (*(vectors.spectral(m, 40) for m in ("welch", "multitaper")), *(vectors.wavelet(f, rounds=30) for f in vectors.WAVELETS)):
        assert vectors.judged(frame(spark, x, x + 0.2 * y), test).first()["passed"]
        assert not vectors.judged(frame(spark, x, y), test).first()["passed"]


def plain_lz77(v):
    out = i = 0
    while i < len(v):
        best = 1
        for j in range(i):
            k = 0
            while k < 10 and i + k < len(v) and j + k < i and v[j + k] == v[i + k]:
                k += 1
            best = max(best, k)
        out += 2 if best > 1 else 1
        i += best
    return out / len(v)


def test_coders_equal_plain_ones():
    r = np.random.default_rng(2)
    for letters in (1, 2, 3, 8, 1000):
        for n in (3, 7, 60, 90):
            v = r.integers(0, letters, n).astype(float)
            assert complexity.lz77(v.tolist()) == plain_lz77(v.tolist())
            assert complexity.run_length(v) == min(1, 2 * len([i for i in range(n) if i == 0 or v[i] != v[i - 1]]) / n)
    assert complexity.lz77([1.0, 2.0]) == 0 and complexity.delta(np.ones(5)) == 0.5 and complexity.delta(np.array([0.0, 1.0, 2.0])) == 0


def test_windows_and_stability(spark):
    r = np.random.default_rng(1)
    x, y = r.integers(0, 3, 500), r.integers(0, 3, 500)
    rows = frame(spark, x, y)
    got = {w["window"]: (w["rows"], w["lz77"], w["run_length"], w["delta"]) for w in complexity.windows(rows).collect()}
    assert got == {i: (30, *complexity.figures(x[50 * i : 50 * i + 30].astype(float), y[50 * i : 50 * i + 30].astype(float))) for i in range(10)}
    told = complexity.algorithmic(rows).first()
    assert told["n"] == 500 and told["statistic"] == pytest.approx(complexity.stability(np.array([g[1:] for _, g in sorted(got.items())])))
    short = frame(spark, x[:14], y[:14])
    assert complexity.windows(short).count() == 10 and complexity.algorithmic(short).count() == 1 and complexity.algorithmic(frame(spark, x[:5], y[:5])).count() == 0


def test_wavelets_repeat_few_rows(spark):
    """Stretches bring the rows around them along: a seventh more in all."""
    test = vectors.wavelet("morlet", rounds=0)
    rows = vectors.facts(spark.range(60_000).selectExpr("'p' AS pair", "id AS idx", "sin(id * 0.7) AS x", "cos(id * 1.1) AS y"))
    assert vectors.with_surroundings(rows, test.before, test.after, test.chunk).count() < 72_000
    assert all(n + 2048 <= vectors.transform_size(n) <= 1.35 * (n + 2048) for n in (4097, 9000, 14_336, 16_384))
