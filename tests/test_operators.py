"""Operators on small frames with pinned values, edge rows and invariants."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, briefs, evidence, merge, pairs, profile, referees, relations, sampling, scoring, temporal, vectors
from tidemark.operators.asof import Contract

T0 = datetime(2025, 1, 1)


# as-of


def test_asof_edges(spark):
    cut = datetime(2024, 1, 31)
    rows = [
        ("a", cut, "k", 1.0, 1), ("a", cut - timedelta(days=30), "k", 2.0, 2), ("a", cut + timedelta(seconds=1), "k", 9.0, 3), ("a", cut - timedelta(days=31), "k", 9.0, 4),
        ("b", cut - timedelta(days=1), "k", 5.0, 1), ("b", cut - timedelta(days=1), "k", 6.0, 2), ("c", cut - timedelta(days=2), "k", 3.0, 1), ("c", cut - timedelta(days=1), "k", None, 2),
    ]
    events = spark.createDataFrame(rows, "entity_id string, observed_at timestamp, field string, value double, tie int")
    cohort = spark.createDataFrame([(x,) for x in "abcd"], "entity_id string")
    cs = [Contract("latest", "latest_value_as_of", "k"), Contract("n", "count_over_window", "k", 30), Contract("s", "sum_over_window", "k", 30), Contract("zero", "count_over_window", "k"), Contract("any", "exists_as_of", "k")]
    got = {r["entity_id"]: tuple(r)[1:] for r in asof.matrix(events, cohort, cs, cut).collect()}
    assert got == {"a": (1, 2, 3, 1, 1), "b": (6, 2, 11, 0, 1), "c": (0, 2, 3, 0, 1), "d": (0, 0, 0, 0, 0)}
    seen = asof.matrix(events, cohort, cs[:1], cut, audit=True).where("entity_id = 'd'").first()
    assert seen["latest__seen"] is None
    with pytest.raises(ValueError):
        Contract("x", "no_such_mode", "k")


def test_payload_keys_with_null_count(spark):
    raw = spark.createDataFrame([("a", T0, '{"n": null, "b": true}', 1), ("a", T0, '{"x": 1}', 2)], "entity_id string, observed_at timestamp, payload string, tie int")
    assert {(r["field"], r["value"]) for r in asof.payload_events(raw, ["n", "b"]).collect()} == {("n", None), ("b", 1.0)}


# temporal


def series(spark, points):
    return spark.createDataFrame([(s, T0 + timedelta(days=d), float(v)) for s, d, v in points], "series string, ts timestamp, value double")


def test_alignment(spark):
    e = series(spark, [("s", 0, 10), ("s", 2, 20), ("s", 3, 15), ("t", 0, 100), ("t", 1, 150), ("t", 3, 200)])
    got = temporal.aligned(e, "s", "t", "day", least=3).orderBy("idx").collect()
    assert len(got) == 4 and got[1]["x"] == 0 and got[2]["y"] == 0
    with pytest.raises(ValueError):
        temporal.aligned(series(spark, [("s", 0, 1), ("t", 0, 1)]), "s", "t", "day")
    with pytest.raises(ValueError):
        temporal.aligned(series(spark, [("s", 0, 1), ("s", 9, 1), ("t", 0, 1), ("t", 9, 1)]), "s", "t", "day", most_gaps=0.3)


def test_bucket_sum(spark):
    e = spark.createDataFrame([("s", T0 + timedelta(hours=h), float(v)) for h, v in ((1, 5), (2, 10), (3, 15))], "series string, ts timestamp, value double")
    assert temporal.bucketed(e, "day").first()["value"] == 30


def pair(spark, x, y):
    return spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "idx int, x double, y double")


@pytest.mark.parametrize("shift, lag, way", [(0, 0, "simultaneous"), (3, 3, "source_leads_short"), (-2, -2, "target_leads")])
def test_causal_lead(spark, shift, lag, way):
    t = np.arange(60)
    got = temporal.causal_lead(pair(spark, np.sin(0.3 * t), np.sin(0.3 * (t - shift))), 10).first()
    assert got["lag"] == lag and got["direction"] == way and abs(got["r"]) >= 0.9


def test_pipeline_lag(spark):
    e = series(spark, [("t", 0, 5), ("t", 7, 8), ("t", 14, 3), ("t", 21, 6), ("d", 3, 10), ("d", 10, 15), ("d", 17, 7), ("d", 24, 12)])
    got = temporal.causal_lead(temporal.aligned(e, "t", "d", "day", most_gaps=0.9), 7).first()
    assert got["lag"] == 3 and got["direction"] == "source_leads_short"


@pytest.mark.parametrize("gaps, trend", [((1, 2, 3, 4), "increasing"), ((5, 4, 3, 2, 1), "decreasing"), ((3, 3, 3, 3), "stable")])
def test_inactivity(spark, gaps, trend):
    got = temporal.inactivity(series(spark, [("s", d, 1) for d in np.cumsum((0, *gaps)).tolist()])).first()
    assert got["trend"] == trend and got["mean_gap"] == pytest.approx(np.mean(gaps))


def test_lag_symmetry(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=40), r.normal(size=40)
    there = {q["lag"]: q["r"] for q in temporal.lagged(pair(spark, x, y), 4).collect()}
    back = {q["lag"]: q["r"] for q in temporal.lagged(pair(spark, y, x), 4).collect()}
    assert all(there[k] == pytest.approx(back[-k]) for k in there)


def test_fills_and_gaps(spark):
    grid = temporal.gridded(temporal.bucketed(series(spark, [("s", 0, 1), ("s", 4, 9), ("s", 5, 1)]), "day"), "day")
    of = lambda how, **k: [r["value"] for r in temporal.filled(grid, how, **k).orderBy("bucket").collect()]
    assert of("linear") == [1, 3, 5, 7, 9, 1] and of("forward") == [1, 1, 1, 1, 9, 1] and of("backward") == [1, 9, 9, 9, 9, 1] and of("mean") == [1, 1, 1, 1, 9, 1]
    assert of("zero", longest_gap=2) == [1, None, None, None, 9, 1]
    curve = [r["value"] for r in merge.gap_filled(grid, "spline").orderBy("bucket").collect()]
    assert curve[0] == pytest.approx(1) and curve[4] == pytest.approx(9) and len(curve) == 6


# pairs


@pytest.mark.parametrize("x, y, want", [([1, 2, 3, 4, 5], [2, 4, 6, 8, 10], 1), ([1, 2, 3, 4, 5], [10, 8, 6, 4, 2], -1), ([1, 2, 3, 4, 5], [7, 7, 7, 7, 7], 0)])
def test_pearson(spark, x, y, want):
    assert pairs.pearson(pair(spark, x, y), ["x", "y"]).first()["r"] == pytest.approx(want)


def test_pairs_skip_nan_and_null(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (float("nan"), 1.0), (None, 5.0), (float("inf"), 9.0)], "x double, y double")
    got = pairs.pearson(frame, ["x", "y"]).first()
    assert (got["n"], got["r"]) == (3, pytest.approx(1))


def test_size_limits():
    for n in (2001, 1100):
        with pytest.raises(ValueError):
            pairs.check_size(n)
    pairs.check_size(100)


def test_step_up_is_monotone(spark):
    frame = spark.createDataFrame([(k, p) for k, p in zip("abcd", (0.01, 0.02, 0.021, 0.9), strict=True)], "k string, p double")
    got = {r["k"]: r["q"] for r in pairs.adjusted(frame, ties=["k"]).collect()}
    assert got["a"] == got["b"] == got["c"] == pytest.approx(0.028) and all(got[r["k"]] >= r["p"] for r in frame.collect())
    assert {r["k"]: r["q"] for r in pairs.adjusted(frame, ties=["k"], method="plain").collect()}["a"] == pytest.approx(0.04)


def test_chi_square_with_empty_cells(spark):
    frame = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10, "a string, b string")
    got = pairs.chi_square(frame, "a", "b").first()
    assert got["chi2"] == pytest.approx(4 * 4.5**2 / 5) and got["df"] == 1 and 0 < got["p"] < 0.001


def test_spearman_of_a_monotone_curve(spark):
    frame = pair(spark, range(1, 11), [v**3 for v in range(1, 11)])
    assert pairs.spearman(frame, ["x", "y"], ["idx"]).first()["r"] == pytest.approx(1)


# profile


@pytest.mark.parametrize("values, want", [
    (["25", "34", "45", "28", "52"], "numeric"), (["true", "false"] * 3, "boolean"), (["$45000", "$78000", "$120000"], "numeric"), (["1", "2"] * 5, "categorical"), (["North", "South", "East"], "categorical"),
    (["25", "34", "45", "28", "52", "67", "89", "12", "76", "43"], "numeric"), (["2024-01-01", "2024-01-02"], "timestamp"),
])
def test_type_inference(spark, values, want):
    assert profile.type_ratios(spark.createDataFrame([(v,) for v in values], "v string"), ["v"]).first()["inferred"] == want


def test_missing_runs_and_entropy(spark):
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", None, "", "a", "b", None])], "g int, i int, v string")
    got = profile.missing_runs(frame, "v", ["i"], ["g"]).first()
    assert got["longest_run"] == 2 and got["missing_rate"] == 0.5
    card = profile.cardinality(frame, ["v"]).first()
    assert card["distinct"] == 2 and card["entropy"] == pytest.approx(0.9182958) and card["mode"] == "a"


def test_entity_column(spark):
    frame = spark.createDataFrame([("x", str(i)) for i in range(5)], "name string, customer_id string")
    assert profile.entity_column(frame) == "customer_id"
    assert profile.entity_column(spark.createDataFrame([("x",)] * 5, "name string")) is None


def test_shape_of_a_constant(spark):
    got = profile.shape_stats(spark.createDataFrame([(2.0,)] * 5, "v double"), "v").first()
    assert (got["skewness"], got["kurtosis"], got["outliers"]) == (0, 0, 0)


# merge and samples


def test_duplicate_policies(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, i int")
    of = lambda p: sorted(r["i"] for r in merge.deduplicated(frame, ["k"], ["i"], p).collect())
    assert of("keep_first") == [1, 3] and of("keep_last") == [2, 3] and of("remove_all") == [3]
    with pytest.raises(Exception, match="a key repeats"):
        of("error")


def test_merges(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert merge.merged([a, b], "outer", ["k"]).count() == 3 and merge.merged([a, b], "inner", ["k"]).columns == ["k", "v", "v_2"]
    with pytest.raises(ValueError):
        merge.union_all([a, b.withColumnRenamed("v", "u")])
    with pytest.raises(Exception, match="a key repeats"):
        merge.joined(a, b.union(b), ["k"], unique=True).collect()


def test_time_column():
    assert merge.time_column(["x", "Event_Time", "date"]) == "date" and merge.time_column(["x", "my_created"]) == "my_created" and merge.time_column(["x"]) is None


def test_outliers_and_resample(spark):
    frame = series(spark, [("s", i, 1 + i % 2) for i in range(20)] + [("s", 30, 99)])
    assert merge.without_outliers(frame, ["value"]).count() == 20
    line = merge.resampled(series(spark, [("s", 0, 0), ("s", 4, 8)]), "day", linear=True).orderBy("bucket").collect()
    assert [r["value"] for r in line] == [0, 2, 4, 6, 8]


def test_split_is_exact_and_repeatable(spark):
    frame = spark.range(100).repartition(7)
    a, b = sampling.split(frame, "id"), sampling.split(frame.coalesce(1), "id")
    assert a.where("part = 'discovery'").count() == 70 and a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        sampling.split(spark.range(8), "id")


def test_even_sample_and_pages(spark):
    got = sorted(r["id"] for r in sampling.even_sample(spark.range(2000).repartition(5), ["id"]).collect())
    assert len(got) == 100 and got[0] == 0 and got[-1] == 1999
    page, facts = sampling.page(spark.range(120), ["id"], 3)
    assert page.count() == 20 and facts["total_pages"] == 3 and not facts["has_next"]


# scoring, relations, evidence


def test_scores_at_edges(spark):
    f = spark.range(1)
    v = lambda c: f.select(c.alias("v")).first()["v"]
    L = lambda x: F.lit(x).cast("string")
    assert v(scoring.growth(L("0"), L(None), L(None), L(None))) == 0 and v(scoring.growth(L("60"), L("5"), L("0"), L("500000"))) == 5
    assert v(scoring.legitimacy(L(None), L(None), L("inactive"), L(None), L(None))) == 4 and v(scoring.legitimacy(L(None), L(None), L("revoked"), L(None), L(None))) == 1
    assert v(scoring.contact_quality(L("a@b.com"), L("(555) 123-4567"), [L("x"), L(" "), L(None)])) == 4.5
    assert v(scoring.recency(F.lit(None).cast("timestamp"), F.current_timestamp())) == 3


def test_missing_text_isnt_a_broker(spark):
    frame = spark.createDataFrame([(None, None), ("Broker", None), ("x", "y")], "op string, entity string")
    assert frame.where(scoring.is_broker(F.col("op"))).count() == 1 and frame.where(scoring.is_carrier(F.col("op"), F.col("entity"))).count() == 2


def test_food_safety(spark):
    frame = spark.createDataFrame([("390.3T", None), ("39093", "x"), (None, "Pest control"), (None, None)], "code string, description string")
    assert [r["f"] for r in frame.select(scoring.food_safety(F.col("code"), F.col("description")).alias("f")).collect()] == [True, False, True, False]


def test_expected_rows(spark):
    rows = spark.createDataFrame([("union",), ("join",), ("consolidate",)], "t string").select("t", relations.expected_rows(F.lit(450), F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in rows.collect()} == {"union": 450, "join": 315, "consolidate": 360}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in relations.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[101] == 100


def test_normalized_evidence(spark):
    got = spark.createDataFrame([(10.0,), (1.0,), (0.0,)], "e double").select(evidence.normalized(F.col("e")).alias("v")).collect()
    assert [r["v"] for r in got] == pytest.approx([10 / 11, 0.5, 0])


def test_hypothesis_kinds(spark):
    frame = spark.createDataFrame([("A causes B", ""), ("x", "temporal order"), ("works via z", ""), ("a and b", None)], "b string, s string")
    assert [r["k"] for r in frame.select(evidence.hypothesis_kind(F.col("b"), F.col("s")).alias("k")).collect()] == ["CAUSAL", "TEMPORAL", "MECHANISTIC", "ASSOCIATIVE"]


# referees


def line(spark, noise, n=120, slope=2.0, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    return spark.createDataFrame([("p", i + 1, float(a), float(slope * a + noise * e)) for i, (a, e) in enumerate(zip(x, r.normal(size=n), strict=True))], "pair string, idx int, x double, y double")


def test_referee_names():
    assert referees.resolve("CCM")[0] == "cross_mapping" and referees.compatible(["shredder", "ccm", "invariance"]) and not referees.compatible(["ccm", "transfer_entropy", "shredder"])
    with pytest.raises(ValueError):
        referees.resolve("nobody")


@pytest.mark.parametrize("name", ["permutation", "mutual_information", "intervention", "functional_form", "spectral_analysis", "wavelet_coherence"])
def test_vector_referees_tell_signal_from_noise(spark, name):
    n = 700 if name in ("spectral_analysis", "wavelet_coherence") else 120
    signal, = vectors.TESTS[name](line(spark, 0.3, n)).collect()
    assert signal["passed"] and signal["n"] == n
    if name != "functional_form":
        noise, = vectors.TESTS[name](line(spark, 1.0, n, slope=0.0, seed=1)).collect()
        assert not noise["passed"]


def test_vector_referees_on_one_chunk_are_the_plain_forms(spark):
    frame = line(spark, 0.8, 200)
    rows = frame.orderBy("idx").toPandas()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    z = (x - x.mean()) / x.std()
    sse = {d: sum(((y[i % 5 == f] - np.polyval(np.polyfit(z[i % 5 != f], y[i % 5 != f], d), z[i % 5 == f])) ** 2).sum() for f in range(5)) for i in [rows["idx"].to_numpy()] for d in (1, 3)}
    got = {k: vectors.TESTS[k](frame).first() for k in ("permutation", "functional_form", "mutual_information", "spectral_analysis", "lempel_ziv")}
    assert got["permutation"]["statistic"] == pytest.approx(abs(np.corrcoef(x, y)[0, 1])) and got["permutation"]["p"] == pytest.approx(1 / 2501)
    assert got["functional_form"]["statistic"] == pytest.approx((sse[1] - sse[3]) / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    d = lambda v: np.abs(v[:, None] - v) / v.std()
    reach = np.sort(np.maximum(d(x), d(y)) + np.diag([np.inf] * 200), axis=1)[:, 4:5]
    psi = lambda k: -0.5772156649015329 + sum(1 / i for i in range(1, int(k)))
    mi = psi(5) + psi(200) - np.mean([psi(a) + psi(b) for a, b in zip((d(x) < reach).sum(1), (d(y) < reach).sum(1), strict=True)])
    assert got["mutual_information"]["statistic"] == pytest.approx(mi, abs=0.01)  # deviations are whole numbers of steps there
    size = 44
    cut = lambda v: np.array([np.fft.rfft((v[i : i + size] - v[i : i + size].mean()) * np.hanning(size))[1:] for i in range(0, 200 - size + 1, size // 2)])
    a, b = cut(z), cut((y - y.mean()) / y.std())
    assert got["spectral_analysis"]["statistic"] == pytest.approx((np.abs((a * b.conj()).sum(0)) ** 2 / ((np.abs(a) ** 2).sum(0) * (np.abs(b) ** 2).sum(0))).mean())
    code = lambda v: sum(v > c for c in np.quantile(v, vectors.EIGHTHS, method="inverted_cdf"))
    ca, cb = code(x), code(y)
    lz = vectors.lempel_ziv
    assert got["lempel_ziv"]["statistic"] == pytest.approx((lz(ca) + lz(cb) - lz(ca * 8 + cb)) / max(lz(ca), lz(cb)))


def test_vector_referees_over_several_chunks(spark, monkeypatch):
    """All points count, however they are cut; what is summed doesn't depend on the cut."""
    frame = line(spark, 0.5, 600)
    whole = {k: vectors.TESTS[k](frame).first() for k in ("permutation", "functional_form", "intervention", "homology")}
    monkeypatch.setattr(vectors, "CHUNK", 100)
    for k, w in whole.items():
        part = vectors.TESTS[k](frame).first()
        assert part["n"] == 600 and part["statistic"] == pytest.approx(w["statistic"]) and part["passed"] == w["passed"]
    for k in ("complexity", "lempel_ziv", "spectral_analysis", "wavelet_coherence"):
        assert vectors.TESTS[k](frame).first()["n"] in (599, 600)


def test_confounders_are_held(spark):
    """With the common cause known, nothing is left; with another variable, much is; without any, the test passes."""
    r = np.random.default_rng(4)
    z = r.normal(size=900)
    rows = [("p", i, float(z[i] + 0.5 * r.normal()), float(z[i] + 0.5 * r.normal()), float(z[i]), float(r.normal())) for i in range(900)]
    frame = spark.createDataFrame(rows, "pair string, idx int, x double, y double, z double, z_other double")
    test = vectors.TESTS["conditional_mi"]
    none, both, other = (test(f).first() for f in (frame.drop("z", "z_other"), frame, frame.drop("z")))
    assert none["passed"] and none["statistic"] == 0 and both["statistic"] < 0.05 and other["statistic"] > 0.3 and not other["passed"]


def test_cross_mapping_finds_the_driver(spark):
    x, y = [0.4], [0.2]
    for _ in range(800):
        x.append(x[-1] * (3.8 - 3.8 * x[-1]))
        y.append(y[-1] * (3.5 - 3.5 * y[-1] - 0.1 * x[-2]))
    frame = spark.createDataFrame([("p", i + 1, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pair string, idx int, x double, y double")
    assert vectors.TESTS["cross_mapping"](frame).first()["statistic"] > 0.5


def test_running_sums_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(referees, "STRETCH", 25)
    test_closed_referees(spark)
    test_leave_one_out_against_refits(spark)


def test_closed_referees(spark):
    calm = line(spark, 0.3)
    broken = calm.withColumn("y", F.when(F.col("idx") > 60, -F.col("y")).otherwise(F.col("y")))
    rows = calm.orderBy("idx").toPandas()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    sse = lambda a, b: ((b - np.polyval(np.polyfit(a, b, 1), a)) ** 2).sum()
    parts = [sse(x[:k], y[:k]) + sse(x[k:], y[k:]) for k in range(18, 103)]
    assert referees.chow(calm).first()["statistic"] == pytest.approx(max((sse(x, y) - s) / 2 / (s / 116) for s in parts))
    assert referees.chow(broken).first()["statistic"] > 50 and not referees.chow(broken).first()["passed"]
    assert referees.leave_one_out(calm).first()["passed"] and referees.cusum(calm).first()["n"] == 120
    drifted = calm.withColumn("y", F.when(F.col("idx") > 60, F.col("y") + 5).otherwise(F.col("y")))
    assert not referees.cusum(drifted).first()["passed"]


def test_leave_one_out_against_refits(spark):
    frame = line(spark, 0.5, n=30)
    rows = frame.orderBy("idx").toPandas()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    errors = []
    for i in range(30):
        m = np.arange(30) != i
        c = np.polyfit(x[m], y[m], 1)
        errors.append((y[i] - np.polyval(c, x[i])) ** 2)
    assert referees.leave_one_out(frame).first()["mse"] == pytest.approx(np.mean(errors))


def test_few_rows_give_no_verdict(spark):
    assert referees.judge(line(spark, 0.3, n=9), "chow").collect() == []


# briefs


def test_briefs(spark):
    assert briefs.readable_name("orderTotal_amount") == "Order Total Amount" and briefs.readable_name("X", {"x": "known"}) == "known"
    v = lambda text, *a: spark.range(1).select(briefs.contract_value(F.lit(text), *a).alias("v")).first()["v"]
    assert [v("yes", "binary"), v("no", "binary"), v("b", "categorical", {"a": 0.0, "b": 1.0, "__unknown__": 2.0}), v("z", "categorical", {"a": 0.0, "__unknown__": 2.0}), v("$5", "numeric"), v("x", "numeric")] == [1, 0, 1, 2, 5, 0]
    flags = {r["k"]: r["flags"] for r in briefs.warnings(spark.createDataFrame([("a", "mutual_information", 50, 0.01), ("a", "pearson", 50, 0.5), ("b", "pearson", 10, 0.5)], "k string, sense string, n int, p double"), ["k"]).collect()}
    assert flags == {"a": ["nonlinear_only"], "b": ["low_sample_size"]}


def test_registry_hash_ignores_order(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert briefs.registry_hash(frame, ["k", "v"]).first() == briefs.registry_hash(frame.orderBy(F.desc("k")), ["k", "v"]).first()
    assert briefs.registry_hash(frame, ["k", "v"]).first() != briefs.registry_hash(frame.withColumn("v", F.col("v") + 1), ["k", "v"]).first()
