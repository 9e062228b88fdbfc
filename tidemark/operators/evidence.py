"""Evidence: q-values to e-values, their ordered product, verdicts, choice of tests, and roll-ups of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import clip, lookup_label, ratio

# Correlations of tests that follow each other, and multipliers of domains and profiles.
CORRELATED = {
    ("permutation_shredder", "shredder"): 0.9, ("permutation_shredder", "bootstrap_validation"): 0.7, ("permutation_shredder", "correlation_pearson"): 0.2,
    ("correlation_pearson", "correlation_spearman"): 0.8, ("correlation_pearson", "transfer_entropy"): 0.4, ("transfer_entropy", "directional_causality"): 0.9, ("transfer_entropy", "ccm"): 0.6,
}
UNRELATED = 0.1
DOMAINS = {"Healthcare": 0.7, "Finance": 0.8, "Scientific": 0.9, "Business": 1.0, "Sports": 1.1, "Engineering": 0.95}
PROFILE = {
    "sample_size": {"small": 0.7, "large": 1.2}, "effect_magnitude": {"large": 1.3, "small": 0.8}, "confounding_risk": {"high": 0.6, "low": 1.1},
}
ATTENUATION = {"data_complexity": {"complex": 0.9, "simple": 1.1}, "domain_risk": {"critical": 0.8, "high": 0.9, "low": 1.1}}
THRESHOLD = {"critical": 1.5, "high": 1.3, "low": 0.8}
RISK = {
    "data_complexity": {"complex": 3.0, "moderate": 1.5}, "effect_magnitude": {"small": 3.0, "medium": 1.5}, "sample_size": {"small": 2.0, "medium": 1.0},
    "domain_risk": {"critical": 4.0, "high": 2.0, "medium": 1.0}, "temporal_nature": {"complex": 2.0, "simple": 1.0}, "confounding_risk": {"high": 2.5, "medium": 1.5},
}
TEST_COUNTS = {"low": (1, 3), "medium": (3, 6), "high": (6, 10), "very_high": (8, 10)}


def _product(tables: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for column, values in tables.items():
        out = out * lookup_label(F.col(column), values, 1.0)
    return out


def e_value(q: Column, p: Column, test: Column, domain: Column) -> Column:
    """1 / q, held within .001 and 1000 at the ends, made more careful by test, times the domain's multiplier."""
    raw = F.try_divide(F.lit(1.0), q)
    permuted = F.least(F.when(q < 0.01, raw * 0.8).otherwise(raw), F.lit(1000.0))
    paired = F.when(p / F.when(q > 0, q) > 10, raw * 0.7).otherwise(raw)
    t = F.when(p < 2 * q, raw * 0.9).otherwise(raw)
    other = F.when((q < 0.05) & (p > 0.01), raw * 0.8).otherwise(raw)
    by_test = F.when(test.isin("permutation_shredder", "shredder"), permuted).when(test.isin("correlation_pearson", "correlation_spearman"), paired).when(test == "chisquare_test", raw).when(test == "ttest_two_sample", t).otherwise(other)
    return F.when(q <= 0, 1000.0).when(q >= 1, 0.001).otherwise(by_test) * lookup_label(domain, DOMAINS, 1.0)


def normalized(e: Column) -> Column:
    """e / (1 + e); 0 for none."""
    return F.when(e <= 0, 0.0).otherwise(e / (1 + e))


def quality(normal: Column) -> Column:
    return F.when(normal >= 0.8, "very_strong").when(normal >= 0.6, "strong").when(normal >= 0.4, "moderate").when(normal >= 0.2, "weak").otherwise("very_weak")


def bounds(e: Column, n: Column) -> tuple[Column, Column]:
    width = F.when(n > 1000, 0.3).when(n < 100, 0.8).otherwise(0.5)
    return e * (1 - width), e * (1 + width)


def combined(tests: DataFrame, key: str = "hypothesis") -> DataFrame:
    """The ordered product of a hypothesis's e-values: each after the first to the power sqrt(1 - its correlation with the one
    before), attenuated by profile and held within .1 and 1. tests(hypothesis, seq, test_type, e, confidence, profile columns)."""
    before = F.lag("test_type").over(Window.partitionBy(key).orderBy("seq"))
    corr = F.lit(UNRELATED)
    for (a, b), r in CORRELATED.items():
        corr = F.when((before == a) & (F.col("test_type") == b), r).otherwise(corr)
    first = before.isNull()
    weight = F.when(first, 1.0).otherwise(clip(F.sqrt(1 - corr) * _product(ATTENUATION), 0.1, 1.0))
    rows = tests.withColumns({"w": weight, "c": F.when(first, 1.0).otherwise(1 - corr)})
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("tests"), F.exp(F.sum(F.col("w") * F.ln(F.greatest(F.col("e"), F.lit(1e-12))))).alias("product"), F.exp(F.sum(F.ln("c"))).alias("correlation_factor"), F.avg("confidence").alias("confidence"),
        F.first(_product(PROFILE)).alias("adjust"), F.first("domain_risk").alias("domain_risk"),
    )
    return verdicts(out.withColumn("e", F.col("product") * F.col("adjust")).drop("product", "adjust"))


def threshold(tests: Column, confidence: Column, domain_risk: Column) -> Column:
    base = F.when(tests <= 1, 20.0).when(tests <= 3, 8.0).when(tests <= 6, 4.0).otherwise(2.5)
    sure = F.when(confidence >= 0.9, 0.7).when(confidence >= 0.7, 0.8).when(confidence < 0.5, 1.3).otherwise(1.0)
    return base * sure * lookup_label(domain_risk, THRESHOLD, 1.0)


def verdicts(df: DataFrame) -> DataFrame:
    """df(e, tests, confidence, domain_risk) with normalized, quality, threshold, verdict and early_stop."""
    e, limit = F.col("e"), threshold(F.col("tests"), F.col("confidence"), F.col("domain_risk"))
    said = F.when(e >= 2 * limit, "accepted").when(e <= 1 / limit, "rejected").when((F.col("confidence") >= 0.8) & (e >= limit / 2), "early_stop").otherwise("inconclusive")
    enough = F.col("tests") >= F.when(F.col("domain_risk") == "critical", 3).otherwise(2)
    return df.withColumns({"normalized": normalized(e), "quality": quality(normalized(e)), "threshold": limit, "verdict": said, "early_stop": (e >= 15) | (e <= 0.15) | enough})


def risk(profiles: DataFrame) -> DataFrame:
    """profiles with risk_score, risk_level, least and most tests."""
    score = F.lit(0.0)
    for column, values in RISK.items():
        score = score + lookup_label(F.col(column), values, 0.0)
    level = F.when(score >= 8, "very_high").when(score >= 5, "high").when(score >= 2.5, "medium").otherwise("low")
    return profiles.withColumns({"risk_score": score, "risk_level": level}).withColumns({
        "least_tests": lookup_label(F.col("risk_level"), {k: v[0] for k, v in TEST_COUNTS.items()}), "most_tests": lookup_label(F.col("risk_level"), {k: v[1] for k, v in TEST_COUNTS.items()}),
    })


def chosen_tests(profiles: DataFrame, tests: DataFrame) -> DataFrame:
    """hypothesis, rank, test: the most efficient tests (e / cost x reliability) of the wanted categories, as many as the risk asks.
    profiles(hypothesis, categories, most_tests); tests(test, category, e, cost, reliability), a rule table."""
    both = profiles.join(F.broadcast(tests), F.array_contains(profiles["categories"], tests["category"]))
    order = Window.partitionBy("hypothesis").orderBy(F.desc(F.col("e") / F.col("cost") * F.col("reliability")), "test")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("most_tests")).select("hypothesis", "rank", "test")


def phase_score(results: DataFrame, key: str = "hypothesis", weights: dict[str, float] = {"integrity": 0.5, "causality": 0.3, "complexity": 0.2}, gate: float = 0.1) -> DataFrame:
    """Mean e of each phase, their weighted sum, and whether the integrity gate holds."""
    means = {k: F.coalesce(F.avg(F.when(F.col("phase") == k, F.col("e"))), F.lit(0.0)) for k in weights}
    out = results.groupBy(key).agg(*[m.alias(k) for k, m in means.items()])
    return out.withColumns({"score": sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), "gate": F.col("integrity") >= gate})


def acceptance(results: DataFrame, key: str = "hypothesis") -> DataFrame:
    """Tests, passed, confidence (share passed), e (10 x confidence) and whether any passed, per hypothesis."""
    out = results.groupBy(key).agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("passed"))
    return out.withColumns({"confidence": F.col("passed") / F.col("tests"), "e": 10.0 * F.col("passed") / F.col("tests"), "accepted": F.col("passed") > 0})


def stability(votes: DataFrame, least: float = 0.8) -> DataFrame:
    """Share of resampled rounds that each referee passed, and whether it is stable. votes(referee, round, passed)."""
    return votes.groupBy("referee").agg(F.avg(F.col("passed").cast("double")).alias("share")).withColumn("stable", F.col("share") >= least)


# Words that tell a hypothesis's kind, in the business text and in the science text.
KINDS = {
    "CAUSAL": (("cause", "lead", "drive", "impact"), ("causal", "influence")), "TEMPORAL": (("lag", "delay", "follow", "after", "before"), ("temporal",)),
    "MECHANISTIC": (("how", "mechanism", "through", "via"), ("functional", "relationship")),
}


def hypothesis_kind(business: Column, science: Column) -> Column:
    out = None
    for kind, (a, b) in KINDS.items():
        hit = F.lower(F.coalesce(business, F.lit(""))).rlike("|".join(a)) | F.lower(F.coalesce(science, F.lit(""))).rlike("|".join(b))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("ASSOCIATIVE")


# --- roll-ups


def usage(df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, Column]) -> DataFrame:
    """Totals over several groupings of a table in one pass, told apart by grouping_id."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([list(s) for s in sets], *names).agg(F.grouping_id().alias("grouping_id"), *[m.alias(k) for k, m in measures.items()])


def velocity(events: DataFrame, ts: str, start, end, by: Sequence[str] = ()) -> DataFrame:
    """Events per minute in [start, end)."""
    minutes = (end - start).total_seconds() / 60
    return events.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(minutes)).alias("per_minute"))


def referee_summary(hypotheses: DataFrame) -> DataFrame:
    """Per referee: uses, success rate and mean p of hypotheses(id, referees array<struct<name, passed, p>>)."""
    each = hypotheses.select(F.explode("referees").alias("r"))
    return each.groupBy(F.col("r.name").alias("referee")).agg(F.count(F.lit(1)).alias("uses"), F.avg(F.col("r.passed").cast("double")).alias("success"), F.avg("r.p").alias("mean_p"))


def combination_summary(hypotheses: DataFrame) -> DataFrame:
    """Per set of referees (names sorted and joined): uses and the share of hypotheses that passed all."""
    key = F.array_join(F.array_sort(F.array_distinct(F.transform("referees", lambda r: r["name"]))), "+")
    return hypotheses.groupBy(key.alias("combination")).agg(F.count(F.lit(1)).alias("uses"), F.avg(F.forall("referees", lambda r: r["passed"]).cast("double")).alias("success"))


def brief_confidence(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean of the scores that are there."""
    total = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in scores.items()), F.lit(0.0)), total)


def strongest(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The relation of the largest .6 (1 - p) + .4 |effect| of each group; ties by x and y. pairs(by, x, y, p, effect)."""
    weight = 0.6 * (1 - F.col("p")) + 0.4 * F.abs("effect")
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(weight, 12)), "x", "y")
    return pairs.withColumn("weight", weight).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def field_rollup(pairs: DataFrame) -> DataFrame:
    """Per variable: its relations, largest |effect| and least p, over both sides of pairs(x, y, effect, p)."""
    sides = pairs.select(F.col("x").alias("field"), "effect", "p").union(pairs.select("y", "effect", "p"))
    return sides.groupBy("field").agg(F.count(F.lit(1)).alias("relations"), F.max(F.abs("effect")).alias("max_effect"), F.min("p").alias("min_p"))


def silence_acceleration(history: DataFrame, by: Sequence[str], recent: int = 3) -> DataFrame:
    """Mean |r| of the newest `recent` points, of those before, and the relative drop. history(by, ts, r)."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))
    s = history.withColumn("k", k).groupBy(*by).agg(F.avg(F.when(F.col("k") <= recent, F.abs("r"))).alias("recent"), F.avg(F.when(F.col("k") > recent, F.abs("r"))).alias("before"))
    return s.withColumn("drop", F.coalesce(ratio(F.col("before") - F.col("recent"), F.col("before")), F.lit(0.0)))
