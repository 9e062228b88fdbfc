"""What to do with a variable or hypothesis: test settings from its profile, and what a finding is worth.

All are column expressions over one row per variable or hypothesis.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Significance floors and rounds of shuffles.
ALPHA, ALPHA_ODD, ALPHA_POOR = 0.001, 0.005, 0.01
ROUNDS, ROUNDS_SPARSE, ROUNDS_NOISY = 2500, 5000, 10_000
# Factors of a finding's value, by the first group of words that its text holds.
VALUE_WORDS = ((("causal", "correlation"), 1.5), (("predict", "forecast"), 1.3), (("segment", "cluster"), 1.2))
STRONG_WORDS = ("strong correlation", "significant effect")
# Phrases between a cause and its effect, in the order in which they are looked for.
RELATION_PHRASES = ("predicts", "influences", "affects", "determines", "correlates with", "leads to", "causes", "results in", "associated with")
# Words of evidence kinds, in a finding's scientific and business text.
KIND_WORDS = {"breakpoint": (("threshold", "breakpoint", "critical", "tipping"), ("drops at", "changes at", "breaks at")), "hysteresis": (("hysteresis", "path-dependent", "memory", "recovery"), ("takes time", "recovery", "irreversible"))}
# Weights of evidence kinds in a confidence.
KIND_WEIGHTS = {"correlation": 0.4, "breakpoint": 0.4, "hysteresis": 0.2}


def _holds(text: Column, words) -> Column:
    return F.coalesce(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def validation(profiles: DataFrame) -> DataFrame:
    """profiles(is_normal, sparsity, noise, autocorr_1, is_categorical) with alpha, iterations, nonparametric, bootstrap_samples (0: none)."""
    odd, sparse, noisy = ~F.col("is_normal"), F.col("sparsity") > 0.5, F.col("noise") > 0.7
    return profiles.withColumns({
        "alpha": F.when(sparse | noisy, ALPHA_POOR).when(odd, ALPHA_ODD).otherwise(ALPHA),
        "iterations": F.when(noisy, ROUNDS_NOISY).when(sparse, ROUNDS_SPARSE).otherwise(ROUNDS),
        "nonparametric": odd | F.col("is_categorical"),
        "bootstrap_samples": F.when(F.col("autocorr_1") > 0.3, 2000).otherwise(0),
    })


def referee_policy(profiles: DataFrame) -> DataFrame:
    """profiles(is_normal, sparsity, noise, autocorr_1, is_categorical, is_stationary, lags) with the settings of shuffle, stability,
    direction and resampling tests."""
    odd, sparse, noisy, steady = ~F.col("is_normal"), F.col("sparsity") > 0.5, F.col("noise") > 0.7, F.col("is_stationary")
    rounds = F.when(noisy, ROUNDS_NOISY).when(sparse, ROUNDS_SPARSE).otherwise(ROUNDS)
    lags = F.coalesce(F.col("lags"), F.array().cast("array<int>"))
    block = F.col("autocorr_1") > 0.3
    return profiles.withColumns({
        "shuffle_rounds": F.when(steady, rounds).otherwise(F.greatest(rounds, F.lit(ROUNDS_SPARSE))),
        "shuffle_alpha": F.when(odd | (sparse & ~noisy), ALPHA_ODD).otherwise(ALPHA),
        "early_exit": ~noisy,
        "break_alpha": F.when(steady, ALPHA).otherwise(ALPHA_POOR),
        "trim": F.when(F.col("sparsity") > 0.7, 0.20).otherwise(0.15),
        "max_lag": F.least(F.lit(20), F.when(F.size(lags) > 0, F.greatest(F.array_max(lags), F.lit(0)) + 2).otherwise(5)),
        "direction_test": F.when(odd, "nonparametric").otherwise("parametric"),
        "bootstrap_size": F.when(F.col("noise") > 0.8, 2000).otherwise(1000),
        "resampling": F.when(block, "block").when(F.col("is_categorical"), "stratified").otherwise("independent"),
        "block_size": F.when(block, F.greatest(F.lit(5), F.floor(F.size(lags) * 1.5).cast("int"))),
    })


def worth(text: Column, confidence: Column) -> dict[str, Column]:
    """opportunity_cost (100 at least), leverage (99.99 at most) and price of acting on a finding, from its text's bytes and words."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    factor = reduce(lambda out, w: out.when(_holds(text, w[0]), w[1]), VALUE_WORDS[1:], F.when(_holds(text, VALUE_WORDS[0][0]), VALUE_WORDS[0][1])).otherwise(1.0)
    return {
        "opportunity_cost": F.greatest(F.lit(100.0), confidence * 1000.0 * F.least(size / 500.0, F.lit(3.0)) * factor),
        "leverage": F.least(F.lit(99.99), confidence * 100 * F.when(_holds(text, STRONG_WORDS), 1.2).otherwise(1.0)),
        "price": F.when(size > 500, 200.0).otherwise(100.0) + 50.0,
    }


def _variable(text: Column) -> Column:
    """The first word of 2 to 20 characters with a capital, and a digit or _ or at most 6 characters; '' if there is none."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.btrim(w, F.lit(".,!?\"'()")))
    fits = lambda w: F.length(w).between(2, 20) & w.rlike("[A-Z]") & (w.rlike("[_0-9]") | (F.length(w) <= 6))
    return F.coalesce(F.get(F.filter(words, fits), 0), F.lit(""))


def cause_effect(text: Column, cause: Column, effect: Column) -> tuple[Column, Column]:
    """Cause and effect: those given, or where one is missing the first variables before and after the first relation phrase."""
    lower = F.lower(text)
    at = reduce(lambda out, p: out.when(F.contains(lower, F.lit(p)), F.struct(F.instr(lower, p).alias("i"), F.lit(len(p)).alias("n"))), RELATION_PHRASES[1:], F.when(F.contains(lower, F.lit(RELATION_PHRASES[0])), F.struct(F.instr(lower, RELATION_PHRASES[0]).alias("i"), F.lit(len(RELATION_PHRASES[0])).alias("n"))))
    given = (F.coalesce(cause, F.lit("")) != "") & (F.coalesce(effect, F.lit("")) != "")
    of = lambda known, part: F.when(given | at.isNull(), F.coalesce(known, F.lit(""))).otherwise(_variable(part))
    return of(cause, F.substring(text, F.lit(1), at["i"] - 1)), of(effect, F.substring(text, at["i"] + at["n"], F.length(text)))


def evidence_kind(science: Column, business: Column) -> Column:
    """breakpoint, hysteresis or correlation, by words of the texts."""
    out = None
    for kind, (a, b) in KIND_WORDS.items():
        hit = _holds(science, a) | _holds(business, b)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("correlation")


def overall_confidence(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Mean weighted confidence of what counts: relations and breakpoints with p under .05, hysteresis of strength over .5; .5 if
    nothing does. evidence(by, kind, p, strength)."""
    weight = reduce(lambda out, k: out.when(F.col("kind") == k, KIND_WEIGHTS[k]), list(KIND_WEIGHTS)[1:], F.when(F.col("kind") == "correlation", KIND_WEIGHTS["correlation"]))
    value = F.when(F.col("kind") == "hysteresis", F.when(F.col("strength") > 0.5, F.col("strength"))).when(F.col("p") < 0.05, 1 - F.col("p"))
    return evidence.groupBy(*by).agg(F.coalesce(F.avg(value * weight), F.lit(0.5)).alias("confidence"))


def run_verdict(results: DataFrame, stability: DataFrame, key: str = "hypothesis", least: float = 0.8) -> DataFrame:
    """key, confidence (share of tests passed) and passed: a test at least, and where there is a stability that of `least` or more.
    results(key, passed), stability(key, share)."""
    votes = results.groupBy(key).agg(F.count_if("passed").alias("n"), F.avg(F.col("passed").cast("double")).alias("confidence"))
    return votes.join(stability.select(key, "share"), key, "left").select(key, "confidence", ((F.col("n") > 0) & (F.coalesce("share", F.lit(1.0)) >= least)).alias("passed"))
