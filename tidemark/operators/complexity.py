"""How complex short windows of a series are, by three coders, and how even that stays.

A window of WIDTH rows starts at every STEPS-th part of a pair's order; its values of x and y follow each other in turn. Three figures
tell how well the sequence can be shortened: matches with what came before (LZ77), runs of equal values, and differences of
neighbours. Only the windows' rows are looked at, a few hundred per pair.
"""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STEPS = 30, 10
#: The longest match, and what a match and a run take in symbols.
LONGEST, PAIR = 10, 2
SEED = 42


def lz77(values: list) -> float:
    """Symbols after the coder over symbols before: a match with what came before (two to LONGEST symbols, the first of the longest ones)
    takes PAIR symbols, anything else one. Chains lead from two symbols that follow each other to the places where they stood."""
    if len(values) < 3:
        return 0.0
    chains: dict[tuple, list[int]] = defaultdict(list)
    out = at = known = 0
    while at < len(values):
        while known + 1 < at:  # a match ends before the place that it is for
            chains[values[known], values[known + 1]].append(known)
            known += 1
        best = 1
        for start in chains.get(tuple(values[at : at + 2]), ()):
            most = min(LONGEST, len(values) - at, at - start)
            length = next((k for k in range(2, most) if values[start + k] != values[at + k]), most)
            best = max(best, length)
        out += PAIR if best > 1 else 1
        at += best
    return out / len(values)


def run_length(values: np.ndarray) -> float:
    return min(1.0, PAIR * (1 + int((values[1:] != values[:-1]).sum())) / len(values)) if len(values) else 0.0


def delta(values: np.ndarray) -> float:
    """The deviation of neighbours' differences, in parts of the range."""
    if len(values) < 2:
        return 0.0
    spread = float(values.max() - values.min())
    return min(1.0, float(np.diff(values).std()) / spread) if spread else 0.5


def figures(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    values = np.stack([x, y], 1).ravel()
    return lz77(values.tolist()), run_length(values), delta(values)


def stability(each: np.ndarray) -> float:
    """1 - 3 times the coefficient of variation of the windows' mean figures, at least 0."""
    if len(each) < 2:
        return 1.0
    means = each.mean(1)
    return max(0.0, 1 - 3 * means.std(ddof=1) / abs(means.mean())) if means.mean() else 0.0


def windowed(pairs: DataFrame, width: int = WIDTH, steps: int = STEPS, least: int = 10) -> DataFrame:
    """pair, n, window and idx, x, y of the rows in windows (which may overlap) of pairs with enough rows that have both values."""
    ok = pairs.select(F.col("pair").cast("string").alias("pair"), "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ok = ok.where("pair IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    of = ok.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("from")).where(F.col("n") >= least)
    step = F.greatest(F.floor(F.col("n") / steps), F.lit(1))
    at = ok.join(of, "pair").withColumns({"at": F.col("idx") - F.col("from"), "step": step})
    last = F.least(F.floor(F.col("at") / F.col("step")), F.lit(steps - 1))
    first = F.greatest(F.ceil((F.col("at") - width + 1) / F.col("step")), F.lit(0))
    near = at.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    return near.select("pair", "n", F.col("window").cast("int").alias("window"), "idx", "x", "y")


def windows(pairs: DataFrame, width: int = WIDTH, steps: int = STEPS) -> DataFrame:
    """pair, window, rows, lz77, run_length and delta of each window."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        return pd.DataFrame([(part["pair"].iloc[0], part["window"].iloc[0], len(part), *figures(part["x"].to_numpy(), part["y"].to_numpy()))], columns=["pair", "window", "rows", "lz77", "run_length", "delta"])

    return windowed(pairs, width, steps).groupBy("pair", "window").applyInPandas(run, "pair string, window int, rows int, lz77 double, run_length double, delta double")


def algorithmic(pairs: DataFrame, width: int = WIDTH, steps: int = STEPS, rounds: int = 200, limit: float = 0.6, most: float = 0.05) -> DataFrame:
    """pair, n, statistic (the stability of the windows' figures), p, passed: it is beyond the limit and p below `most`. p is the share of
    rounds, in which the windows' rows are dealt anew, that are as stable."""

    def run(part: pd.DataFrame) -> pd.DataFrame:  # `width` times `steps` rows
        part = part.sort_values(["window", "idx"])
        pair, n = part["pair"].iloc[0], int(part["n"].iloc[0])
        rng = np.random.default_rng([SEED, crc32(pair.encode())])
        x, y, sizes = part["x"].to_numpy(), part["y"].to_numpy(), part.groupby("window").size().to_numpy()
        ends = np.cumsum(sizes)[:-1]
        told = lambda order: stability(np.array([figures(x[o], y[o]) for o in np.split(order, ends)]))
        observed = told(np.arange(len(x)))
        p = (1 + sum(told(rng.integers(0, len(x), len(x))) >= observed for _ in range(rounds))) / (rounds + 1)
        return pd.DataFrame({"pair": [pair], "n": [n], "statistic": [observed], "p": [p], "passed": [bool(observed > limit and p < most)]})

    return windowed(pairs, width, steps).groupBy("pair").applyInPandas(run, "pair string, n bigint, statistic double, p double, passed boolean")
