"""Tests of whole vectors, over all points and without a pair's vector in one task.

A pair's rows are cut into chunks of about CHUNK rows: stretches of the order where neighbours in time matter, random parts
otherwise. A kernel turns a chunk into sums of fixed length, the sums of all chunks are added by an aggregation, and `finish` turns
them into the statistic. A pair of up to CHUNK rows is one chunk, and so gives what the plain form gives. Shuffled versions
permute y within chunks: under the null hypothesis these are as likely as any others. Tests by nearest neighbours are in
information.py; theirs are those among all points.

Seeds depend on the pair and the chunk alone, so a lost task's rerun gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import complexity, information

CHUNK = 2048
SEED = 42
RESULT = "pair string, n bigint, statistic double, p double, passed boolean"
#: Quantiles that kernels and codes use.
EIGHTHS = tuple(i / 8 for i in range(1, 8))
POINTS = (0.1, 0.25, 0.5, 0.6, 0.75, 0.9)


@dataclass(frozen=True)
class Test:
    """kernel(chunk, rng): sums of a chunk (a frame of idx, x, y, what `facts` adds, and `n`, the pair's rows); finish(n, sums, rng):
    statistic, p, passed. ordered: chunks are stretches of the order. before and after: so many rows around a stretch come with it, with
    core false; `at` is a row's place from 0 (idx must have no gaps). chunk: the most rows of such a stretch."""

    kernel: Callable[[pd.DataFrame, np.random.Generator], np.ndarray]
    finish: Callable[[int, np.ndarray, np.random.Generator], tuple[float, float, bool]]
    ordered: bool = False
    before: int = 0
    after: int = 0
    chunk: int = CHUNK


def facts(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Finite rows of pairs with `least` of them or more, with n, means mx, my, deviations dx, dy, bounds, x's quantiles qx and the
    eighths a and b that x and y lie in. One aggregation; a row per pair is joined."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ok = pairs.withColumns({"x": x, "y": y}).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").withColumn("pair", F.col("pair").cast("string"))
    of = ok.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(p + c) for c in ("x", "y") for p, f in (("m", F.avg), ("d", F.stddev_pop), ("l", F.min), ("h", F.max))], F.min("idx").alias("from"), F.max("idx").alias("to"),
        F.percentile_approx("x", list(POINTS), 10_000).alias("qx"), *[F.percentile_approx(c, list(EIGHTHS), 10_000).alias(f"e{c}") for c in ("x", "y")],
    ).where(F.col("n") >= least)
    code = lambda c: F.size(F.filter(f"e{c}", lambda cut: cut < F.col(c)))
    return ok.join(of, "pair").withColumns({"a": code("x"), "b": code("y")}).drop("ex", "ey")


def chunks(rows: DataFrame, ordered: bool) -> DataFrame:
    """rows, as facts() has them, with their chunk."""
    parts = F.ceil(F.col("n") / CHUNK)
    if ordered:
        return rows.withColumn("chunk", F.floor((F.col("idx") - F.col("from")) * parts / (F.col("to") - F.col("from") + 1)))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("pair", "idx", F.lit(SEED)), parts))


def with_surroundings(rows: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """rows, as facts() has them, with their chunk (a stretch), at and core; and again in the chunks whose surroundings they are."""
    parts = F.ceil(F.col("n") / chunk)
    length = F.ceil(F.col("n") / parts)
    at = rows.withColumns({"at": F.col("idx") - F.col("from"), "parts": parts}).withColumn("length", length)
    own = F.floor(F.col("at") / F.col("length"))
    low, high = (F.greatest(F.least(F.floor(v / F.col("length")), F.col("parts") - 1), F.lit(0)) for v in (F.col("at") - after, F.col("at") + before))
    return at.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("core", F.col("chunk") == own).drop("parts", "length")


def judged(pairs: DataFrame, test: Test, least: int = 10) -> DataFrame:
    """RESULT of a test for each pair."""
    rows = facts(pairs, least)
    return summed(with_surroundings(rows, test.before, test.after, test.chunk) if test.before or test.after else chunks(rows, test.ordered), test)


def summed(rows: DataFrame, test: Test) -> DataFrame:
    """RESULT of a test for the pairs of rows, which have their chunks."""
    seed = lambda *x: np.random.default_rng([SEED, *(crc32(str(v).encode()) for v in x)])

    def chunk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        pair, number, n = part["pair"].iloc[0], int(part["chunk"].iloc[0]), int(part["n"].iloc[0])
        with np.errstate(all="ignore"):
            sums = test.kernel(part, seed(pair, number))
        return pd.DataFrame({"pair": [pair], "n": [n], "sums": [np.nan_to_num(np.asarray(sums, float)).ravel()]})

    each = rows.groupBy("pair", "chunk").applyInPandas(chunk, "pair string, n bigint, sums array<double>")
    added = each.select("pair", "n", F.posexplode("sums").alias("at", "value")).groupBy("pair", "n", "at").agg(F.sum("value").alias("value"))
    whole = added.groupBy("pair", "n").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("sums"))  # as long as the kernel's sums

    def end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pair, n, sums in zip(f["pair"], f["n"], f["sums"], strict=True):
                with np.errstate(all="ignore"):
                    statistic, p, passed = test.finish(int(n), np.array([s["value"] for s in sums]), seed(pair))
                out.append((pair, int(n), float(statistic), float(p), bool(passed)))
            yield pd.DataFrame(out, columns=["pair", "n", "statistic", "p", "passed"])

    return whole.mapInPandas(end, RESULT)


def _columns(part: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [part[c].to_numpy(float) for c in names]


def _standard(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x, y, mx, dx, my, dy = _columns(part, "x", "y", "mx", "dx", "my", "dy")
    return (x - mx) / np.where(dx > 0, dx, 1), (y - my) / np.where(dy > 0, dy, 1)


def _p(null: np.ndarray, observed: float) -> float:
    return float((1 + (null >= observed - 1e-12).sum()) / (len(null) + 1))


# --- permutation


def permutation(rounds: int = 2500, alpha: float = 0.001) -> Test:
    """|r| against r of shuffled y."""

    def kernel(part, rng):
        x, y = _standard(part)
        return np.array([x @ y, *(x @ rng.permutation(y) for _ in range(rounds))])

    def finish(n, sums, rng):
        p = _p(np.abs(sums[1:]) / n, abs(sums[0]) / n)
        return abs(sums[0]) / n, p, p <= alpha

    return Test(kernel, finish)


# --- form


def functional_form(folds: int = 5) -> Test:
    """How much better a cubic tells left-out values than a line; folds are idx mod `folds`. All from sums of powers."""

    def kernel(part, rng):
        x, y = _standard(part)
        fold = part["idx"].to_numpy(np.int64) % folds
        values = np.stack([*(x**i for i in range(7)), *(y * x**i for i in range(4)), y * y])
        return np.stack([values[:, fold == f].sum(1) for f in range(folds)])

    def finish(n, sums, rng):
        by = sums.reshape(folds, 12)
        sse = {}
        for degree in (1, 3):
            at = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))
            sse[degree] = 0.0
            for f in range(folds):
                rest = by.sum(0) - by[f]
                c = np.linalg.lstsq(rest[at], rest[7 : 8 + degree], rcond=None)[0]
                sse[degree] += by[f, 11] - 2 * c @ by[f, 7 : 8 + degree] + c @ by[f][at] @ c
        whole = by.sum(0)
        total = whole[11] - whole[7] ** 2 / whole[0] or 1.0
        gain = (sse[1] - sse[3]) / total
        ratio = max(0.0, (sse[1] - sse[3]) / 2 / (sse[3] / max(1, n - 4) or 1e-12))
        p = float(special.f_upper(ratio, 2, max(1, n - 4)))
        return gain, p, gain < 0.05 or p > 0.05

    return Test(kernel, finish)


# --- topology


def homology(cells: int = 32, rounds: int = 200) -> Test:
    """Persistence of connected components: the longest edge of the least spanning tree over the median one, against shuffles.
    Points count by the cell of a fixed grid that they lie in, so the tree has at most cells * cells nodes."""

    def kernel(part, rng):
        x, y, lx, hx, ly, hy = _columns(part, "x", "y", "lx", "hx", "ly", "hy")
        place = lambda v, low, high: np.minimum((v - low) / np.where(high > low, high - low, 1) * cells, cells - 1).astype(np.int64)
        a, b = place(x, lx, hx), place(y, ly, hy)
        grid = lambda b: np.bincount(a * cells + b, minlength=cells * cells)
        return np.concatenate([grid(b), *(grid(rng.permutation(b)) for _ in range(rounds))])

    def ratio(grid: np.ndarray) -> float:
        points = np.stack(np.divmod(np.flatnonzero(grid), cells), 1).astype(float)
        best, done, edges, at = np.full(len(points), np.inf), np.zeros(len(points), bool), [], 0
        for _ in range(len(points) - 1):
            done[at] = True
            best = np.minimum(best, np.sqrt(((points - points[at]) ** 2).sum(1)))
            at = int(np.argmin(np.where(done, np.inf, best)))
            edges.append(best[at])
        return max(edges) / np.median(edges) if edges else 1.0

    def finish(n, sums, rng):
        observed, *null = (ratio(g) for g in sums.reshape(-1, cells * cells))
        p = _p(np.array(null), observed)
        return observed, p, observed >= 3 and p < 0.01

    return Test(kernel, finish)


# --- complexity


def lempel_ziv(codes: np.ndarray) -> int:
    """Phrases of the incremental (1978) parse."""
    seen, phrase, count = set(), (), 0
    for c in codes.tolist():
        phrase += (c,)
        if phrase not in seen:
            seen.add(phrase)
            phrase, count = (), count + 1
    return count + bool(phrase)


def lempel_ziv_synergy(rounds: int = 100) -> Test:
    """Joint against single complexities of eight-letter codes: (cx + cy - cxy) / max(cx, cy), summed over stretches, against shuffles."""

    def kernel(part, rng):
        a, b = (part[c].to_numpy(np.int64) for c in ("a", "b"))
        shuffled = [rng.permutation(b) for _ in range(rounds)]
        return np.concatenate([[lempel_ziv(a)], *([lempel_ziv(v), lempel_ziv(a * 8 + v)] for v in [b, *shuffled])])

    def finish(n, sums, rng):
        single, joint = sums[1:].reshape(-1, 2).T
        synergy = (sums[0] + single - joint) / np.maximum(sums[0], single)
        null, observed = synergy[1:], synergy[0]
        p = _p(np.abs(null - null.mean()), abs(observed - null.mean()))
        return observed, p, abs(observed) > 0.3 and p < 0.05

    return Test(kernel, finish, ordered=True)


# --- counterfactual


def intervention(rounds: int = 1000) -> Test:
    """The mean effect on y of setting x to five of its quantiles instead of its median (a line), with a 99.9 % interval of
    bootstrap samples in which each row counts as often as a Poisson draw says."""

    def kernel(part, rng):
        x, y = _standard(part)
        values = np.stack([np.ones(len(x)), x, y, x * x, x * y], 1)
        weights = rng.poisson(1.0, (rounds, len(x)))
        q = part["qx"].iloc[0]
        reach = np.mean([abs(v - q[2]) for i, v in enumerate(q) if i != 2]) * (part["dy"].iloc[0] or 1) / (part["dx"].iloc[0] or 1)
        return np.concatenate([[reach * len(x)], values.sum(0), (weights @ values).ravel()])

    def finish(n, sums, rng):
        def slope(s):
            spread = s[:, 0] * s[:, 3] - s[:, 1] ** 2
            return np.where(spread > 1e-12, (s[:, 0] * s[:, 4] - s[:, 1] * s[:, 2]) / np.where(spread > 1e-12, spread, 1), 0)

        effects = slope(sums[1:].reshape(-1, 5)) * sums[0] / n
        draws = effects[1:]
        low, high = np.quantile(draws, (0.0005, 0.9995))
        p = min(1.0, 2 * (1 + min((draws <= 0).sum(), (draws >= 0).sum())) / (rounds + 1))
        return effects[0], p, low > 0 or high < 0

    return Test(kernel, finish)


# --- spectra


def segment_size(n: int) -> int:
    return int(max(8, min(256, 2 * n // 9)))


def tapers(method: str, size: int) -> tuple[np.ndarray, int]:
    """Weights of a window's rows, a row for each taper, and how far windows lie apart. welch: a Hann window, half overlapping; periodogram:
    none; multitaper: five orthogonal sine tapers."""
    if method == "welch":
        return np.hanning(size)[None], max(1, size // 2)
    if method == "periodogram":
        return np.ones((1, size)), size
    if method == "multitaper":
        return np.sqrt(2 / (size + 1)) * np.sin(np.pi * np.outer(np.arange(1, 6), np.arange(1, size + 1)) / (size + 1)), size
    raise ValueError(method)


def spectral(method: str = "welch", rounds: int = 100, limit: float = 0.5) -> Test:
    """The mean coherence: cross spectra averaged over windows (without their mean) and tapers; against shuffles. A window belongs to the
    chunk that it starts in, which holds the rows up to its end."""

    def spectra(v: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        parts = np.lib.stride_tricks.sliding_window_view(v, size)[starts]
        weights, _ = tapers(method, size)
        return np.fft.rfft((parts - parts.mean(1, keepdims=True))[:, None] * weights, axis=2)[:, :, 1:].reshape(-1, size // 2)

    def kernel(part, rng):
        x, y = _standard(part)
        size = segment_size(int(part["n"].iloc[0]))
        _, step = tapers(method, size)
        at = part["at"].to_numpy(np.int64)
        starts = np.flatnonzero((at % step == 0) & part["core"].to_numpy(bool))
        starts = starts[starts + size <= len(x)]
        if not len(starts):
            return np.zeros(size // 2 * (1 + 3 * (rounds + 1)))
        a = spectra(x, starts, size)
        out = [(np.abs(a) ** 2).sum(0)]
        for v in [y, *(rng.permutation(y) for _ in range(rounds))]:
            b = spectra(v, starts, size)
            cross = (a * b.conj()).sum(0)
            out += [cross.real, cross.imag, (np.abs(b) ** 2).sum(0)]
        return np.concatenate(out)

    def finish(n, sums, rng):
        size = segment_size(n) // 2
        xx, rest = sums[:size], sums[size:].reshape(-1, 3, size)
        power = xx * rest[:, 2]
        c = (np.where(power > 0, (rest[:, 0] ** 2 + rest[:, 1] ** 2) / np.where(power > 0, power, 1), 0)).mean(1)
        p = _p(c[1:], c[0])
        return c[0], p, c[0] > limit and p < 0.05

    return Test(kernel, finish, ordered=True, before=0, after=256)


#: Rows of a wavelet's stretch: seven times what it reaches on both sides together.
STRETCH = 14_336


def transform_size(n: int) -> int:
    """A length for transforms of n rows, with room for what a wavelet reaches, so that the ends don't meet."""
    if n <= 2 * CHUNK:
        return 1 << (2 * n - 1).bit_length()
    return min(m << max(0, (-(-(n + CHUNK) // m) - 1).bit_length()) for m in (1, 3, 5, 9, 15))


#: A wavelet's scale for a period, and its transform at scale times frequency.
WAVELETS: dict[str, tuple[float, Callable[[np.ndarray], np.ndarray]]] = {
    "morlet": (5.0 / (2 * np.pi), lambda w: np.exp(-0.5 * (w - 5.0) ** 2) * (w > 0)),
    "paul": (9 / (4 * np.pi), lambda w: np.where(w > 0, np.maximum(w, 0) ** 4 * np.exp(-np.maximum(w, 0)), 0.0)),
    "dog": (np.sqrt(2.5) / (2 * np.pi), lambda w: w**2 * np.exp(-0.5 * w**2)),
}


def wavelet(form: str = "morlet", scales: int = 32, rounds: int = 50, limit: float = 0.4) -> Test:
    """Wavelet coherence: transforms (Morlet's, Paul's of order 4, or the second derivative of a Gaussian) at periods from 2 to 100 rows,
    smoothed over time and neighbouring scales before they are compared (without smoothing it is 1 everywhere); the mean outside the
    series' edges, against shuffles. Chunks hold the rows around them that their transforms reach."""
    per_period, transform_of = WAVELETS[form]
    s = np.geomspace(2, 100, scales) * per_period

    def kernel(part, rng):
        x, y = _standard(part)
        n = len(x)
        size = transform_size(n)
        f = 2 * np.pi * np.fft.fftfreq(size)
        mother = transform_of(s[:, None] * f)
        blur = np.exp(-0.5 * (s[:, None] * f) ** 2)
        half = blur[:, : size // 2 + 1]
        at, core, of = part["at"].to_numpy(np.int64), part["core"].to_numpy(bool), int(part["n"].iloc[0])
        own_rows = np.flatnonzero(core)
        if not len(own_rows):
            return np.zeros(rounds + 2)
        inner = slice(own_rows[0], own_rows[-1] + 1)
        far = (core & (np.minimum(at, of - 1 - at) >= np.sqrt(2) * s[:, None]))[:, inner]  # from the edges

        # a scale at a time, so that its rows stay in the processor's cache
        transform = lambda v, j: np.fft.ifft(v * mother[j])[:n]
        power = lambda b, j: np.fft.irfft(np.fft.rfft(b.real**2 + b.imag**2, size) * half[j], size)[inner]
        cross = lambda c, j: np.fft.ifft(np.fft.fft(c, size) * blur[j])[inner]

        def scaled(t: np.ndarray, j: int) -> np.ndarray:
            return (t[max(j - 1, 0)] + t[j] + t[min(j + 1, scales - 1)]) / 3

        of_x = np.fft.fft(x, size)
        a = np.stack([transform(of_x, j) for j in range(scales)])
        smooth = [power(a[j], j) for j in range(scales)]
        own = [scaled(smooth, j) for j in range(scales)]
        np.conjugate(a, out=a)
        out = []
        for v in [y, *(rng.permutation(y) for _ in range(rounds))]:
            of_v, powers, crosses = np.fft.fft(v, size), [], []
            for j in range(scales):
                b = transform(of_v, j)
                powers.append(power(b, j))
                crosses.append(cross(a[j] * b, j))
            total = 0.0
            for j in range(scales):
                both, met = own[j] * scaled(powers, j), scaled(crosses, j)
                c = np.where(both > 1e-300, (met.real**2 + met.imag**2) / np.maximum(both, 1e-300), 0)
                total += c[far[j]].sum()
            out.append(total)
        return np.array([far.sum(), *out])

    def finish(n, sums, rng):
        c = np.clip(sums[1:] / max(sums[0], 1), 0, 1)
        p = _p(c[1:], c[0])
        return c[0], p, c[0] > limit and p < 0.05

    return Test(kernel, finish, ordered=True, before=1024, after=1024, chunk=STRETCH)


#: RESULT (and more columns) of each test of pairs(pair, idx, x, y).
TESTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "permutation": lambda pairs: judged(pairs, permutation()),
    "transfer_entropy": information.transfer_entropy,
    "cross_mapping": information.cross_mapping,
    "mutual_information": information.mutual_information,
    "conditional_mi": lambda pairs: information.conditional_information(pairs, tuple(c for c in pairs.columns if c.startswith("z"))),
    "functional_form": lambda pairs: judged(pairs, functional_form()),
    "homology": lambda pairs: judged(pairs, homology()),
    "lempel_ziv": lambda pairs: judged(pairs, lempel_ziv_synergy()),
    "complexity": complexity.algorithmic,
    "intervention": lambda pairs: judged(pairs, intervention()),
    "wavelet_coherence": lambda pairs: judged(pairs, wavelet()),
    "spectral_analysis": lambda pairs: judged(pairs, spectral()),
}
