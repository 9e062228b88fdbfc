"""Block bootstraps whose resamples are weights on the sums of blocks.

A pair's rows are dealt to BLOCKS blocks at most (stretches of the order, or random parts; a short pair's rows are blocks of their own) and
each block is summed once. A round draws as many blocks with replacement, so its sums are the drawn blocks' sums: a round costs no
pass over rows. Only a table of BLOCKS rows per pair leaves the aggregation, and pairs are worked on apart from each other. Seeds
depend on the pair alone, so a lost task's rerun gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 240
ROUNDS = 2000
SEED = 42


def in_blocks(rows: DataFrame, ordered: bool, blocks: int = BLOCKS) -> DataFrame:
    """rows(pair, idx, size) with their block. Stretches follow the places of idx between a pair's first and last."""
    n = F.least(F.col("size"), F.lit(blocks))
    if not ordered:
        return rows.withColumn("block", F.when(F.col("size") <= blocks, F.col("idx")).otherwise(F.pmod(F.xxhash64("idx", F.lit(SEED)), n)))
    ends = rows.groupBy("pair").agg(F.min("idx").alias("__from"), F.max("idx").alias("__to"))
    at = F.floor((F.col("idx") - F.col("__from")) * n / (F.col("__to") - F.col("__from") + 1))
    return rows.join(ends, "pair").withColumn("block", at).drop("__from", "__to")


def block_sums(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """pair, block and the sums of values of rows that have their block."""
    return rows.groupBy("pair", "block").agg(*[F.sum(c.cast("double")).alias(k) for k, c in values.items()])


Finish = Callable[[np.ndarray, np.ndarray], tuple]


def drawn(sums: DataFrame, names: list[str], finish: Finish, result: str, rounds: int = ROUNDS) -> DataFrame:
    """pair and the columns of `result` that finish(table, draws) gives for each pair: table has a row per block, in order, and the
    columns `names`; draws, `rounds` rows of as many block numbers."""
    tables = sums.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("block", F.array(*names).alias("v")))).alias("blocks"))  # BLOCKS at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pair, blocks in zip(f["pair"], f["blocks"], strict=True):
                table = np.array([b["v"] for b in blocks], float)
                draws = np.random.default_rng([SEED, crc32(str(pair).encode())]).integers(0, len(table), (rounds, len(table)))
                with np.errstate(all="ignore"):
                    out.append((pair, *finish(table, draws)))
            yield pd.DataFrame(out, columns=["pair", *(c.split()[0] for c in result.split(", "))])

    kind = sums.schema["pair"].dataType.simpleString()
    return tables.mapInPandas(run, f"pair {kind}, {result}")


def weighted(table: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The sums of the drawn blocks, a row per round."""
    n = len(table)
    weights = np.stack([np.bincount(d, minlength=n) for d in draws])
    return weights @ table


def share(wrong: np.ndarray) -> float:
    """The part of the rounds on the wrong side of a limit."""
    return float(np.mean(wrong))


def correlation(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ok = (vx > 1e-12) & (vy > 1e-12)
    return np.where(ok, (sxy - sx * sy / n) / np.sqrt(np.where(ok, vx * vy, 1)), 0.0)


def swept(s: np.ndarray, controls: range) -> np.ndarray:
    """Covariances (rounds x columns x columns) after the sweep of the controls; a control that others already tell is passed over."""
    s = s.copy()
    at_first = np.einsum("rii->ri", s).copy()
    for j in controls:
        pivot = s[:, j, j]
        ok = pivot > 1e-10 * np.maximum(at_first[:, j], 1e-300)
        s -= np.where(ok[:, None, None], s[:, :, j, None] * s[:, None, j, :] / np.where(ok, pivot, 1)[:, None, None], 0)
    return s


def partial_of(sums: np.ndarray, columns: int) -> np.ndarray:
    """The correlation of the first two columns with the others held, of each row of sums: the number, the columns' sums, and those of
    their products (upper triangle by rows)."""
    n, s = sums[:, 0], sums[:, 1 : columns + 1]
    gram = np.zeros((len(sums), columns, columns))
    upper = np.triu_indices(columns)
    gram[:, upper[0], upper[1]] = sums[:, columns + 1 :]
    gram[:, upper[1], upper[0]] = sums[:, columns + 1 :]
    left = swept(gram - s[:, :, None] * s[:, None, :] / n[:, None, None], range(2, columns))
    power = left[:, 0, 0] * left[:, 1, 1]
    whole = gram[:, 0, 0] * gram[:, 1, 1]
    ok = power > 1e-20 * np.maximum(whole, 1e-300)
    return np.where(ok, left[:, 0, 1] / np.sqrt(np.where(ok, power, 1)), 0.0)
