r"""Resampling towards a target distribution by importance weights of hashed features.

A document's features are its runs of 1 to LONGEST words, hashed into BUCKETS. A bucket's gain is the log ratio of its share in the
target texts and its share in the documents (both smoothed by one), and a document's weight is the sum of its features' gains. Gumbel
noise from a hash of the id turns the weights into scores, whose highest are a draw without replacement by weight.

Higher-order functions make each document's array of buckets, and its weight is an aggregate over element_at of a literal array
of the BUCKETS gains: scoring explodes and shuffles nothing. Only the buckets' totals are shuffled (BUCKETS rows a task at most), and they
alone come to the driver. Ranks come from a range partitioning of small rows (util.ranked).

Nulls and empty texts: no features, weight 0. A null id is hashed as '' and comes last of equal scores. Repeated rows are each counted,
scored and ranked; equal ones stand next to each other. Very long texts are counted whole, their buckets one array. An empty table gives
an empty result; without target texts all gains follow from the documents alone. Extra columns don't matter.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import keep, ranked

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A text's words; A-Z are lower-cased, other letters stay as they are."""
    plain = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), plain)


def buckets(words: Column, longest: int, n: int) -> Column:
    """The buckets of all runs of 1 to `longest` words."""
    runs = [words]
    for k in range(2, longest + 1):
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")))  # noqa: B023
    return F.transform(F.concat(*runs), lambda f: (F.crc32(f.cast("binary")) % n).cast("smallint" if n < 1 << 15 else "int"))


def totals(featured: DataFrame, n: int) -> list[int]:
    """How many features are in each bucket."""
    out = [0] * n
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets."""
    n, s_all, t_all = len(own), float(sum(own)), float(sum(target))
    return [math.floor(1000.0 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(own, target, strict=True)]


def featured(docs: DataFrame, longest: int, n: int) -> DataFrame:
    """doc_id, n_words and buckets of every row."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("words"))
    return split.select("doc_id", F.size("words").alias("n_words"), buckets(F.col("words"), longest, n).alias("buckets"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs, drawn towards target(text): `percent` of the
    documents with `least_words` words or more."""
    own = keep(featured(docs, longest, n_buckets).withColumn("row", F.monotonically_increasing_id()), "buckets")
    wanted = featured(target.select(F.lit(0).alias("doc_id"), "text"), longest, n_buckets)
    table = F.split(F.lit(",".join(map(str, gains(totals(own, n_buckets), totals(wanted, n_buckets))))), ",").cast("array<bigint>")  # folded to a literal
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda sum, b: sum + F.element_at(table, b.cast("int") + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = own.select("row", "doc_id", F.size("buckets").cast("long").alias("n_features"), "n_words", weight.alias("weight"))
    scored = keep(scored.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = scored.where(F.col("n_words") >= least_words).select("row", "doc_id", "score")
    quota = able.count() * percent // 100
    drawn = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]).where(F.col("rank") <= quota).select("row", "rank")
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
