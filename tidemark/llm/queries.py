"""The corpus operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ctw, decontam, licenses, ngram_join, packing, quality, resample, secrets, shards, simhash, suffix_dedup, warc_index
from .oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archived(table(spark, sf_dir, "pages"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), 16)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(table(spark, sf_dir, "documents"), vocabulary()))


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judged(table(spark, sf_dir, "documents")))


def op8_winnowed_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op9_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.deduplicated(table(spark, sf_dir, "documents")))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def op11_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op12_gain_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_spaced_seeds, op2_capture_index, op3_virtual_slots, op4_simhash, op5_hilbert_packing, op6_blob_ledger, op7_line_frequency, op8_winnowed_licenses, op9_bucket_refinement, op10_context_tree, op11_universe_partition, op12_gain_array, op13_token_alignment)
}

__all__ = ["ORACLE_SQL", "QUERIES", "vocabulary"]
