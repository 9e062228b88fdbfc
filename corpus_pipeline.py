"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's rows as Parquet in the shared folder and reads them again as the next one's docs, so a lost executor costs a task
and not the stages before it.

Each stage keeps its input's columns, of whatever names and types (packing alone returns pieces). Rows with null texts, and empty or
too short ones, fail the quality rules; a null doc_id counts as an id, after all others where a choice is by the least id; repeated rows
are near-duplicates of each other, so one stays; an empty documents table gives no pieces, an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, packing, quality, secrets, simhash
from tidemark.llm.queries import vocabulary
from tidemark.llm.util import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line frequencies reject go (null and empty texts with them), and boilerplate lines go from the
    others; n_chars follows."""
    return quality.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, .8 in common or more) stays: that of the least doc_id (null counts
    last; of equal ids, that with the least hash)."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; items without text match nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret found is replaced by a mark of its kind; n_chars follows. Null texts stay null."""
    return secrets.masked(docs)


def packing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces, of all rows; a null text is an empty document of one token."""
    return packing.digest(packing.packed(docs, vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret masking", secret_masking),
    ("packing", packing_order),
]

#: SQL can't express the stages (fingerprints, alignments, tokens); the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
