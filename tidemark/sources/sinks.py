"""Writers: exports, artifact ledgers, tiering by size, gated and expiring tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",)) -> dict[str, str]:
    """Writes one folder per format; what goes wrong with a format is told and doesn't stop the others."""
    out = {}
    for form in formats:
        try:
            writer = df.write.mode("overwrite")
            {"csv": lambda: writer.option("header", True).csv(f"{path}/csv"), "json": lambda: writer.json(f"{path}/json"), "parquet": lambda: writer.parquet(f"{path}/parquet"), "orc": lambda: writer.orc(f"{path}/orc")}[form]()  # noqa: B023
            out[form] = "written"
        except Exception as e:  # noqa: BLE001
            out[form] = f"{type(e).__name__}: {str(e)[:200]}"
    return out


def append_artifacts(artifacts: DataFrame, path: str) -> None:
    """Appends artifact rows (kind, run_id, id, payload, created_at), a folder per kind."""
    artifacts.write.mode("append").partitionBy("kind").parquet(path)


def read_artifacts(spark: SparkSession, path: str, kind: str | None = None, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest artifacts of a kind and run; a kind prunes folders."""
    df = spark.read.parquet(path)
    df = df.where(F.col("kind") == kind) if kind else df
    df = df.where(F.col("run_id") == run_id) if run_id else df
    return df.orderBy(F.desc("created_at"), "id").limit(limit) if limit else df


def tiered(df: DataFrame, payload: str, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Hot rows, large payloads replaced by their hash, and the cold payloads by hash."""
    large = F.octet_length(payload) > most
    key = F.sha2(payload, 256)
    hot = df.withColumns({payload: F.when(large, F.concat(F.lit("blob:"), key)).otherwise(F.col(payload))})
    return hot, df.where(large).select(key.alias("blob"), payload).dropDuplicates(["blob"])


def passed_only(df: DataFrame, confidence: Column, value: Column, least_confidence: float = 0.999, least_value: float = 1000.0) -> DataFrame:
    """What a gate lets through to be stored."""
    return df.where((confidence >= least_confidence) & (value >= least_value))


def unexpired(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL '{days}' DAY"))


def rejected(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of the rules that they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    told = df.withColumn("broken", broken)
    return told.where(F.size("broken") == 0).drop("broken"), told.where(F.size("broken") > 0)


def ordered_json(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group one JSON array of its rows, in the order of the columns."""
    return df.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("rows"))
