"""The session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps day and hour boundaries the same everywhere; AQE re-plans partitions and skewed joins from what ran.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "tidemark", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings that can change at run time to a session made elsewhere."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder that the cluster names; None where it names none and a temp folder will do, as all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/") if folder else None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark) or 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within gives its shuffle files back as it ends, and not only once the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Written:
    """df as Parquet in the shared folder, a fraction of a checkpoint's size; dropped() deletes it, once nothing will read `rows` again."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        with freed_shuffles(self.spark):
            df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def dropped(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder (a temp folder only where none is set), so that later steps read the same rows however
    often they run and whatever executors are lost. The shuffles behind them are freed, as nothing reads them again."""
    spark = df.sparkSession
    if checkpoint_folder(spark) is None and spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    with freed_shuffles(spark):
        return df.select("*").checkpoint()  # a plan of its own, made under this setting
