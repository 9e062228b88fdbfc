"""Structured Streaming forms: bucketed event aggregates, first-seen duplicates, sessions, releases and drift checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from tidemark.operators import relations
from tidemark.session import scratch, stored

#: A week's window begins on Monday.
OFFSETS = {"hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("1 week", "4 days")}


def events(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def bucketed(stream: DataFrame, grain: str, late: str = "10 minutes", ts: str = "ts", value: str = "value", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count, sum, mean, least and most per window; buckets close as the watermark passes."""
    length, offset = OFFSETS[grain]
    window = F.window(ts, length, startTime=offset)
    out = stream.withWatermark(ts, late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("bucket"), *by, "n", "total", "mean", "low", "high")


def velocity(stream: DataFrame, minutes: int, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events per minute in sliding windows of so many minutes, a step each minute."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes", "1 minute")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.end").alias("at"), (F.col("n") / minutes).alias("per_minute"))


def first_seen(stream: DataFrame, keys: list[str], within: str, ts: str = "ts") -> DataFrame:
    """Each key once within a span of time; state is dropped after it."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Sessions that end after a gap without events."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sequenced(stream: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows numbered from 1 within their key, gapless over micro-batches. stream(key, ts, event_id)."""

    def number(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        yield pd.DataFrame({key: [k[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "seq": range(last + 1, last + 1 + len(rows))})
        state.update((last + len(rows),))

    return stream.groupBy(key).applyInPandasWithState(number, f"{key} string, event_id bigint, seq bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


class Release(StatefulProcessor):
    """Lets items through once what they wait for has come.

    State is kept by id, in maps: the ids that came, how many items wait for an id, and the n-th of them. So a batch reads and writes what
    its items name and release, however many ids a scope has. With `stale` (minutes), a scope without rows for so long is forgotten by a
    timer that each batch puts off; what still waits there never comes.
    """

    def __init__(self, stale: int | None):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", "id string", "here boolean")
        self.count = handle.getMapState("count", "need string", "n int")
        self.waiting = handle.getMapState("waiting", "need string, n int", "id string")
        self.timer = handle.getValueState("timer", "at bigint")

    def _pushed_off(self, timers: TimerValues) -> None:
        now = timers.getCurrentWatermarkInMs()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(now + self.stale * 60_000)
        self.timer.update((now + self.stale * 60_000,))

    def _freed(self, item: str) -> Iterator[str]:
        """The item and what waited for it, and so on; each once."""
        free = [item]
        while free:
            i = free.pop()
            self.done.updateValue((i,), (True,))
            yield i
            if self.count.containsKey((i,)):
                n = self.count.getValue((i,))[0]
                for k in range(n):
                    free.append(self.waiting.getValue((i, k))[0])
                    self.waiting.removeKey((i, k))
                self.count.removeKey((i,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.stale is not None:
            self._pushed_off(timerValues)
        for part in rows:
            out = []
            for item, need in zip(part["id"], part["waits_for"], strict=True):
                if need is None or need != need or self.done.containsKey((need,)):
                    out += self._freed(item)
                else:
                    n = self.count.getValue((need,))[0] if self.count.containsKey((need,)) else 0
                    self.waiting.updateValue((need, n), (item,))
                    self.count.updateValue((need,), (n + 1,))
            yield pd.DataFrame({"scope": [key[0]] * len(out), "id": out}, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.done, self.count, self.waiting, self.timer):
            state.clear()
        yield pd.DataFrame({"scope": [], "id": []}, dtype=object)

    def close(self) -> None:
        pass


def released(stream: DataFrame, stale: int | None = None) -> DataFrame:
    """Items let through once what they wait for has come. stream(scope, id, waits_for): an item without waits_for comes at once and
    releases those that wait for its id within the scope, at any later or earlier time; chains are released in one go. stale: scopes
    without rows for so many minutes of event time are forgotten; the stream then has a watermark. Needs the state store of
    stateful()."""
    mode = "None" if stale is None else "EventTime"
    return stream.groupBy("scope").transformWithStateInPandas(Release(stale), "scope string, id string", "append", mode)


def _of(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """rows whose column is (left_semi) or isn't (left_anti) one of the ids(scope, id). Nulls match none."""
    named = ids.select(F.col("scope").alias("__scope"), F.col("id").alias("__id"))
    return rows.join(named, (F.col("scope") == F.col("__scope")) & (F.col(column) == F.col("__id")), how)


def let_through(items: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of items(scope, id, waits_for): the ids (scope, id) that come through, each once, and the items that still wait. done(scope, id): what
    came before; it doesn't come again.

    A round lets through what looks at an id of the round before; each item that is left then looks at what its need looks at, so that a
    chain of n items takes about log2(n) rounds. Nothing left looks at an id of an earlier round, so a round that lets nothing through is the
    last, also if items wait for each other in circles. An item is one row in all rounds: an id that comes with several needs isn't
    looked through.
    """
    items = stored(items.select("scope", "id", "waits_for").distinct())
    done = done.select("scope", "id")
    asked = _of(items.where("waits_for IS NOT NULL"), done, "waits_for", "left_semi")
    first = items.where("waits_for IS NULL").union(asked).select("scope", "id").distinct()
    known = done.select(F.col("scope").alias("__scope"), F.col("id").alias("__id"))
    new = stored(first.join(known, F.col("scope").eqNullSafe(F.col("__scope")) & F.col("id").eqNullSafe(F.col("__id")), "left_anti"))
    left = _of(_of(items.where("waits_for IS NOT NULL"), done, "id", "left_anti"), new, "id", "left_anti")
    left = stored(left.withColumn("at", F.col("waits_for")))
    through = [new]
    while not new.isEmpty() and not left.isEmpty():
        new = stored(_of(left, new, "at", "left_semi").select("scope", "id").distinct())
        through.append(new)
        left = stored(_of(left, new, "id", "left_anti"))
        single = left.groupBy("scope", "id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("next")).where("n = 1")
        single = single.select(F.col("scope").alias("__scope"), F.col("id").alias("__id"), "next")
        met = left.join(single, (F.col("scope") == F.col("__scope")) & (F.col("at") == F.col("__id")), "left")
        left = stored(met.select("scope", "id", "waits_for", F.coalesce("next", "at").alias("at")))
    return reduce(DataFrame.union, through), left.select("scope", "id", "waits_for")


def released_whole(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """As completed(released(stream)), by joins of each batch with what came through and what waits: no scope is in one task, and no item
    asks a state store. For few large batches, as each reads the ids that came before; released() is for many small ones, and forgets.
    Both are kept in the shared folder by batch, so that a batch that runs again reads and writes the same. An id comes through once.
    """
    path = scratch(spark, name)
    rows, waits, before = f"{path}/rows", f"{path}/waiting", "scope string, id string, batch bigint"
    spark.createDataFrame([], "scope string, id string").write.parquet(f"{rows}/batch=-1")
    spark.createDataFrame([], "scope string, id string, waits_for string").write.parquet(f"{waits}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        done = own.read.schema(before).parquet(rows).where(F.col("batch") < number)
        waited = own.read.schema(f"waits_for string, {before}").parquet(waits).where(F.col("batch") == number - 1)
        through, left = let_through(batch.select("scope", "id", "waits_for").unionByName(waited.drop("batch")), done)
        through.write.mode("overwrite").parquet(f"{rows}/batch={number}")
        left.write.mode("overwrite").parquet(f"{waits}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(before).parquet(rows).select("scope", "id")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in the store that maps and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drift_guard(baseline: DataFrame, columns: list[str], accept: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: batches whose drift from the baseline's fingerprint is high go to quarantine. Columns that a batch lacks count
    as removed."""

    def check(batch: DataFrame, number: int) -> None:
        batch.persist()
        changes = relations.drift(baseline, relations.fingerprint(batch, [c for c in columns if c in batch.columns]))
        (quarantine if relations.drift_summary(changes).first()["quarantined"] else accept)(batch, number)
        batch.unpersist()

    return check


def completed(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the result, written as Parquet to the shared folder with its checkpoint: appended
    batch by batch, or in complete mode the last batch's whole table."""
    path = scratch(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{path}/rows")
    else:
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows")
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows")).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
