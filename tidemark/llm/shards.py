"""Sharding by fixed virtual slots.

Records are hashed by id and text into a fixed, large number of virtual slots. One aggregation gives each slot's bytes and rows;
a versioned map names each slot's shard. The first version deals the slots out evenly; rebalancing edits it: slots move from shards
with more bytes to shards with fewer, and only those. The map and the slot sums have one row per virtual slot, a number fixed by
parameter, so the driver may hold them and tasks get them by broadcast, whatever the number of records.

Rows equal in id and text (those without an id, say) would all fall into one slot. The sums show such a slot, and the rows of slots
with more than CROWDED times the mean are dealt over all slots by their place in a stored table.

Nulls: a null text has size 1, a null id counts as an id. Repeated rows each keep a place of their own. Rows of equal
id and text are interchangeable. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .util import keep, new_path

SLOTS = 8192
#: A slot with more than so many times the mean of rows is crowded; so at most one in so many is.
CROWDED = 4
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, virtual_slot, size (UTF-8 bytes of the text plus 1) and text_crc32 (0 for a null text, as for an empty one), stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("text")), F.lit(slots)).cast("int").alias("virtual_slot"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = keep(rows, "slotted")
    sums = slot_sums(rows)
    mean = sum(n for _, n in sums.values()) / slots
    crowded = [slot for slot, (_, n) in sums.items() if n > CROWDED * mean + CROWDED]
    if not crowded:
        return rows.drop("__row")
    again = F.pmod(F.xxhash64("__row"), F.lit(slots)).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(crowded), again).otherwise(F.col("virtual_slot"))).drop("__row")


def slot_sums(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each used virtual slot: one row per slot comes to the driver."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return {r["virtual_slot"]: (r["size"], r["n"]) for r in sums.collect()}


def dealt_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The first map: the slots in turn."""
    return [slot % shards for slot in range(slots)]


def levelled(old: list[int], sums: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """old edited until no move of a slot from the shard with the most bytes to that with the fewest brings them nearer."""
    new, load = list(old), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        weight = sums.get(slot, (0, 0))[0]
        load[shard] += weight
        if weight:
            insort(held[shard], (weight, slot))
    while shards > 1:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        at = bisect_left(held[high], (gap / 2, -1))
        fitting = [x for x in held[high][max(0, at - 1) : at + 1] if x[0] < gap]
        if not fitting:
            return new
        weight, slot = min(fitting, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[high].remove((weight, slot))
        insort(held[low], (weight, slot))
        new[slot], load[high], load[low] = low, load[high] - weight, load[low] + weight
    return new


def rebalanced(old: list[int], sums: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The map for `shards` shards by the fewest edits: from shards above the new mean, their lightest fitting slots go to the
    shard with the fewest bytes. Every other slot stays, so growth by a shard moves rows only into the new one."""
    weight = lambda s: sums.get(s, (0, 0))[0]
    new, load = list(old), [0] * shards
    for slot, shard in enumerate(old):
        load[shard] += weight(slot)
    mean = sum(load) / shards
    fresh = [s for s in range(shards) if s > max(old, default=-1)] or list(range(shards))
    for slot in sorted(range(len(old)), key=lambda s: (-weight(s), s)):
        to = min(fresh, key=lambda s: (load[s], s))
        home = new[slot]
        if home not in fresh and weight(slot) and load[home] - weight(slot) >= mean and load[to] + weight(slot) <= mean:
            new[slot], load[home], load[to] = to, load[home] - weight(slot), load[to] + weight(slot)
    return new


def store_map(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    """Appends a version of the map. Earlier versions stay, so a reader pins the one it began with."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shards)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """One version of the map, the latest if none is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    rows = (table.where(F.col("version") == version) if version is not None else table).collect()
    last = max(r["version"] for r in rows)
    return [s for _, s in sorted((r["virtual_slot"], r["shard"]) for r in rows if r["version"] == last)]


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law `bytes`, shard, slot (the row's place in its shard, gapless from 0), grown_shard (null),
    virtual_slot. Places in a shard run through its virtual slots in turn, so no task ever sorts a whole shard."""
    spark = docs.sparkSession
    rows = slotted(docs, slots)
    sums = slot_sums(rows)
    path = path or new_path(spark, "slot-map")
    store_map(spark, path, 1, dealt_map(shards, slots))
    store_map(spark, path, 2, levelled(load_map(spark, path, 1), sums, shards))
    current = load_map(spark, path)
    filled, starts = [0] * shards, []
    for slot, shard in enumerate(current):
        starts.append((slot, shard, filled[shard]))
        filled[shard] += sums.get(slot, (0, 0))[1]
    places = spark.createDataFrame(starts, T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("__start", T.LongType())]))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__n", F.row_number().over(order).cast("long") - 1)
    return numbered.join(F.broadcast(places), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__start") + F.col("__n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
