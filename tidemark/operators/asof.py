"""Point-in-time features: every variable's value for every entity of a cohort, as known at a cutoff.

All variables are resolved in one pass: one scan of the events up to the cutoff, one aggregation per entity with a conditional
aggregate per variable (combined map-side), one left join from the cohort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("latest_value_as_of", "count_over_window", "sum_over_window", "exists_as_of")


@dataclass(frozen=True)
class Contract:
    """How a variable is read. A window of no days holds the cutoff's instant alone; both its ends belong to it."""

    variable: str
    mode: str
    field: str
    window_days: int | None = None
    default: float = 0.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown as-of mode {self.mode!r}")


def _aggregate(c: Contract, cutoff: Column) -> list[Column]:
    mine = F.col("field") == F.lit(c.field)
    inside = mine & (F.col("observed_at") >= cutoff - F.expr(f"INTERVAL '{c.window_days or 0}' DAY"))
    if c.mode == "latest_value_as_of":  # a present null wins, then takes the default; ties go to the larger tie
        value = F.max_by(F.struct(F.col("value")), F.when(mine, F.struct("observed_at", "tie")))["value"]
    elif c.mode == "count_over_window":
        value = F.count_if(inside).cast("double")
    elif c.mode == "sum_over_window":
        value = F.sum(F.when(inside, F.col("value")))
    else:
        value = F.max(F.when(mine, F.lit(1.0)))
    return [value.alias(c.variable), F.max(F.when(mine if c.window_days is None and "window" not in c.mode else inside, F.col("observed_at"))).alias(f"{c.variable}__seen")]


def matrix(events: DataFrame, cohort: DataFrame, contracts: Sequence[Contract], cutoff: datetime, audit: bool = False) -> DataFrame:
    """entity_id and a column per contract. events(entity_id, observed_at, field, value double, tie); cohort(entity_id), each once.

    audit adds <variable>__seen, the latest observation that counted (null: the default was imputed).
    """
    at = F.lit(cutoff)
    known = events.where((F.col("observed_at") <= at) & F.col("field").isin(sorted({c.field for c in contracts})))
    resolved = known.groupBy("entity_id").agg(*[a for c in contracts for a in _aggregate(c, at)])
    out = cohort.join(resolved, "entity_id", "left")
    return out.select("entity_id", *[F.coalesce(F.col(c.variable), F.lit(c.default)).alias(c.variable) for c in contracts], *([F.col(f"{c.variable}__seen") for c in contracts] if audit else []))


def payload_events(raw: DataFrame, fields: Sequence[str], payload: str = "payload") -> DataFrame:
    """Long rows (entity_id, observed_at, field, value, tie) from JSON payloads: a key that is present counts, also with null;
    numbers as such, true and false as 1 and 0. raw(entity_id, observed_at, <payload>, tie)."""
    keys = F.json_object_keys(payload)
    text = lambda f: F.get_json_object(payload, f"$['{f}']")
    number = lambda f: F.coalesce(text(f).try_cast("double"), F.when(text(f) == "true", 1.0).when(text(f) == "false", 0.0))
    each = F.array(*[F.when(F.array_contains(keys, f), F.struct(F.lit(f).alias("field"), number(f).alias("value"))) for f in fields])
    return raw.select("entity_id", "observed_at", "tie", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("entity_id", "observed_at", "x.field", "x.value", "tie")


def snapshot_cutoff(snapshot_at: datetime, lag_seconds: int) -> datetime:
    """The snapshot less its lag, in whole seconds."""
    return datetime.fromtimestamp(int(snapshot_at.timestamp()) - lag_seconds, snapshot_at.tzinfo)
