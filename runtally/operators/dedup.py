"""First-wins deduplication by batch key and by natural event key.

The rows that matter are the few keys in conflict: held twice in the run, or already
stored. They are found on the key columns alone, with map-side pre-aggregation, so a
key held by a third of all rows stays cheap; the payload is then filtered against the
conflicts and is not shuffled while those are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runtally.schema import DEFAULT_PART, EVENT_KEY

BATCH_ORDER = ["received_at", "body_hash", "batch_uid"]
EVENT_ORDER = ["received_at", "idempotency_key", "line_no"]


def conflicts(candidates: DataFrame, keys: list[str], order: list[str], stored: DataFrame) -> DataFrame:
    """Keys seen more than once or already stored, with the order of the row that wins.

    ``winner`` is null when a stored row has the key: no candidate wins then.
    """
    best = candidates.groupBy(*keys).agg(
        F.min(F.struct(*order)).alias("winner"), F.count(F.lit(1)).alias("copies")
    )
    known = (
        stored.select(*keys)
        .join(best.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.lit(True).alias("known"))
    )
    return (
        best.join(known, keys, "left")
        .where((F.col("copies") > 1) | F.col("known"))
        .select(*keys, F.when(F.col("known").isNull(), F.col("winner")).alias("winner"))
    )


def keep_first(rows: DataFrame, found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key has no conflict, and the winner of each key that has one."""
    marked = rows.join(found.withColumn("_conflict", F.lit(True)), keys, "left")
    wins = F.coalesce(F.col("winner") == F.struct(*order), F.lit(False))
    return marked.where(F.col("_conflict").isNull() | wins).select(*[rows[c] for c in rows.columns])


def dedup_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """First arrival of every batch key that the ledger does not hold yet."""
    keys = ["idempotency_key"]
    return keep_first(batches, conflicts(batches, keys, BATCH_ORDER, ledger), keys, BATCH_ORDER)


def dedup_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """First line of every natural key that the event table does not hold yet."""
    return keep_first(events, conflicts(events, EVENT_KEY, EVENT_ORDER, stored), EVENT_KEY, EVENT_ORDER)


def route_partition(events: DataFrame, registered: DataFrame, shards: int) -> DataFrame:
    """Add ``part`` (the event's UTC day if registered, else the default) and ``shard``.

    ``registered`` holds one row per calendar day.
    """
    day = F.to_date("event_timestamp")
    days = registered.select(F.col("day").alias("_day"), F.lit(True).alias("_registered"))
    return (
        events.withColumn("_day", day)
        .join(days, "_day", "left")
        .withColumn(
            "part",
            F.when(F.col("_registered"), F.date_format("_day", "yyyyMMdd")).otherwise(DEFAULT_PART),
        )
        .withColumn("shard", install_shard(shards))
        .drop("_day", "_registered")
    )


def install_shard(shards: int, install: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.col("install_id") if install is None else install), F.lit(shards)).cast("int")
