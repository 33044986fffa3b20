"""The ingest job: gate -> two layers of dedup -> outcomes, events, ledger, quarantine."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.operators import dedup
from runtally.operators.gate import REJECTED, accepted_events, batch_heads, gate
from runtally.plans import stored_rollups
from runtally.plans.store import Store
from runtally.schema import EVENT_KEY
from runtally.session import staging

RESULT_COLUMNS = [
    "idempotency_key", "received_at", "http_code", "outcome", "reason", "bad_line", "total_events", "new_rows",
]


@dataclass
class IngestRun:
    """What one run did: the outcomes it recorded, and the days its accepted events are of."""

    results: DataFrame
    days: list[date]


def received_day(column: str = "received_at"):
    return F.date_format(column, "yyyyMMdd")


def _stored_beside(store: Store, routed: DataFrame) -> DataFrame:
    """Stored events in the storage partitions that some new events belong to."""
    stored = store.visible("telemetry_event")
    if not store.leaves("telemetry_event"):
        return stored.where("false")
    # At most one row per registered day and shard.
    touched = routed.select("part", "shard").distinct().collect()
    leaf = F.concat_ws("/", "part", F.col("shard").cast("string"))
    return stored.where(leaf.isin([f"{row['part']}/{row['shard']}" for row in touched]))


def _record(store: Store, run_id: str, results: DataFrame) -> None:
    """Append outcomes; an arrival that is recorded already, by a run that died, is marked."""
    results = results.withColumn("run_id", F.lit(run_id)).withColumn("received_day", received_day())
    # Calendar days of arrival.
    days = [row[0] for row in results.select("received_day").distinct().collect()]
    known = store.table("ingest_result").where(F.col("received_day").isin(days))
    known = known.where(~F.col("replayed")).select(
        F.col("received_at").alias("_at"),
        F.col("idempotency_key").alias("_key"),
        F.col("body_hash").alias("_hash"),
        F.lit(True).alias("_known"),
    ).distinct()
    same = (
        (F.col("received_at") == F.col("_at"))
        & F.col("idempotency_key").eqNullSafe(F.col("_key"))
        & F.col("body_hash").eqNullSafe(F.col("_hash"))
    )
    marked = results.join(known, same, "left").withColumn("replayed", F.coalesce("_known", F.lit(False)))
    store.append("ingest_result", marked)


def ingest(
    store: Store, batches: DataFrame, as_of: datetime | str | None = None, with_rollups: bool = False
) -> IngestRun:
    """Store the new events of raw batches; running it again adds nothing.

    The bodies are parsed once, into a flat columnar staging table; all later steps read only
    the columns they need from it, and it is deleted at the end, also after a failure. The
    outcome of each batch is recorded first, then events, then the ledger: a run that dies in
    between is healed by the natural-key layer on the next try. ``with_rollups`` keeps the
    stored rollups of the days that the batches carry events of.
    """
    run_id = uuid.uuid4().hex
    stamped = batches.withColumn("batch_uid", F.monotonically_increasing_id()).withColumn(
        "body_hash", F.xxhash64("body")
    )
    with staging(store.spark, "ingest") as keep:
        staged = keep(gate(stamped, store.options, as_of).drop("content_type"), "staged")
        heads = batch_heads(staged)

        # Layer 1: a batch key counts once, over the run and the ledger.
        good_heads = heads.where(F.col("status") != REJECTED)
        repeated = keep(
            dedup.conflicts(good_heads, ["idempotency_key"], dedup.BATCH_ORDER, store.ledger()),
            "batch-conflicts",
        )
        kept_heads = dedup.keep_first(good_heads, repeated, ["idempotency_key"], dedup.BATCH_ORDER)
        accepted = accepted_events(staged)
        kept = dedup.keep_first(accepted, repeated, ["idempotency_key"], dedup.BATCH_ORDER)

        # Layer 2: a natural key counts once, over the run and the partitions it touches.
        routed = dedup.route_partition(kept, store.registered_days(), store.install_shards)
        clashes = keep(
            dedup.conflicts(routed, EVENT_KEY, dedup.EVENT_ORDER, _stored_beside(store, routed)), "event-conflicts"
        )
        new_events = dedup.keep_first(routed, clashes, EVENT_KEY, dedup.EVENT_ORDER)

        added = new_events.groupBy("batch_uid").agg(F.count(F.lit(1)).alias("new_rows"))
        winners = kept_heads.select("batch_uid", F.lit(True).alias("_stored"))
        results = (
            heads.join(winners, "batch_uid", "left")
            .join(added, "batch_uid", "left")
            .select(
                "idempotency_key",
                "body_hash",
                "received_at",
                "http_code",
                F.when(F.col("status") == REJECTED, REJECTED)
                .when(F.col("_stored"), "accepted")
                .otherwise("duplicate")
                .alias("outcome"),
                "reason",
                F.when(F.col("status") == REJECTED, F.col("line_no")).alias("bad_line"),
                F.when(F.col("status") != REJECTED, F.col("line_count")).alias("total_events"),
                F.coalesce("new_rows", F.lit(0)).alias("new_rows"),
            )
        )
        _record(store, run_id, keep(results, "results"))
        # What the run carries, repeated or not: a replay refreshes what a crash left out.
        days: list[date] = []
        right: list[date] = []
        if with_rollups or stored_rollups.stored_days(store):
            days = sorted(row[0] for row in accepted.select(F.to_date("event_timestamp")).distinct().collect())
        if with_rollups:
            right = stored_rollups.begin(store, days)
        else:  # left for the next job that refreshes
            stored_rollups.mark_due(store, days, only_kept=True)
        generation = F.lit(store.generation)
        store.append("telemetry_event", new_events.withColumn("generation", generation))
        stored_rollups.add(store, new_events, right)
        stored_heads = kept_heads.withColumn("received_day", received_day())
        store.append("ingest_batch", stored_heads.withColumn("generation", generation))
        store.append(
            "batch_verdict",
            heads.where(F.col("status") == REJECTED).withColumn("received_day", received_day()),
        )
    if with_rollups:
        stored_rollups.refresh_due(store, right)
    recorded = store.table("ingest_result").where(F.col("run_id") == run_id)
    return IngestRun(recorded.select(*RESULT_COLUMNS), days)
