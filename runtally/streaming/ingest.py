"""Ingest with Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from runtally.plans.ingest import ingest
from runtally.plans.store import Store


def dealt_out(rows: DataFrame) -> DataFrame:
    """The bodies of a micro-batch dealt over all cores.

    A landed file seldom has more than one row group, which is one task of a scan; judging its
    lines costs far more than moving its bodies.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def stream_ingest(
    store: Store,
    batches: DataFrame,
    checkpoint: str,
    as_of: datetime | str | None = None,
    with_rollups: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Load a stream of batches into the store: what is there now, or without end.

    ``every`` is the interval of a continuous run (such as "1 minute"); without it the query
    ends when the available batches are loaded. A micro-batch that is replayed after a
    failure meets its own keys in the ledger and the event table, so it adds nothing twice,
    and refreshes the rollups that were left due. Late events are kept: they go to their own
    day while it is registered, else to the default partition.
    """

    def load(rows: DataFrame, _epoch: int) -> None:
        # A stream has a session of its own; a write is seen at once only within a session.
        local = store.within(rows.sparkSession)
        ingest(local, dealt_out(rows), as_of, with_rollups)
        if local is not store:
            store.refresh()

    writer = batches.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


#: Keeps the state of streamed operators on the executors' disks, so that it may outgrow memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_within_window(batches: DataFrame, days: int = 35) -> DataFrame:
    """Streaming twin of the ledger: a batch key counts once within the window.

    A key is held for at least ``days`` after its first arrival and is let go once the watermark
    (the latest arrival of earlier micro-batches, less ``days``) has passed that time; then it
    counts anew. Arrivals older than the watermark are dropped. State is bounded by the window
    and kept in RocksDB, which is set for the session's streams; the ledger stays the authority.
    """
    batches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return batches.withWatermark("received_at", f"{days} days").dropDuplicatesWithinWatermark(["idempotency_key"])
