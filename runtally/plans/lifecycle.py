"""Table maintenance: partitions, retention, erasure, ledger purge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.operators.dedup import install_shard
from runtally.operators.forget import pending_forgets
from runtally.plans import stored_rollups
from runtally.plans.store import Store
from runtally.plans.stored_rollups import next_version
from runtally.schema import DEFAULT_PART
from runtally.session import staging, utc


def bootstrap(store: Store, as_of: datetime, location: str | None = None) -> Store:
    """Create what is missing: tables, views and the initial range of day partitions."""
    store.create_tables(location)
    today = utc(as_of).date()
    ensure_partitions(store, today - timedelta(days=90), today + timedelta(days=7))
    store.create_views()
    store.register_views()  # the short names, in this session
    return store


def ensure_partition(store: Store, day: date) -> DataFrame:
    return ensure_partitions(store, day, day + timedelta(days=1))


def ensure_partitions(store: Store, first: date, end: date) -> DataFrame:
    """Register the days of ``[first, end)`` and report (day, state) for each.

    A day the default partition already holds rows of cannot be registered any more:
    it is a ``conflict``, and its rows stay where they are.
    """
    if end <= first:
        return store.spark.createDataFrame([], "day date, state string")
    days = store.spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(end - timedelta(days=1)))).alias("day")
    )
    in_default = (
        store.partition(DEFAULT_PART)
        .select(F.to_date("event_timestamp").alias("day"))
        .where(F.col("day").between(F.lit(first), F.lit(end)))
        .groupBy("day")
        .agg(F.lit(True).alias("_held"))
    )
    registered = store.registered_days().withColumn("_registered", F.lit(True))
    report = (
        days.join(registered, "day", "left")
        .join(in_default, "day", "left")
        .select(
            "day",
            F.when(F.col("_registered"), "exists").when(F.col("_held"), "conflict").otherwise("created").alias("state"),
        )
        .orderBy("day")
    )
    # Fixed before the registry changes; one row per calendar day.
    report = store.spark.createDataFrame([tuple(row) for row in report.collect()], "day date, state string")
    _register(store, [row["day"] for row in report.where(F.col("state") == "created").collect()], True)
    return report


def _register(store: Store, days: list[date], active: bool) -> None:
    if days:
        version = next_version(store, "partition_log")
        rows = store.spark.createDataFrame([(day, active, version) for day in days], "day date, active boolean, version bigint")
        store.append("partition_log", rows.coalesce(1))


def expired_days(store: Store, as_of: datetime, retention_days: int) -> DataFrame:
    """Registered days that end on or before the retention cutoff."""
    cutoff = utc(as_of).date() - timedelta(days=retention_days)
    return store.registered_days().where(F.date_add("day", 1) <= F.lit(cutoff))


def drop_old_partitions(store: Store, as_of: datetime, retention_days: int | None = None) -> int:
    """Drop expired day partitions whole; the default partition is never dropped."""
    keep = store.options.retention_days if retention_days is None else retention_days
    # Calendar days.
    expired = [row["day"] for row in expired_days(store, as_of, keep).collect()]
    names = {f"{day:%Y%m%d}" for day in expired}
    stored_rollups.mark_due(store, expired, only_kept=True)
    store.drop_partitions(
        "telemetry_event", [leaf for leaf in store.leaves("telemetry_event") if leaf["part"] in names]
    )
    _register(store, expired, False)
    stored_rollups.refresh_due(store)
    return len(expired)


def sweep_default(store: Store, as_of: datetime, retention_days: int | None = None) -> int:
    """Delete rows of the default partition older than the window, to the instant."""
    keep = store.options.retention_days if retention_days is None else retention_days
    old = F.col("event_timestamp") < F.lit(utc(as_of) - timedelta(days=keep))
    return _delete_events(store, lambda df: df.withColumn("_doomed", old), {"part": [DEFAULT_PART]})


def _delete_events(store: Store, doomed, within: dict) -> int:
    """Delete events, and refresh the stored rollups of the days they were of."""
    if stored_rollups.kept_days(store):
        stored_rollups.mark_due(store, store.doomed_days(doomed, within), only_kept=True)
    deleted = store.delete_rows("telemetry_event", doomed, within)
    stored_rollups.refresh_due(store)
    return deleted


def purge_ledger(store: Store, as_of: datetime, retention_days: int | None = None) -> int:
    """Delete ledger rows older than the dedup window; only its edge day is rewritten."""
    keep = store.options.dedup_retention_days if retention_days is None else retention_days
    cutoff = utc(as_of) - timedelta(days=keep)
    # Calendar days of arrival.
    days = [leaf["received_day"] for leaf in store.leaves("ingest_batch") if leaf["received_day"] <= f"{cutoff:%Y%m%d}"]
    return store.delete_rows(
        "ingest_batch",
        lambda df: df.withColumn("_doomed", F.col("received_at") < F.lit(cutoff)),
        {"received_day": days},
    )


def forget_drain(store: Store, as_of: datetime, limit: int | None = None) -> int:
    """Erase every pending install from events and ledger; returns installs processed.

    Only tombstones are written, one row per install: from then on no read and no view shows
    the rows that were stored before, and ``remove_erased`` takes them out of the files. Rows
    that arrive later belong to the next generation and stay. Requests are marked last, so a
    run that dies is simply repeated. ``limit`` bounds a round to the oldest requests.
    """
    with staging(store.spark, "forget") as keep:
        pending = keep(pending_forgets(store.forgets(), limit), "pending")
        processed = pending.count()
        if processed == 0:
            return 0
        right: list[date] = []
        if kept := stored_rollups.kept_days(store):
            within = _shards_of(store, pending)
            right = stored_rollups.begin(store, kept.intersection(store.doomed_days(_hit_by(pending), within)))
            stored_rollups.add(store, store.doomed(_hit_by(pending), within), right, sign=-1)
        generation = store.generation
        store.append("erasure", pending.select("install_id", F.lit(utc(as_of)).alias("erased_at"), F.lit(generation).alias("upto")))
        store.begin_generation(generation + 1)
        stored_rollups.refresh_due(store, right)
        store.append("forget_log", pending.withColumn("processed_at", F.lit(utc(as_of))))
        return processed


def _hit_by(installs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Flags the rows of some installs; with a column ``upto``, those of generations up to it."""
    hits = installs.select("install_id", (F.col("upto") if "upto" in installs.columns else F.lit(None).cast("bigint")).alias("_upto"), F.lit(True).alias("_hit"))

    def flag(rows: DataFrame) -> DataFrame:
        covered = F.col("_upto").isNull() | (F.coalesce("generation", F.lit(-1)) <= F.col("_upto"))
        found = rows.join(hits, "install_id", "left")
        return found.withColumn("_doomed", F.col("_hit").isNotNull() & covered).drop("_hit", "_upto")

    return flag


def _shards_of(store: Store, installs: DataFrame) -> dict[str, list[int]]:
    """The shards that some installs fall in: at most the shard count."""
    shard = install_shard(store.install_shards).alias("shard")
    return {"shard": [row["shard"] for row in installs.select(shard).distinct().collect()]}


def remove_erased(store: Store) -> int:
    """Take erased rows out of the files; returns the events and ledger rows removed.

    Rewrites the leaves that hold such rows and only then drops the tombstones, so a run that
    dies leaves rows hidden, never shown.
    """
    done = store.leaves("erasure")
    if not done:
        return 0
    with staging(store.spark, "erased") as keep:
        upto = F.max("upto").alias("upto")
        installs = keep(store.table("erasure").groupBy("install_id").agg(upto), "installs")
        flag = _hit_by(installs)
        removed = store.delete_rows("telemetry_event", flag, _shards_of(store, installs))
        removed += store.delete_rows("ingest_batch", flag)
    store.drop_partitions("erasure", done)
    return removed


#: A leaf is gathered when its files are smaller than this share of the advised size.
SMALL_FILE = 1 / 8


def advised_bytes(store: Store) -> int:
    """The file size that Spark's rebalancing aims at."""
    advised = store.spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    return store.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(advised)


def scattered_leaves(store: Store, first: date, last: date) -> DataFrame:
    """(part, shard, files, bytes) of the leaves of some days whose files are several and, in the mean,
    far below the advised size. A large leaf that was gathered has several large files: it stays."""
    rows = store.table("telemetry_event").where(F.col("part").between(f"{first:%Y%m%d}", f"{last:%Y%m%d}"))
    rows = rows.select("part", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = rows.groupBy("part", "shard", "file").agg(F.max("size").alias("size"))
    leaves = files.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return leaves.where((F.col("files") > 1) & (F.col("bytes") < F.col("files") * F.lit(advised_bytes(store) * SMALL_FILE)))


def compact_days(store: Store, first: date, last: date) -> int:
    """Gather the files of the leaves of closed days; returns the leaves rewritten.

    Every run and micro-batch adds a file to each leaf it touches. A leaf of small files is
    written anew in files of the advised size.
    """
    # One row per day and shard.
    leaves = scattered_leaves(store, first, last).select("part", "shard").collect()
    if leaves:
        leaf = F.concat_ws("/", "part", F.col("shard").cast("string"))
        names = [f"{row['part']}/{row['shard']}" for row in leaves]
        parts = sorted({row["part"] for row in leaves})
        rows = store.table("telemetry_event").where(F.col("part").isin(parts)).where(leaf.isin(names))
        store.replace_partitions("telemetry_event", rows)
    return len(leaves)


def compact(store: Store, as_of: datetime) -> int:
    """Remove erased rows and gather the small files of the closed days in the window; returns
    the rows removed."""
    removed = remove_erased(store)
    today = utc(as_of).date()
    compact_days(store, today - timedelta(days=store.options.retention_days + 1), today - timedelta(days=1))
    stored_rollups.compact(store)
    return removed


def trim_logs(store: Store, as_of: datetime, retention_days: int | None = None) -> int:
    """Drop the days of outcomes, refusals and maintenance runs that are older than the window,
    and what later entries have settled in the rollup log; returns the days dropped."""
    keep = store.options.log_retention_days if retention_days is None else retention_days
    cutoff = f"{utc(as_of) - timedelta(days=keep):%Y%m%d}"
    dropped = 0
    for table, day in [("ingest_result", "received_day"), ("batch_verdict", "received_day"), ("maintenance_run", "run_day")]:
        old = [leaf for leaf in store.leaves(table) if leaf[day] < cutoff]
        store.drop_partitions(table, old)
        dropped += len(old)
    stored_rollups.trim_log(store)
    return dropped


def reshard(store: Store, shards: int) -> Store:
    """Rewrite the event table with another shard count; returns the store opened with it.

    The new table is filled beside the old one and takes its name at the end. Run it again
    after a crash: it starts over, or finishes where the names were being changed.
    """
    spark, event, new, old = store.spark, "telemetry_event", "telemetry_event_resharded", "telemetry_event_replaced"
    opened = Store(spark, store.database, replace(store.options, install_shards=shards))
    if spark.catalog.tableExists(store.name(event)):
        before = Store(spark, store.database, replace(store.options, install_shards=None))
        if before.install_shards != shards:
            spark.sql(f"DROP TABLE IF EXISTS {store.name(new)}")
            before.create_table(new, event, shards)
            rows = before.table(event).withColumn("shard", install_shard(shards))
            opened.append(event, rows, into=new)
            spark.sql(f"DROP TABLE IF EXISTS {store.name(old)}")
            spark.sql(f"ALTER TABLE {store.name(event)} RENAME TO {store.name(old)}")
    if not spark.catalog.tableExists(store.name(event)):
        spark.sql(f"ALTER TABLE {store.name(new)} RENAME TO {store.name(event)}")
    spark.sql(f"DROP TABLE IF EXISTS {store.name(old)}")
    opened.install_shards  # noqa: B018 - the count is now the table's
    return opened


def maintenance_cycle(
    store: Store, as_of: datetime, steps: dict[str, Callable[[], int]] | None = None
) -> DataFrame:
    """Run every step, log its outcome and go on when one fails.

    The order is fixed: later steps rely on earlier ones, but none needs them to
    have succeeded.
    """
    as_of = utc(as_of)
    today = as_of.date()
    ahead = today + timedelta(days=store.options.precreate_days)

    def ensure_ahead() -> int:
        report = ensure_partitions(store, today, ahead)
        stuck = report.where(F.col("state") == "conflict").count()
        if stuck:
            raise RuntimeError(f"{stuck} day(s) already held by the default partition")
        return report.where(F.col("state") == "created").count()

    planned = {
        "ensure_partitions": ensure_ahead,
        "drop_old_partitions": lambda: drop_old_partitions(store, as_of),
        "sweep_default": lambda: sweep_default(store, as_of),
        "forget_drain": lambda: forget_drain(store, as_of),
        "compact": lambda: compact(store, as_of),
        "purge_ledger": lambda: purge_ledger(store, as_of),
        "trim_logs": lambda: trim_logs(store, as_of),
    } | (steps or {})
    log = []
    for step, action in planned.items():
        try:
            log.append((as_of, step, True, action(), None))
        except Exception as fault:  # noqa: BLE001 - a failed step must not stop the others
            log.append((as_of, step, False, None, f"{type(fault).__name__}: {fault}"))
    columns = "as_of timestamp, step string, ok boolean, rows bigint, error string"
    run = store.spark.createDataFrame(log, columns)
    store.append("maintenance_run", run.withColumn("run_day", F.date_format("as_of", "yyyyMMdd")))
    return run
