"""Operational reports and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.functions import text
from runtally.schema import DEFAULT_PART, STEP_FAMILIES


def partition_inventory(events: DataFrame, partitions: DataFrame) -> DataFrame:
    """Rows of every partition, empty ones included; ``partitions`` names them all (part)."""
    held = events.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    rows = partitions.join(held, "part", "left").select("part", F.coalesce("rows", F.lit(0)).alias("rows"))
    return rows.orderBy(F.desc("part"))


def default_backlog(events: DataFrame) -> DataFrame:
    """Rows in the default partition; more than a few mean maintenance is not running."""
    return events.where(F.col("part") == DEFAULT_PART).agg(F.count(F.lit(1)).alias("rows"))


def forget_status(forgets: DataFrame) -> DataFrame:
    return forgets.select(
        "install_id", "requested_at", "processed_at",
        F.when(F.col("processed_at").isNull(), "pending").otherwise("processed").alias("state"),
    )


def events_by_install(events: DataFrame, install_id: str | None = None) -> DataFrame:
    """Row count per install, or the rows of one install."""
    if install_id is not None:
        return events.where(F.col("install_id") == install_id.lower())
    return events.groupBy("install_id").agg(F.count(F.lit(1)).alias("rows"))


def ingest_rate_hourly(results: DataFrame) -> DataFrame:
    """Batches taken in per hour, repeated ones included; refused ones do not count."""
    return (
        results.where(F.col("outcome") != "rejected")
        .groupBy(F.date_trunc("hour", "received_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("batches"), F.sum("new_rows").alias("new_rows"))
    )


def error_rate_hourly(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.where(F.col("status") == "rejected")
        .groupBy(F.date_trunc("hour", "received_at").alias("hour"), "http_code", "reason")
        .agg(F.count(F.lit(1)).alias("batches"))
    )


def maintenance_status(runs: DataFrame) -> DataFrame:
    """Latest outcome of every maintenance step."""
    last = F.max_by(F.struct("ok", "rows", "error"), "as_of")
    return (
        runs.groupBy("step")
        .agg(F.max("as_of").alias("as_of"), last.alias("last"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("failures"))
        .select("step", "as_of", "last.*", "failures")
    )


def audit_batch_key(batches: DataFrame) -> DataFrame:
    """Batches whose key is not the hash of their lines. A report: ingest trusts the key."""
    recomputed = text.batch_key(text.split_lines(F.col("body")))
    return batches.select(
        "idempotency_key", "received_at", (F.col("idempotency_key") == recomputed).alias("key_matches")
    )


def audit_taxonomy(events: DataFrame) -> DataFrame:
    """Step families outside the closed list, with the runs and steps that used them."""
    return (
        events.select(F.explode("step_families").alias("family", "_n"))
        .where(~F.col("family").isin(STEP_FAMILIES))
        .groupBy("family")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("_n").alias("n"))
    )
