"""The ingest quality gate: all-or-nothing verdict per batch.

The whole check of a batch happens inside its own row (an array of at most
``max_batch_lines`` lines), so neither the verdict nor the split into events needs
a shuffle, and a rejected batch never leaves its task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runtally.config import Options
from runtally.functions import text
from runtally.functions.wire import checked_lines
from runtally.schema import FLAT_EVENT, INGEST_MEDIA_TYPE
from runtally.session import utc

ACCEPTED, REJECTED = "accepted", "rejected"

_EVENT_STRUCT = FLAT_EVENT.replace(" ", ":").replace(",:", ",")

# The status code of every batch-level fault; line faults are all 400.
HTTP_CODES = {"unsupported_media_type": 415, "body_too_large": 413, "too_many_lines": 413}


def http_code(reason: Column) -> Column:
    code = F.when(reason.isNull(), F.lit(200))
    for name, value in HTTP_CODES.items():
        code = code.when(reason == name, F.lit(value))
    return code.otherwise(F.lit(400))


def header_fault(options: Options) -> Column:
    """First fault that shows before any line is read."""
    body = F.col("body")
    return (
        F.when(~text.is_media_type(F.col("content_type"), INGEST_MEDIA_TYPE), "unsupported_media_type")
        .when(~text.is_hex_key(F.col("idempotency_key")), "bad_idempotency_key")
        .when(~text.fits_body_limit(body, options.max_body_bytes), "body_too_large")
        .when(text.is_blank(body), "blank_body")
    )


def line_count_fault(lines: Column, options: Options) -> Column:
    return F.when(F.size(lines) == 0, "no_events").when(
        F.size(lines) > options.max_batch_lines, "too_many_lines"
    )


def as_instant(as_of: datetime | str | None, fallback: str) -> Column:
    if as_of is None:
        return F.col(fallback)
    return F.lit(utc(as_of) if isinstance(as_of, datetime) else as_of).cast("timestamp")


def judge(batches: DataFrame, options: Options, as_of: datetime | str | None = None) -> DataFrame:
    """One row per batch with its ``_fault`` (null when accepted), the first bad line,
    the line count and the checked lines; every input column but the body is kept.

    ``as_of`` is the clock of the future-timestamp rule; without it each batch is
    judged at its arrival time.
    """
    kept = [name for name in batches.columns if name != "body"]
    limit = as_instant(as_of, "received_at") + F.make_dt_interval(F.lit(options.future_tolerance_days))

    split = batches.withColumn("_header_fault", header_fault(options)).withColumn(
        "_lines", F.when(F.col("_header_fault").isNull(), text.split_lines(F.col("body")))
    )
    counted = split.select(
        *kept,
        "_lines",
        F.coalesce("_header_fault", line_count_fault(F.col("_lines"), options)).alias("_batch_fault"),
    )
    checked = counted.select(
        *kept,
        F.when(F.col("_lines").isNotNull(), F.size("_lines")).alias("_n"),
        "_batch_fault",
        F.when(F.col("_batch_fault").isNull(), checked_lines("_lines")).alias("_checked"),
    )
    bad = F.filter(
        F.transform("_checked", lambda c, i: F.struct((i + 1).alias("line_no"), c["fault"].alias("fault"))),
        lambda c: c["fault"].isNotNull(),
    )
    too_new = F.exists("_checked", lambda c: c["event"]["event_timestamp"] > limit)
    return checked.withColumn("_first_bad", F.get(bad, F.lit(0))).withColumn(
        "_fault",
        F.coalesce(
            F.col("_batch_fault"), F.col("_first_bad.fault"), F.when(too_new, "future_timestamp")
        ),
    )


def gate(batches: DataFrame, options: Options, as_of: datetime | str | None = None) -> DataFrame:
    """One row per event of an accepted batch, and one row per rejected batch."""
    kept = [name for name in batches.columns if name != "body"]
    judged = judge(batches, options, as_of)
    accepted = F.transform(
        "_checked",
        lambda c, i: F.struct(
            F.lit(ACCEPTED).alias("status"),
            F.lit(200).alias("http_code"),
            F.lit(None).cast("string").alias("reason"),
            (i + 1).alias("line_no"),
            F.col("_n").alias("line_count"),
            c["event"].alias("event"),
        ),
    )
    rejected = F.array(
        F.struct(
            F.lit(REJECTED).alias("status"),
            http_code(F.col("_fault")).alias("http_code"),
            F.col("_fault").alias("reason"),
            F.col("_first_bad.line_no").alias("line_no"),
            F.col("_n").alias("line_count"),
            F.lit(None).cast(f"struct<{_EVENT_STRUCT}>").alias("event"),
        )
    )
    # Everything downstream filters on comes out of the generator, so no filter can
    # slip below it and parse the lines a second time.
    rows = judged.select(*kept, F.inline(F.when(F.col("_fault").isNull(), accepted).otherwise(rejected)))
    return rows.select(*kept, "status", "http_code", "reason", "line_no", "line_count", "event.*")


def batch_heads(gated: DataFrame) -> DataFrame:
    """One row per batch: a rejected batch has one row, an accepted one its first line."""
    return gated.where((F.col("status") == REJECTED) | (F.col("line_no") == 1))


def batch_verdicts(gated: DataFrame) -> DataFrame:
    return batch_heads(gated).select(
        "idempotency_key", "received_at", "status", "http_code", "reason",
        F.when(F.col("status") == REJECTED, F.col("line_no")).alias("line_no"),
    )


def quarantine(gated: DataFrame) -> DataFrame:
    """Why batches were refused; never what they held."""
    return batch_verdicts(gated).where(F.col("status") == REJECTED)


def accepted_events(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("status") == ACCEPTED).drop("status", "http_code", "reason")


def batch_summary(gated: DataFrame) -> DataFrame:
    """Ledger row of every accepted batch; the first line names the install."""
    return batch_heads(gated).where(F.col("status") == ACCEPTED).select(
        "idempotency_key", "install_id", "line_count", "received_at"
    )
