"""Erasure requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runtally.config import Options
from runtally.functions.text import canonical_guid, fits_body_limit, is_media_type
from runtally.schema import FORGET_MEDIA_TYPE

_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def forget_install(body: Column) -> Column:
    """Canonical install id of a request body; null when the body is not acceptable.

    The property name matches in any case, and the last one counts.
    """
    tag = F.xxhash64(body).cast("string")
    boxed = F.concat(F.lit("["), body, F.lit(',{"'), tag, F.lit('":0}]'))
    docs = F.from_json(boxed, "array<map<string,variant>>", _STRICT_JSON)
    whole = (F.size(docs) == 2) & F.map_contains_key(F.get(docs, F.lit(1)), tag)
    entries = F.map_entries(F.when(whole, F.get(docs, F.lit(0))))
    ids = F.filter(entries, lambda e: F.lower(e["key"]) == "installid")
    value = F.element_at(F.when(F.size(ids) > 0, ids), -1)["value"]
    return canonical_guid(
        F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    )


def forget_fault(options: Options | None = None) -> Column:
    """The first broken rule of an erasure request; its body has the same limit as a batch's."""
    limit = (options or Options()).max_body_bytes
    return (
        F.when(~is_media_type(F.col("content_type"), FORGET_MEDIA_TYPE), "unsupported_media_type")
        .when(~fits_body_limit(F.col("body"), limit), "body_too_large")
        .when(forget_install(F.col("body")).isNull(), "bad_install_id")
    )


def parse_forget(requests: DataFrame, options: Options | None = None) -> DataFrame:
    """Accepted erasure requests as (install_id, requested_at)."""
    return requests.where(forget_fault(options).isNull()).select(
        forget_install(F.col("body")).alias("install_id"), F.col("ts").alias("requested_at")
    )


def forget_state(log: DataFrame) -> DataFrame:
    """Latest request of every install; a null ``processed_at`` means it is pending.

    The log holds one row per request and one more when it has been served. A later
    request reopens the install; the served row of the same request sorts above it.
    """
    return (
        log.groupBy("install_id")
        .agg(F.max(F.struct("requested_at", "processed_at")).alias("last"))
        .select("install_id", "last.requested_at", "last.processed_at")
    )


def pending_forgets(state: DataFrame, limit: int | None = None) -> DataFrame:
    """Open requests, oldest first; ``limit`` bounds one round."""
    pending = (
        state.where(F.col("processed_at").isNull())
        .select("install_id", "requested_at")
        .orderBy("requested_at", "install_id")
    )
    return pending if limit is None else pending.limit(limit)
