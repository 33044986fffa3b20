"""Decisions over a request log: tokens, admission and outcome.

A request has ``req_id, ts, path, authorization, content_type, idempotency_key, body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runtally.config import Options
from runtally.functions.text import bearer_token
from runtally.operators.forget import forget_fault
from runtally.operators.gate import http_code, judge
from runtally.schema import FORGET_PATH, INGEST_PATH, UNLIMITED_PATHS
from runtally.session import materialize


def token_digest(header: Column) -> Column:
    """Upper-case SHA-256 of the token; the token itself goes no further."""
    return F.upper(F.sha2(bearer_token(header), 256))


def is_known_token(header: Column, digests: list[str]) -> Column:
    """Whether the header carries one of the configured tokens, given by digest."""
    if not digests:
        return F.lit(False)
    return F.coalesce(token_digest(header).isin(digests), F.lit(False))


def rate_partition_key(header: Column, digests: list[str]) -> Column:
    """One key per known token, and a single one for everything else."""
    return F.when(is_known_token(header, digests), F.concat(F.lit("tok:"), token_digest(header))).otherwise(
        "unauthenticated"
    )


def match_tokens(requests: DataFrame, digests: list[str]) -> DataFrame:
    header = F.col("authorization")
    return requests.select(
        "req_id",
        is_known_token(header, digests).alias("authenticated"),
        rate_partition_key(header, digests).alias("rate_key"),
    )


def fixed_window_admission(requests: DataFrame, digests: list[str], options: Options) -> DataFrame:
    """Every request with ``rate_key`` and ``admitted``.

    The global limit is checked first, and a request it lets through has spent a global
    permit even when its own key is exhausted. Both limits admit the earliest requests
    of a window, so each (window, key) has a last admitted request to compare with:
    only the first ``permits`` requests of a window are ever ranked (pruned map-side),
    and a flood of any size in one window never gathers in one task.
    """
    seconds = f"{options.rate_window_seconds} seconds"
    keyed = requests.withColumn("rate_key", rate_partition_key(F.col("authorization"), digests)).withColumn(
        "_window", F.window("ts", seconds)["start"]
    )
    by_arrival = Window.partitionBy("_window").orderBy("ts", "req_id")
    by_key = Window.partitionBy("_window", "rate_key").orderBy("ts", "req_id")
    policed = F.col("path").isin(INGEST_PATH, FORGET_PATH)
    passed_global = (
        keyed.where(~F.col("path").isin(UNLIMITED_PATHS))
        .select("_window", "rate_key", "ts", "req_id", policed.alias("_policed"))
        .withColumn("_rank", F.row_number().over(by_arrival))
        .where(F.col("_rank") <= options.rate_permits * options.global_rate_factor)
    )
    arrival = F.struct("ts", "req_id")
    last_global = passed_global.groupBy("_window").agg(F.max(arrival).alias("_last_global"))
    last_per_key = (
        passed_global.where("_policed")
        .withColumn("_key_rank", F.row_number().over(by_key))
        .where(F.col("_key_rank") <= options.rate_permits)
        .groupBy("_window", "rate_key")
        .agg(F.max(arrival).alias("_last_of_key"))
    )
    in_global = F.coalesce(arrival <= F.col("_last_global"), F.lit(False))
    in_key = F.coalesce(arrival <= F.col("_last_of_key"), F.lit(False))
    return (
        keyed.join(last_global, "_window", "left")
        .join(last_per_key, ["_window", "rate_key"], "left")
        .withColumn(
            "admitted",
            F.when(F.col("path").isin(UNLIMITED_PATHS), True)
            .when(~policed, in_global)
            .otherwise(in_global & in_key),
        )
        .select(*requests.columns, "rate_key", "admitted")
    )


def request_outcome(
    requests: DataFrame, digests: list[str], options: Options, ledger: DataFrame, as_of=None
) -> DataFrame:
    """Status code of every request: 429, then 401, then what its endpoint answers.

    A batch whose key was stored before, by the ledger or an earlier request, is a
    ``duplicate`` and still answered with 200.

    The endpoint's own verdict needs the body but no other row, so it comes first and
    the bodies are gone before anything is shuffled.
    """
    is_ingest, is_forget = F.col("path") == INGEST_PATH, F.col("path") == FORGET_PATH
    judged = judge(
        requests.withColumn("_forget_fault", F.when(is_forget, forget_fault(options)))
        .withColumn("body", F.when(is_ingest, F.col("body")))
        .withColumn("received_at", F.col("ts")),
        options,
        as_of,
    )
    slim = materialize(
        judged.select(
            "req_id", "ts", "path", "authorization", "idempotency_key",
            F.when(is_ingest, F.col("_fault")).otherwise(F.col("_forget_fault")).alias("fault"),
        ),
        "requests",
    )
    policed = is_ingest | is_forget
    known = is_known_token(F.col("authorization"), digests)
    answered = (
        fixed_window_admission(slim, digests, options)
        .withColumn(
            "reason",
            F.when(~F.col("admitted"), "rate_limited")
            .when(policed & ~known, "unauthenticated")
            .when(policed, F.col("fault"))
            .when(~F.col("path").isin("/", *UNLIMITED_PATHS), "unknown_path"),
        )
        .select("req_id", "ts", "path", "idempotency_key", "reason")
    )
    stored = answered.where(is_ingest & F.col("reason").isNull())
    first = (
        stored.groupBy("idempotency_key")
        .agg(F.min(F.struct("ts", "req_id")).alias("_first"))
        .join(ledger.select("idempotency_key", F.lit(True).alias("_known")), "idempotency_key", "left")
    )
    own = F.struct("ts", "req_id")
    repeated = is_ingest & F.col("reason").isNull() & (F.col("_known").isNotNull() | (F.col("_first") != own))
    code = (
        F.when(F.col("reason") == "rate_limited", 429)
        .when(F.col("reason") == "unauthenticated", 401)
        .when(F.col("reason") == "unknown_path", 404)
        .otherwise(http_code(F.col("reason")))
    )
    return answered.join(first, "idempotency_key", "left").select(
        "req_id", "ts", "path", code.alias("http_code"),
        F.when(repeated, "duplicate").otherwise(F.col("reason")).alias("reason"),
    )
