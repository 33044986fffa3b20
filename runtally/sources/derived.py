"""Telemetry derived from an ``events`` table, as input for checks and benchmarks.

One run is one (user, UTC day). Runs are encoded as wire lines and grouped into raw
batches, with resends, re-batching, bad lines, unknown fields and clock errors that
follow from the user id and the 7-day block alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runtally.functions.text import batch_key
from runtally.functions.wire import encode_event
from runtally.schema import FORGET_MEDIA_TYPE, FORGET_PATH, INGEST_MEDIA_TYPE, INGEST_PATH

ORIGIN = "2024-01-01"


def install_id(user_id: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(user_id.cast("string"), 12, "0"))


def derive_runs(events: DataFrame) -> DataFrame:
    """Flat run events with the ``user_id``, ``day`` and ``block`` they come from."""
    kind = F.col("event_type")
    provider = F.concat(kind, F.lit(".p"), F.regexp_extract("props", r"(\d+)", 1).cast("int") % 3)
    # Counted per provider first, so a busy user-day arrives pre-aggregated.
    per_provider = (
        events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_type", "value", provider.alias("provider"))
        .groupBy("user_id", "day", "event_type", "provider")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n"),
            F.max("ts").alias("ts"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )

    def steps(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col("n"))), F.lit(0)).cast("int")

    def scenarios(*kinds: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k.isin(*kinds)))

    verdicts = {
        "pass": ["view", "purchase"],
        "fail": ["click"],
        "env_error": ["error"],
        "inconclusive": ["signup"],
    }
    # One list per user-day; its few kinds are counted inside it.
    grouped = per_provider.groupBy("user_id", "day").agg(
        F.max("ts").cast("timestamp").alias("event_timestamp"),
        *[steps(*kinds).alias(f"step_{verdict}") for verdict, kinds in verdicts.items()],
        F.collect_list(F.struct("event_type", "provider", "n")).alias("uses"),
        F.round(F.min("low") * 100).cast("bigint").alias("startup_ms"),
        F.round(F.max("high") * 10).cast("bigint").alias("_more_ms"),
    ).withColumn("kinds", F.array_sort(F.array_distinct("uses.event_type")))

    def used(of: Column) -> Column:
        own = F.filter("uses", lambda u: u["event_type"].eqNullSafe(of))
        return F.aggregate(own, F.lit(0), lambda n, u: n + u["n"])

    families = F.transform("kinds", lambda k: F.struct(k.alias("event_type"), used(k).alias("n")))
    providers = F.transform("uses", lambda u: F.struct(u["provider"].alias("provider"), u["n"].alias("n")))
    runs = grouped.select(
        "*",
        F.size("kinds").alias("scenario_count"),
        *[scenarios(*kinds).alias(f"scenario_{verdict}") for verdict, kinds in verdicts.items()],
        F.map_from_entries(families).alias("step_families"),
        F.map_from_entries(F.array_sort(providers)).alias("step_providers"),
    )
    user = F.col("user_id")
    minor = F.concat(F.lit("1."), (user % 4).cast("string"), F.lit(".0"))
    return runs.select(
        "user_id",
        "day",
        F.floor(F.datediff("day", F.lit(ORIGIN).cast("date")) / 7).cast("int").alias("block"),
        install_id(user).alias("install_id"),
        "event_timestamp",
        F.when(user % 10 == 9, 2).otherwise(1).alias("schema_version"),
        minor.alias("tool_version"),
        minor.alias("engine_version"),
        F.concat(F.lit(".NET "), (8 + user % 2).cast("string"), F.lit(".0")).alias("dotnet_version"),
        F.lit(1).alias("run_count"),
        "scenario_count",
        *[f"step_{verdict}" for verdict in verdicts],
        *[f"scenario_{verdict}" for verdict in verdicts],
        "step_families",
        "step_providers",
        "startup_ms",
        (F.col("startup_ms") + F.col("_more_ms")).alias("time_to_first_test_ms"),
    )


def _ordered_lines(order: Column, line: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("at"), line.alias("line"))))
    return F.transform(pairs, lambda p: p["line"])


def _after(days: Column, user: Column) -> Column:
    """Arrival time: so many days after the origin, spread over the day by user."""
    start = F.lit(ORIGIN).cast("timestamp")
    return start + F.make_dt_interval(days, F.lit(0), F.lit(0), (user % 86400).cast("decimal(18,6)"))


def derive_batches(runs: DataFrame) -> DataFrame:
    """Raw batches with the ``user_id``, ``block`` and ``copy`` they stand for.

    copy 0 is the original, 1 an exact resend, 2 all of a user's lines in one batch
    (block -1). A batch holds a user's runs of one week, or of all days.
    """
    user, block = F.col("user_id"), F.col("block")
    marked = user % 13 == 0
    plain = runs.withColumn("line", encode_event())
    shifted = runs.withColumn(
        "event_timestamp",
        F.when(
            (user % 17 == 0) & (block == 3), F.col("event_timestamp") + F.expr("INTERVAL 10 YEARS")
        ).otherwise(F.col("event_timestamp")),
    ).withColumn("line", encode_event())
    lines = shifted.withColumn(
        "line",
        F.when(marked & (block == 2), F.regexp_replace("line", r"\}$", ',"futureField":1}')).otherwise(F.col("line")),
    )
    weekly = lines.groupBy("user_id", "block").agg(
        _ordered_lines(F.col("event_timestamp"), F.col("line")).alias("lines")
    )
    originals = weekly.select(
        "user_id",
        "block",
        F.explode(F.when(user % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(marked & (block == 1), F.concat("lines", F.array(F.lit("{not json}")))).otherwise(F.col("lines")).alias("lines"),
    ).withColumn(
        "received_at",
        _after((block + 1) * 7, user) + F.make_dt_interval(F.lit(0), F.col("copy")),
    )
    regrouped = (
        plain.where(user % 7 == 0)
        .groupBy("user_id")
        .agg(_ordered_lines(F.col("event_timestamp"), F.col("line")).alias("lines"))
        .select(
            "user_id",
            F.lit(-1).alias("block"),
            F.lit(2).alias("copy"),
            "lines",
            _after(F.lit(40), user).alias("received_at"),
        )
    )
    return originals.unionByName(regrouped).select(
        "user_id",
        "block",
        "copy",
        batch_key(F.col("lines")).alias("idempotency_key"),
        F.lit(INGEST_MEDIA_TYPE).alias("content_type"),
        "received_at",
        F.array_join("lines", "\n").alias("body"),
    )


def _nested(line: Column, arrays: int) -> Column:
    """The line with an unknown property of so many arrays inside each other."""
    return F.regexp_replace(line, r"\}$", ',"futureField":' + "[" * arrays + "]" * arrays + "}")


def derive_damaged_lines(runs: DataFrame) -> DataFrame:
    """Every run's line with one of 41 deviations, chosen by user and day."""
    line = F.col("line")

    def swap(pattern: str, by: str) -> Column:
        return F.regexp_replace(line, pattern, by)

    # Both versions are brought to 1 first, so each deviation means the same everywhere.
    deviations = [
        line,
        swap(r'^\{"schemaVersion":1,', "{"),
        swap(r'"schemaVersion":1,', '"schemaVersion":"1",'),
        swap(r'"schemaVersion":1,', '"schemaVersion":1.0,'),
        swap(r'"schemaVersion":1,', '"schemaVersion":0,'),
        swap(r'"toolVersion":"[^"]*",', ""),
        swap(r"\}$", ',"futureField":1}'),
        swap(r'"stepVerdicts":\{', '"stepVerdicts":{"other":1,'),
        F.regexp_replace(swap(r'"schemaVersion":1,', '"schemaVersion":2,'), r'"stepVerdicts":\{', '"futureField":[1],"stepVerdicts":{"other":"x",'),
        swap(r'"runCount":1,', '"runCount":"1",'),
        swap(r'"runCount":1,', '"runCount":3000000000,'),
        swap(r'"installId":"([0-9a-f]{8})-', '"installId":"$1'),
        swap(r'"timestamp":"([0-9-]+)T', '"timestamp":"$1 '),
        F.concat(line, F.lit(" trailing")),
        F.concat(line, F.lit(","), line),
        F.regexp_replace(line, '"', "'"),
        swap(r'"toolVersion":"[^"]*"', '"toolVersion":null'),
        swap(r'"stepVerdicts":\{[^}]*\}', '"stepVerdicts":null'),
        swap(r'"stepFamilies":\{[^}]*\}', '"stepFamilies":null'),
        swap(r'"toolVersion":"[^"]*"', '"toolVersion":1'),
        swap(r'"stepFamilies":\{', '"stepFamilies":{"view":7,'),
        swap(r'\+00:00"', '"'),
        swap(r'"stepProviders":\{[^}]*\}', '"stepProviders":{"view.p0":"3"}'),
        F.concat(line, F.lit("] x")),
        swap(r'"stepVerdicts":\{[^}]*\}', '"stepVerdicts":{"fail":4}'),
        swap(r'"timestamp":"([0-9-]+)T[0-9:.]+\+00:00"', '"timestamp":"$1T25:00:00Z"'),
        # a property twice: the wrong value second, then first
        swap(r'"runCount":1,', '"runCount":1,"runCount":"x",'),
        swap(r'"runCount":1,', '"runCount":"x","runCount":1,'),
        swap(r'"startupMs":(\d+),', '"startupMs":$1,"startupMs":1.5,'),
        swap(r'"startupMs":(\d+),', '"startupMs":1.5,"startupMs":$1,'),
        swap(r'"stepFamilies":(\{[^}]*\}),', '"stepFamilies":$1,"stepFamilies":[1],'),
        swap(r'"stepFamilies":(\{[^}]*\}),', '"stepFamilies":[1],"stepFamilies":$1,'),
        swap(r'"stepVerdicts":(\{[^}]*\}),', '"stepVerdicts":$1,"stepVerdicts":5,'),
        swap(r'"stepVerdicts":(\{[^}]*\}),', '"stepVerdicts":5,"stepVerdicts":$1,'),
        swap(r'"toolVersion":("[^"]*"),', '"toolVersion":$1,"toolVersion":7,'),
        swap(r'"toolVersion":("[^"]*"),', '"toolVersion":7,"toolVersion":$1,'),
        swap(r'\+00:00"', '+14:30"'),
        swap(r'\+00:00"', '-14:59"'),
        _nested(swap(r'"schemaVersion":1,', '"schemaVersion":2,'), 63),
        _nested(swap(r'"schemaVersion":1,', '"schemaVersion":2,'), 64),
        swap(r'"runCount":1,', '"runCount":8,"runCount":1,'),
    ]
    kind = (F.col("user_id") * 31 + F.dayofmonth("day")) % len(deviations)
    chosen = F.coalesce(*[F.when(F.col("kind") == i, d) for i, d in enumerate(deviations)])
    return (
        runs.withColumn("schema_version", F.lit(1))
        .withColumn("line", encode_event())
        .withColumn("kind", kind.cast("int"))
        .select("user_id", "day", "kind", chosen.alias("line"))
    )


# Fixed bearer tokens of the derived request log; only their digests reach the operators.
REQUEST_TOKENS = ["token-a", "token-b", "token-c"]


def derive_requests(batches: DataFrame) -> DataFrame:
    """A request log: every batch posted once, with header faults, plus erasure
    requests and probes that follow from the user id."""
    user = F.col("user_id")
    token = F.element_at(F.array(*[F.lit(t) for t in REQUEST_TOKENS]), (user % 3 + 1).cast("int"))
    header = (
        F.when(user % 37 == 1, F.lit("Bearer wrong"))
        .when(user % 37 == 2, F.lit(None).cast("string"))
        .when(user % 37 == 3, F.concat(F.lit("bEARER "), token))
        .otherwise(F.concat(F.lit("Bearer "), token))
    )
    key, body = F.col("idempotency_key"), F.col("body")
    posts = batches.select(
        F.concat_ws("-", F.lit("post"), "user_id", "block", "copy").alias("req_id"),
        F.col("received_at").alias("ts"),
        F.lit(INGEST_PATH).alias("path"),
        header.alias("authorization"),
        F.when(user % 19 == 3, "text/plain")
        .when(user % 19 == 4, "Application/X-NDJSON ; charset=utf-8")
        .otherwise(F.col("content_type"))
        .alias("content_type"),
        F.when(user % 23 == 5, F.upper(key))
        .when(user % 23 == 6, F.lit(None).cast("string"))
        .when(user % 23 == 7, F.substring(key, 1, 63))
        .otherwise(key)
        .alias("idempotency_key"),
        F.when(user % 29 == 2, F.lit(" \r\n\t"))
        .when(user % 29 == 3, F.concat(body, F.repeat(F.lit(" "), F.lit(40000))))
        .otherwise(body)
        .alias("body"),
    )
    users = batches.select("user_id").distinct()
    guid = install_id(user)
    wide = F.when(user % 5 == 1, F.repeat(F.lit(" "), F.lit(40000))).otherwise("")
    forgets = users.where(user % 11 == 0).select(
        F.concat_ws("-", F.lit("forget"), "user_id").alias("req_id"),
        _after(F.lit(60), user).alias("ts"),
        F.lit(FORGET_PATH).alias("path"),
        header.alias("authorization"),
        F.when(user % 2 == 0, FORGET_MEDIA_TYPE).otherwise("application/json; charset=utf-8").alias("content_type"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.concat(
            F.when(user % 3 == 0, F.concat(F.lit('{"installId":"'), guid, F.lit('"}')))
            .when(user % 3 == 1, F.concat(F.lit('{"INSTALLID":"{'), F.upper(guid), F.lit('}"}')))
            .otherwise(F.concat(F.lit('{"installId":"'), F.regexp_replace(guid, "-", ""), F.lit('x"}'))),
            wide,
        ).alias("body"),
    )
    probes = users.select(
        F.concat_ws("-", F.lit("probe"), "user_id").alias("req_id"),
        _after(F.lit(7), user).alias("ts"),
        F.element_at(
            F.array(*[F.lit(p) for p in ["/healthz", "/readyz", "/", "/nowhere"]]), (user % 4 + 1).cast("int")
        ).alias("path"),
        F.lit(None).cast("string").alias("authorization"),
        F.lit(None).cast("string").alias("content_type"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.lit(None).cast("string").alias("body"),
    )
    return posts.unionByName(forgets).unionByName(probes)
