"""Table shapes and the frozen wire contract."""

from __future__ import annotations

# Wire property names in wire order.
WIRE_FIELDS = [
    "schemaVersion",
    "timestamp",
    "installId",
    "toolVersion",
    "engineVersion",
    "dotnetVersion",
    "runCount",
    "scenarioCount",
    "stepVerdicts",
    "scenarioVerdicts",
    "stepFamilies",
    "stepProviders",
    "startupMs",
    "timeToFirstTestMs",
]
VERDICT_FIELDS = ["pass", "fail", "envError", "inconclusive"]

# The closed list of step families, and the bucket for all others.
STEP_FAMILIES = [
    "http",
    "db-assert",
    "mq-publish",
    "mq-expect",
    "cache-assert",
    "mail-expect",
    "webhook-listen",
    "metrics-assert",
    "storage-assert",
    "trace-expect",
    "script",
    "custom",
]

INGEST_MEDIA_TYPE = "application/x-ndjson"
FORGET_MEDIA_TYPE = "application/json"
INGEST_PATH = "/v1/telemetry"
FORGET_PATH = "/v1/telemetry/forget"
UNLIMITED_PATHS = ["/healthz", "/readyz"]

DEFAULT_PART = "default"
SHARDS_PROPERTY = "runtally.install_shards"
GENERATION_PROPERTY = "runtally.generation"
EVENT_KEY = ["install_id", "event_timestamp", "schema_version"]

VERDICT_COLUMNS = [
    "step_pass",
    "step_fail",
    "step_env_error",
    "step_inconclusive",
    "scenario_pass",
    "scenario_fail",
    "scenario_env_error",
    "scenario_inconclusive",
]

RAW_BATCH = (
    "idempotency_key string, content_type string, received_at timestamp, body string"
)

REQUEST = (
    "req_id string, ts timestamp, path string, authorization string, content_type string, "
    "idempotency_key string, body string"
)

# What one wire line becomes, before the server's own columns are added.
FLAT_EVENT = (
    "install_id string, event_timestamp timestamp, schema_version int, "
    "tool_version string, engine_version string, dotnet_version string, "
    "run_count int, scenario_count int, "
    "step_pass int, step_fail int, step_env_error int, step_inconclusive int, "
    "scenario_pass int, scenario_fail int, scenario_env_error int, scenario_inconclusive int, "
    "step_families map<string,int>, step_providers map<string,int>, "
    "startup_ms bigint, time_to_first_test_ms bigint"
)
FLAT_EVENT_COLUMNS = [column.split()[0] for column in FLAT_EVENT.split(", ")]

_COUNTS = ", ".join(f"{name} bigint" for name in ["events", "runs", "scenarios", *VERDICT_COLUMNS])

# name -> (columns, partition columns)
TABLES = {
    "telemetry_event": (
        f"{FLAT_EVENT}, received_at timestamp, generation bigint, part string, shard int",
        ["part", "shard"],
    ),
    "ingest_batch": (
        "idempotency_key string, install_id string, line_count int, received_at timestamp, "
        "generation bigint, received_day string",
        ["received_day"],
    ),
    # Tombstones: rows of the install that were stored in a generation up to ``upto`` are erased.
    # A drain adds one partition and begins a new generation; compaction drops the partition
    # when the rows are gone.
    "erasure": ("install_id string, erased_at timestamp, upto bigint", ["upto"]),
    # Append-only: the current state of an install is its latest request.
    "forget_log": (
        "install_id string, requested_at timestamp, processed_at timestamp",
        [],
    ),
    # Append-only: a day is registered when its highest version says so.
    "partition_log": ("day date, active boolean, version bigint", []),
    "batch_verdict": (
        "idempotency_key string, received_at timestamp, status string, http_code int, "
        "reason string, line_no int, received_day string",
        ["received_day"],
    ),
    # One row per batch and run, repeated ones included; ``replayed`` marks an arrival that an
    # earlier run had recorded, so that reports count each arrival once.
    "ingest_result": (
        "run_id string, idempotency_key string, body_hash bigint, received_at timestamp, http_code int, "
        "outcome string, reason string, bad_line int, total_events int, new_rows bigint, replayed boolean, received_day string",
        ["received_day"],
    ),
    "maintenance_run": (
        "as_of timestamp, step string, ok boolean, rows bigint, error string, run_day string",
        ["run_day"],
    ),
    # Append-only: the stored rollups of a day are due while its highest version says so.
    "rollup_log": ("day date, due boolean, version bigint", []),
    # Signed counts that add up to the rollups of a day: a batch adds, an erasure subtracts.
    "rollup_partial": ("day timestamp, kind string, name string, value bigint, n bigint, rollup_day string", ["rollup_day"]),
    # Stored copies of the dashboard rollups.
    "run_daily": (
        f"day timestamp, {_COUNTS}, startup_ms_p50 double, startup_ms_p95 double, "
        "time_to_first_test_ms_p50 double, time_to_first_test_ms_p95 double, "
        "distinct_installs bigint, rollup_day string",
        ["rollup_day"],
    ),
    "step_family_daily": ("day timestamp, family string, n bigint, rollup_day string", ["rollup_day"]),
    "step_provider_daily": ("day timestamp, provider string, n bigint, rollup_day string", ["rollup_day"]),
    "install_sketch": ("day timestamp, sketch binary, rollup_day string", ["rollup_day"]),
}
