from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import NOW, batches, event_line, key_of
from pyspark.sql import functions as F

from runtally import Options, validate_options
from runtally.operators import gate

GOOD = event_line()


def verdict(spark, key=1, body=GOOD, content_type="application/x-ndjson", options=Options(), as_of=NOW):
    df = batches(spark, (key, body)).withColumn("content_type", F.lit(content_type).cast("string"))
    row = gate.batch_verdicts(gate.gate(df, options, as_of)).collect()
    assert len(row) == 1
    return row[0]["http_code"], row[0]["reason"], row[0]["line_no"]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, (200, None, None)),
        ({"content_type": "Application/x-NDJSON; charset=utf-8"}, (200, None, None)),
        ({"body": GOOD + "\r\n\r\n" + event_line(2) + "\n"}, (200, None, None)),
        ({"content_type": "application/json"}, (415, "unsupported_media_type", None)),
        ({"content_type": None}, (415, "unsupported_media_type", None)),
        ({"key": None}, (400, "bad_idempotency_key", None)),
        ({"key": "abc"}, (400, "bad_idempotency_key", None)),
        ({"key": "A" * 64}, (400, "bad_idempotency_key", None)),
        ({"body": ""}, (400, "blank_body", None)),
        ({"body": None}, (400, "blank_body", None)),
        ({"body": " \r\n\t\n"}, (400, "blank_body", None)),
        ({"body": GOOD + "\n{not json}\n{}"}, (400, "malformed_json", 2)),
        ({"body": GOOD + "\n\n" + event_line(version=0)}, (400, "schema_version_below_one", 2)),
        ({"body": event_line(at="2026-07-04T12:00:00Z")}, (400, "future_timestamp", None)),
        ({"body": event_line(at="2026-07-03T12:00:00Z")}, (200, None, None)),
        ({"body": event_line(at="2026-07-03T12:00:00.000001Z")}, (400, "future_timestamp", None)),
    ],
)
def test_verdicts(spark, change, expected):
    assert verdict(spark, **change) == expected


def test_limits_are_strict(spark):
    body = "\n".join(event_line(n) for n in range(6))
    assert verdict(spark, body=body, options=replace(Options(), max_batch_lines=6))[0] == 200
    assert verdict(spark, body=body, options=replace(Options(), max_batch_lines=5))[:2] == (413, "too_many_lines")
    size = len(body)
    assert verdict(spark, body=body, options=replace(Options(), max_body_bytes=size))[0] == 200
    assert verdict(spark, body=body, options=replace(Options(), max_body_bytes=size - 1))[:2] == (413, "body_too_large")
    wide = event_line(tool="é" * 50)
    assert verdict(spark, body=wide, options=replace(Options(), max_body_bytes=len(wide)))[0] == 413


def test_first_failure_wins(spark):
    tiny = replace(Options(), max_body_bytes=1, max_batch_lines=0)
    assert verdict(spark, key="x", body="{bad", content_type="text/plain", options=tiny)[0] == 415
    assert verdict(spark, key="x", body="{bad", options=tiny)[:2] == (400, "bad_idempotency_key")
    assert verdict(spark, body="{bad", options=tiny)[:2] == (413, "body_too_large")
    assert verdict(spark, body="{bad", options=replace(Options(), max_batch_lines=0))[:2] == (413, "too_many_lines")
    late = event_line(at="2026-12-01T00:00:00Z")
    assert verdict(spark, body=late + "\n{bad")[:2] == (400, "malformed_json")


def test_all_or_nothing_and_quarantine_without_payload(spark):
    df = batches(spark, (1, [GOOD, "{bad}"]), (2, [GOOD, event_line(2)]))
    gated = gate.gate(df, Options(), NOW)
    kept = gate.accepted_events(gated)
    assert {row["idempotency_key"] for row in kept.collect()} == {key_of(2)}
    assert kept.count() == 2
    refused = gate.quarantine(gated)
    assert refused.columns == ["idempotency_key", "received_at", "status", "http_code", "reason", "line_no"]
    assert [tuple(r)[2:] for r in refused.collect()] == [("rejected", 400, "malformed_json", 2)]
    assert [tuple(r)[:3] for r in gate.batch_summary(gated).collect()] == [
        (key_of(2), "00000000-0000-4000-8000-000000000001", 2)
    ]


def test_clock_defaults_to_arrival(spark):
    late = event_line(at="2026-07-02T00:00:00Z")
    df = batches(spark, (1, late, NOW - timedelta(days=5)), (2, late, NOW))
    reasons = {r["idempotency_key"]: r["reason"] for r in gate.batch_verdicts(gate.gate(df, Options())).collect()}
    assert reasons == {key_of(1): "future_timestamp", key_of(2): None}


def test_lines_are_parsed_once(spark):
    plan = gate.gate(batches(spark, (1, GOOD)), Options(), NOW).where("status = 'accepted' and step_pass > 0")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # the typed read, and the read of every occurrence for lines that repeat a property
    assert text.count("from_json(ArrayType") + text.count("from_json(MapType") == text.count("from_json(") == 2
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_option_faults_are_all_reported():
    with pytest.raises(ValueError, match="retention_days.*dedup_retention_days.*job_interval_hours.*precreate_days"):
        validate_options(Options(retention_days=0, dedup_retention_days=0, job_interval_hours=0, precreate_days=-1))
    assert validate_options(Options(precreate_days=0)).precreate_days == 0
