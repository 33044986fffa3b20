from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from datetime import timedelta

import pytest
from conftest import NOW, event_line, key_of

from runtally import Options
from runtally.operators import requests as reqs
from runtally.schema import FORGET_PATH, INGEST_PATH, REQUEST

TOKENS = ["alpha", "beta"]
DIGESTS = [hashlib.sha256(t.encode()).hexdigest().upper() for t in TOKENS]


def log(spark, rows):
    columns = ["req_id", "ts", "path", "authorization", "content_type", "idempotency_key", "body"]
    return spark.createDataFrame([tuple(row.get(c) for c in columns) for row in rows], REQUEST)


@pytest.mark.parametrize(
    ("header", "digests", "ok"),
    [
        ("Bearer alpha", DIGESTS, True),
        ("bearer beta", DIGESTS, True),
        ("BEARER alpha", DIGESTS, True),
        ("Bearer Alpha", DIGESTS, False),
        ("Bearer alpha ", DIGESTS, False),
        ("Bearer ", DIGESTS, False),
        ("alpha", DIGESTS, False),
        ("Basic alpha", DIGESTS, False),
        ("", DIGESTS, False),
        (None, DIGESTS, False),
        ("Bearer alpha", [], False),
    ],
)
def test_tokens(spark, header, digests, ok):
    row = reqs.match_tokens(log(spark, [{"req_id": "a", "ts": NOW, "path": "/", "authorization": header}]), digests).first()
    assert row["authenticated"] is ok
    token = header.split(" ", 1)[1] if ok else None
    assert row["rate_key"] == (f"tok:{hashlib.sha256(token.encode()).hexdigest().upper()}" if ok else "unauthenticated")


def admit(rows, permits, factor, seconds=60):
    """Sequential simulation of both limits."""
    spent, spent_by_key, admitted = defaultdict(int), defaultdict(int), {}
    for row in sorted(rows, key=lambda r: (r["ts"], r["req_id"])):
        if row["path"] in ("/healthz", "/readyz"):
            admitted[row["req_id"]] = True
            continue
        window = int(row["ts"].timestamp()) // seconds
        if spent[window] >= permits * factor:
            admitted[row["req_id"]] = False
            continue
        spent[window] += 1
        if row["path"] not in (INGEST_PATH, FORGET_PATH):
            admitted[row["req_id"]] = True
            continue
        token = (row["authorization"] or "").removeprefix("Bearer ")
        key = (window, token if token in TOKENS else None)
        admitted[row["req_id"]] = spent_by_key[key] < permits
        spent_by_key[key] += admitted[row["req_id"]]
    return admitted


def test_admission_equals_a_sequential_limiter(spark):
    rng = random.Random(3)
    paths = [INGEST_PATH] * 6 + [FORGET_PATH, "/", "/healthz", "/readyz"]
    rows = [
        {
            "req_id": f"r{i:05d}",
            "ts": NOW + timedelta(seconds=rng.randrange(600)),
            "path": rng.choice(paths),
            "authorization": rng.choice(["Bearer alpha"] * 3 + ["Bearer beta", "Bearer nope", None]),
        }
        for i in range(1500)
    ]
    # One window of one key holds a third of everything.
    rows += [
        {"req_id": f"x{i:05d}", "ts": NOW + timedelta(seconds=60 + i % 60), "path": INGEST_PATH, "authorization": "Bearer no"}
        for i in range(750)
    ]
    options = Options(rate_permits=20, global_rate_factor=3)
    found = reqs.fixed_window_admission(log(spark, rows), DIGESTS, options)
    assert {r["req_id"]: r["admitted"] for r in found.collect()} == admit(rows, 20, 3)


def test_hot_window_is_pruned_before_the_shuffle(spark):
    df = log(spark, [{"req_id": "a", "ts": NOW, "path": INGEST_PATH}])
    plan = reqs.fixed_window_admission(df, DIGESTS, Options())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_outcomes(spark):
    good = {"path": INGEST_PATH, "authorization": "Bearer alpha", "content_type": "application/x-ndjson", "body": event_line()}
    ask = {"path": FORGET_PATH, "authorization": "Bearer beta", "content_type": "application/json"}
    guid = '{"installId":"550e8400-e29b-41d4-a716-446655440000"}'
    cases = [
        (good | {"idempotency_key": key_of(1)}, 200, None),
        (good | {"idempotency_key": key_of(1)}, 200, "duplicate"),
        (good | {"idempotency_key": key_of(9)}, 200, "duplicate"),  # in the ledger
        (good | {"idempotency_key": key_of(2), "authorization": None}, 401, "unauthenticated"),
        (good | {"idempotency_key": key_of(2), "authorization": "Bearer x", "content_type": "text/plain"}, 401, "unauthenticated"),
        (good | {"idempotency_key": key_of(2), "content_type": "text/plain"}, 415, "unsupported_media_type"),
        (good | {"idempotency_key": "short"}, 400, "bad_idempotency_key"),
        (good | {"idempotency_key": key_of(3), "body": "{bad"}, 400, "malformed_json"),
        (good | {"idempotency_key": key_of(3)}, 200, None),  # the refused one does not count
        (good | {"idempotency_key": key_of(4), "body": "\n".join(event_line(n) for n in range(4))}, 413, "too_many_lines"),
        (good | {"idempotency_key": key_of(5), "body": event_line(at="2026-07-04T12:00:00Z")}, 400, "future_timestamp"),
        (ask | {"body": guid}, 200, None),
        (ask | {"body": guid, "content_type": "text/plain"}, 415, "unsupported_media_type"),
        (ask | {"body": guid, "authorization": "Bearer x"}, 401, "unauthenticated"),
        (ask | {"body": "{}"}, 400, "bad_install_id"),
        ({"path": "/healthz"}, 200, None),
        ({"path": "/"}, 200, None),
        ({"path": "/nowhere"}, 404, "unknown_path"),
    ]
    rows = [case | {"req_id": f"{i:02d}", "ts": NOW + timedelta(seconds=i)} for i, (case, _, _) in enumerate(cases)]
    ledger = spark.createDataFrame([(key_of(9),)], "idempotency_key string")
    found = reqs.request_outcome(log(spark, rows), DIGESTS, Options(max_batch_lines=3), ledger, NOW)
    got = {r["req_id"]: (r["http_code"], r["reason"]) for r in found.collect()}
    assert got == {f"{i:02d}": (code, reason) for i, (_, code, reason) in enumerate(cases)}

    # Over the limit comes before everything else.
    limited = reqs.request_outcome(log(spark, rows[:4]), DIGESTS, Options(rate_permits=1), ledger, NOW)
    assert sorted((r["req_id"], r["http_code"]) for r in limited.collect()) == [("00", 200), ("01", 429), ("02", 429), ("03", 401)]
