from __future__ import annotations

import os
import sys
import uuid
from datetime import date, datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runtally import Options, Store, build_session  # noqa: E402
from runtally.plans import lifecycle  # noqa: E402

NOW = datetime(2026, 7, 1, 12, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        app="runtally-tests",
        **{
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "3",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    """An empty store whose days from 2026-06-20 to 2026-07-07 are registered."""
    made = Store(spark, f"t_{uuid.uuid4().hex[:10]}", Options(install_shards=2)).create_tables(str(tmp_path / "db"))
    lifecycle.ensure_partitions(made, date(2026, 6, 20), date(2026, 7, 8))
    return made


def key_of(n: int) -> str:
    return f"{n:064x}"


def install(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012d}"


def event_line(
    n: int = 1, at: str = "2026-06-28T12:00:00+00:00", version: int = 1, tool: str = "1.0.0", startup: int = 100
) -> str:
    return (
        f'{{"schemaVersion":{version},"timestamp":"{at}","installId":"{install(n)}","toolVersion":"{tool}",'
        '"engineVersion":"1.0.0","dotnetVersion":".NET 8.0.7","runCount":1,"scenarioCount":1,'
        '"stepVerdicts":{"pass":1,"fail":0,"envError":0,"inconclusive":0},'
        '"scenarioVerdicts":{"pass":1,"fail":0,"envError":0,"inconclusive":0},'
        f'"stepFamilies":{{"http":1}},"stepProviders":{{"http.rest":1}},"startupMs":{startup},"timeToFirstTestMs":200}}'
    )


def batches(spark, *rows):
    """Raw batches from (key number, lines or body[, received_at])."""
    made = []
    for i, row in enumerate(rows):
        key, body, *rest = row
        made.append(
            (
                key if key is None or isinstance(key, str) else key_of(key),
                "application/x-ndjson",
                rest[0] if rest else NOW + timedelta(seconds=i),
                body if body is None or isinstance(body, str) else "\n".join(body),
            )
        )
    return spark.createDataFrame(
        made, "idempotency_key string, content_type string, received_at timestamp, body string"
    )
