from __future__ import annotations

import random
from datetime import date, datetime

import numpy as np
import pytest
from conftest import NOW, batches, event_line, install
from pyspark.sql import functions as F

from runtally.operators import reports, rollups
from runtally.plans import catalog, lifecycle, stored_rollups
from runtally.plans.ingest import ingest
from runtally.session import prepare


def exact(values, p):
    return float(np.percentile(np.array(values, dtype="float64"), p * 100))


@pytest.mark.parametrize(
    "values",
    [
        [5],
        [1, 2],
        [0, 0, 0, 0, 7],
        [-5, -4, 0, 3, 3, 3, 9],
        list(range(5000)),
        [2**62, -(2**62), 0, 1, 2**40],
        [-(2**63), 2**63 - 1],
        [1000] * 900 + [10**9 + i for i in range(100)],
    ],
)
def test_percentiles_of_special_groups(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v bigint")
    row = rollups.timing_percentiles(df, ["g"], ["v"]).first()
    assert row["v_p50"] == pytest.approx(exact(values, 0.5), rel=1e-12)
    assert row["v_p95"] == pytest.approx(exact(values, 0.95), rel=1e-12)


def test_percentiles_of_random_groups(spark):
    rng = random.Random(7)
    rows = []
    for group in range(40):
        span = 10 ** rng.randint(0, 9)
        rows += [(group, rng.randint(-span // 10, span), rng.randint(0, 3)) for _ in range(rng.randint(1, 400))]
    df = spark.createDataFrame(rows, "g int, a bigint, b bigint")
    ours = {r["g"]: r for r in rollups.timing_percentiles(df, ["g"], ["a", "b"]).collect()}
    built_in = df.groupBy("g").agg(
        F.expr("percentile(a, array(0.5, 0.95))").alias("a"), F.expr("percentile(b, array(0.5, 0.95))").alias("b")
    )
    for r in built_in.collect():
        mine = ours[r["g"]]
        assert [mine["a_p50"], mine["a_p95"], mine["b_p50"], mine["b_p95"]] == pytest.approx([*r["a"], *r["b"]], rel=1e-9)
    assert len(ours) == 40


def test_views(spark, store):
    lines = [
        event_line(1, "2026-06-28T00:00:00Z", startup=100),
        event_line(1, "2026-06-28T23:59:59Z", startup=200),
        event_line(2, "2026-06-28T10:00:00Z", startup=400).replace('{"http":1}', "{}"),
        event_line(2, "2026-06-29T00:00:00+02:00", startup=1000),
        event_line(3, "2026-06-29T00:00:00Z").replace('"http":1', '"http":4,"script":2'),
        event_line(4, "2020-01-01T00:00:00Z"),
    ]
    ingest(store, batches(spark, (1, lines)), NOW)
    store.register_views()
    daily = {r["day"].date(): r for r in spark.table("v_run_daily").collect()}
    busy = daily[date(2026, 6, 28)]
    assert (busy["events"], busy["runs"], busy["distinct_installs"], busy["step_pass"]) == (4, 4, 2, 4)
    assert (busy["startup_ms_p50"], busy["startup_ms_p95"]) == (300.0, pytest.approx(910.0))
    assert len(daily) == 3 and len(spark.table("v_run_daily").columns) == 17
    families = {(r["day"].date(), r["family"]): r["n"] for r in spark.table("v_step_family_daily").collect()}
    assert families == {
        (date(2026, 6, 28), "http"): 3, (date(2026, 6, 29), "http"): 4, (date(2026, 6, 29), "script"): 2,
        (date(2020, 1, 1), "http"): 1,
    }
    store.register_views(date(2026, 6, 29), date(2026, 6, 30))
    assert [r["events"] for r in spark.table("v_run_daily").collect()] == [1]


def test_kept_views(spark, store):
    """Another session reads the views without a call; they follow the tables and erasures."""
    store.create_views()
    lines = [event_line(n, f"2026-06-{20 + n % 4}T0{n % 7}:00:00Z", startup=n * n) for n in range(40)]
    lines += [event_line(n, "2020-01-01T00:00:00Z") for n in range(3)]
    ingest(store, batches(spark, (1, lines)), NOW)
    kept = {
        "v_run_daily": rollups.run_daily,
        "v_step_family_daily": rollups.step_family_daily,
        "v_step_provider_daily": rollups.step_provider_daily,
    }

    def check():
        other = prepare(spark.newSession())
        for view, rollup in kept.items():
            found, right = other.table(store.name(view)), rollup(store.events())
            assert found.schema.names == right.schema.names
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, right.collect()))

    check()
    store.request_forget(spark.createDataFrame([(install(5), NOW), (install(8), NOW)], "install_id string, requested_at timestamp"))
    lifecycle.forget_drain(store, NOW)
    assert store.events().count() == 41
    check()
    found = spark.sql(f"SELECT * FROM {store.name('v_run_daily')} WHERE day = TIMESTAMP '2026-06-21'")
    assert [r["day"].day for r in found.collect()] == [21]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    scans = [s.split("]")[0] for s in plan.split("PartitionFilters: [")[1:]]
    dated = [s for s in scans if "to_date" in s or "gettimestamp" in s or "2026-06-21" in s]
    assert dated and all("part#" in s for s in dated)
    # an old definition is replaced, not an error
    store.create_views()


def test_installs_over_periods(spark, store):
    day = [20, 21, 22, 23, 29]  # a Saturday, a Sunday, the next Monday and Tuesday, and the Monday after
    lines = [event_line(n, f"2026-06-{day[k]}T01:00:00Z") for n in range(60) for k in range(5) if (n + k) % 2 or n < 10]
    ingest(store, batches(spark, (1, lines)), NOW, with_rollups=True)
    count = lambda period, exact: {
        (r["start"].month, r["start"].day): r["distinct_installs"]
        for r in stored_rollups.distinct_installs(store, period, exact).collect()
    }
    assert count("week", True) == {(6, 15): 60, (6, 22): 60, (6, 29): 35}
    assert count("month", True) == {(6, 1): 60}
    for period in ("day", "week", "month"):
        assert count(period, False) == pytest.approx(count(period, True), rel=0.032)
    store.request_forget(spark.createDataFrame([(install(n), NOW) for n in range(20)], "install_id string, requested_at timestamp"))
    lifecycle.forget_drain(store, NOW)
    assert count("month", True) == {(6, 1): 40} and count("month", False) == pytest.approx({(6, 1): 40}, rel=0.032)
    with pytest.raises(ValueError, match="period"):
        stored_rollups.distinct_installs(store, "decade")


def test_approximate_installs_are_close(spark, store):
    lines = [event_line(n, "2026-06-28T00:00:00Z") for n in range(400)]
    ingest(store, batches(spark, (1, lines)), NOW)
    assert rollups.distinct_installs(store.events()).first()["distinct_installs"] == 400
    assert rollups.distinct_installs_approx(store.events()).first()["distinct_installs"] == pytest.approx(400, rel=0.1)


def test_taxonomy_audit_and_ranking(spark, store):
    lines = [event_line(1), event_line(2).replace('"http":1', '"acme":5,"custom":1'), event_line(3).replace('"http":1', '"acme":1')]
    ingest(store, batches(spark, (1, lines)), NOW)
    assert [tuple(r) for r in reports.audit_taxonomy(store.events()).collect()] == [("acme", 2, 6)]
    top = rollups.usage_ranking(store.events(), "step_families", "family", 1).collect()
    assert [(r["family"], r["n"]) for r in top] == [("acme", 6)]
    assert reports.events_by_install(store.events(), "00000000-0000-4000-8000-000000000002").count() == 1


def test_taxonomy_query_reports_every_stored_family(spark, tmp_path):
    at = datetime(2024, 1, 12, 9)
    kinds = ["view", "click", "purchase", "error", "signup"]
    rows = [(i, at, user, kind, 1.0, '{"k": 1}') for i, (user, kind) in enumerate((u, k) for u in (1, 2) for k in kinds)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    found = {tuple(r) for r in catalog.QUERIES["audit_taxonomy"](spark, str(tmp_path)).collect()}
    assert found == {(kind, 2, 2) for kind in kinds}


def test_rollups_scan_only_what_they_need(spark, store):
    plan = rollups.step_family_daily(store.events())._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "step_families" in schema and "event_timestamp" in schema
    assert "step_providers" not in schema and "startup_ms" not in schema
