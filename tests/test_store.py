"""Ingest, both dedup layers, routing, retention, erasure and the maintenance cycle."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from conftest import NOW, batches, event_line, install, key_of
from pyspark.sql import functions as F

from runtally import Options, Store
from runtally.operators import forget, reports, rollups
from runtally.plans import lifecycle, stored_rollups
from runtally.plans.ingest import ingest


def outcomes(run):
    return {
        (r["idempotency_key"], r["outcome"], r["new_rows"])
        for r in run.results.select("idempotency_key", "outcome", "new_rows").collect()
    }


def installs(store):
    return sorted(r["install_id"] for r in store.events().select("install_id").collect())


def parts(store):
    return {r["part"]: r["n"] for r in store.events().groupBy("part").agg(F.count("*").alias("n")).collect()}


def at(day: date, hour: int = 12) -> str:
    return f"{day:%Y-%m-%d}T{hour:02d}:00:00Z"


def test_insert_then_same_key_then_other_key(spark, store):
    assert outcomes(ingest(store, batches(spark, (1, event_line())), NOW)) == {(key_of(1), "accepted", 1)}
    assert outcomes(ingest(store, batches(spark, (1, event_line())), NOW)) == {(key_of(1), "duplicate", 0)}
    # The key is trusted: another body under a known key is not looked at.
    assert outcomes(ingest(store, batches(spark, (1, event_line(5))), NOW)) == {(key_of(1), "duplicate", 0)}
    assert outcomes(ingest(store, batches(spark, (2, event_line())), NOW)) == {(key_of(2), "accepted", 0)}
    assert installs(store) == [install(1)]
    assert store.table("ingest_batch").count() == 2


def test_first_arrival_wins_within_a_run(spark, store):
    run = ingest(
        store,
        batches(
            spark,
            (1, event_line(tool="late"), NOW + timedelta(seconds=9)),
            (1, event_line(tool="early"), NOW),
            (2, [event_line(2, tool="first"), event_line(2, tool="second")], NOW + timedelta(seconds=1)),
            (3, event_line(2, tool="third"), NOW + timedelta(seconds=2)),
        ),
        NOW,
    )
    assert outcomes(run) == {
        (key_of(1), "accepted", 1), (key_of(1), "duplicate", 0), (key_of(2), "accepted", 1), (key_of(3), "accepted", 0),
    }
    assert sorted(r["tool_version"] for r in store.events().collect()) == ["early", "first"]


def test_identical_copies_count_once(spark, store):
    copy = (1, event_line(), NOW)
    assert sorted(o for _, o, _ in (tuple(r) for r in ingest(store, batches(spark, *[copy] * 4), NOW).results.select(
        "idempotency_key", "outcome", "new_rows").collect())) == ["accepted"] + ["duplicate"] * 3
    assert store.events().count() == 1
    assert store.table("ingest_batch").count() == 1


def test_versions_are_separate_events(spark, store):
    ingest(store, batches(spark, (1, [event_line(), event_line(version=2)])), NOW)
    assert store.events().count() == 2


def test_rejected_batch_leaves_a_reason_only(spark, store):
    run = ingest(store, batches(spark, (1, [event_line(), "{bad"]), (2, event_line(2))), NOW)
    assert outcomes(run) == {(key_of(1), "rejected", 0), (key_of(2), "accepted", 1)}
    assert [r["idempotency_key"] for r in store.table("ingest_batch").collect()] == [key_of(2)]
    logged = store.table("batch_verdict").collect()
    assert [(r["reason"], r["line_no"]) for r in logged] == [("malformed_json", 2)]


def test_interrupted_run_is_healed(spark, store):
    first = ingest(store, batches(spark, (1, event_line()), (2, event_line(2))), NOW)
    assert first.results.agg({"new_rows": "sum"}).first()[0] == 2
    other = Store(spark, f"t_{uuid.uuid4().hex[:10]}", store.options).create_tables()
    lifecycle.ensure_partitions(other, date(2026, 6, 20), date(2026, 7, 8))
    other.append("telemetry_event", store.table("telemetry_event"))  # died before the ledger
    again = ingest(other, batches(spark, (1, event_line()), (2, event_line(2))), NOW)
    assert {o for _, o, _ in outcomes(again)} == {"accepted"}
    assert other.events().count() == 2
    assert other.table("ingest_batch").count() == 2


def test_routing(spark, store):
    lines = [event_line(1, at(date(2026, 6, 28))), event_line(2, at(date(2025, 1, 1))), event_line(3, "2026-06-28T23:59:59.999999Z")]
    ingest(store, batches(spark, (1, lines)), NOW)
    assert parts(store) == {"20260628": 2, "default": 1}
    assert store.partition("default").count() == 1
    assert reports.default_backlog(store.events()).first()["rows"] == 1
    held = {r["part"]: r["rows"] for r in reports.partition_inventory(store.events(), store.list_partitions()).collect()}
    assert (held["default"], held["20260628"], held["20260627"], len(held)) == (1, 2, 0, 19)


def test_day_range_prunes_partitions(spark, store):
    lines = [event_line(n, at(date(2026, 6, 20 + n))) for n in range(5)] + [event_line(9, at(date(2026, 6, 1)))]
    ingest(store, batches(spark, (1, lines)), NOW)
    some = store.events(date(2026, 6, 21), date(2026, 6, 22))
    assert sorted(r["install_id"] for r in some.collect()) == [install(1), install(2)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_registry(spark, store):
    report = lifecycle.ensure_partitions(store, date(2026, 7, 6), date(2026, 7, 10))
    assert {(r["day"].day, r["state"]) for r in report.collect()} == {
        (6, "exists"), (7, "exists"), (8, "created"), (9, "created"),
    }
    assert lifecycle.ensure_partitions(store, date(2026, 7, 6), date(2026, 7, 6)).count() == 0
    assert lifecycle.ensure_partitions(store, date(2026, 7, 9), date(2026, 7, 6)).count() == 0
    assert lifecycle.ensure_partition(store, date(2026, 7, 10)).first()["state"] == "created"
    ingest(store, batches(spark, (1, event_line(1, at(date(2026, 6, 1))))), NOW)
    assert lifecycle.ensure_partition(store, date(2026, 6, 1)).first()["state"] == "conflict"
    assert "20260601" not in [r["part"] for r in store.list_partitions().collect()]
    names = [r["part"] for r in store.list_partitions().collect()]
    assert names == sorted(names) and "default" in names and "20260620" in names


@pytest.fixture
def aged(spark, tmp_path):
    """A store at a fixed day with events 89 to 92 days old and one in the default partition."""
    today = date(2026, 7, 1)
    store = Store(spark, f"t_{uuid.uuid4().hex[:10]}", Options(install_shards=2)).create_tables(str(tmp_path / "db"))
    lifecycle.ensure_partitions(store, today - timedelta(days=95), today + timedelta(days=7))
    lines = [event_line(age, at(today - timedelta(days=age))) for age in (0, 89, 90, 91, 92)]
    lines += [event_line(200, at(today - timedelta(days=200)))]
    ingest(store, batches(spark, (1, lines)), NOW)
    return store


def test_drop_keeps_day_90_and_drops_day_91(aged):
    assert lifecycle.drop_old_partitions(aged, NOW, 90) == 5  # days 91 to 95
    assert installs(aged) == [install(n) for n in (0, 89, 90, 200)]
    assert lifecycle.drop_old_partitions(aged, NOW, 90) == 0
    assert "20260401" not in [r["part"] for r in aged.list_partitions().collect()]
    assert "20260402" in [r["part"] for r in aged.list_partitions().collect()]


def test_dropped_day_can_be_registered_again(aged):
    lifecycle.drop_old_partitions(aged, NOW, 90)
    assert lifecycle.ensure_partition(aged, date(2026, 4, 1)).first()["state"] == "created"
    assert aged.partition("20260401").count() == 0


def test_sweep_is_strict_to_the_instant(spark, store):
    cutoff = NOW - timedelta(days=90)
    lines = [
        event_line(1, f"{cutoff:%Y-%m-%dT%H:%M:%S}Z"),
        event_line(2, f"{cutoff - timedelta(seconds=1):%Y-%m-%dT%H:%M:%S}Z"),
        event_line(3, at(date(2026, 6, 28))),
    ]
    ingest(store, batches(spark, (1, lines)), NOW)
    assert lifecycle.sweep_default(store, NOW, 90) == 1
    assert installs(store) == [install(1), install(3)]
    assert lifecycle.sweep_default(store, NOW + timedelta(seconds=1), 90) == 1
    assert lifecycle.sweep_default(store, NOW + timedelta(seconds=1), 90) == 0
    assert installs(store) == [install(3)]


def test_purge_ledger(spark, store):
    cutoff = NOW - timedelta(days=35)
    ingest(
        store,
        batches(
            spark,
            (1, event_line(1), cutoff),
            (2, event_line(2), cutoff - timedelta(microseconds=1)),
            (3, event_line(3), cutoff - timedelta(days=3)),
            (4, event_line(4), NOW),
        ),
        NOW,
    )
    assert lifecycle.purge_ledger(store, NOW, 35) == 2
    assert sorted(r["idempotency_key"] for r in store.table("ingest_batch").collect()) == [key_of(1), key_of(4)]


def ask(spark, store, *numbers, when=NOW):
    store.request_forget(spark.createDataFrame([(install(n), when) for n in numbers], "install_id string, requested_at timestamp"))


def state(store):
    return {r["install_id"]: r["processed_at"] is not None for r in store.forgets().collect()}


def test_erasure_empties_partitions_and_keeps_their_days(spark, store):
    lines = [event_line(1, at(date(2026, 6, 21))), event_line(1, at(date(2026, 6, 22))), event_line(2, at(date(2026, 6, 22)))]
    ingest(store, batches(spark, (1, lines), (2, event_line(2, at(date(2026, 6, 23))))), NOW)
    ask(spark, store, 1)
    assert lifecycle.forget_drain(store, NOW) == 1
    assert parts(store) == {"20260622": 1, "20260623": 1}
    assert installs(store) == [install(2), install(2)]
    assert [r["idempotency_key"] for r in store.ledger().collect()] == [key_of(2)]
    assert "20260621" in [r["part"] for r in store.list_partitions().collect()]
    assert state(store) == {install(1): True}
    # With its ledger row gone the same batch is taken in again.
    again = ingest(store, batches(spark, (1, lines)), NOW)
    assert outcomes(again) == {(key_of(1), "accepted", 2)}


def test_erasure_covers_late_events_but_not_later_ones(spark, store):
    ask(spark, store, 1)
    ingest(store, batches(spark, (1, event_line(1))), NOW)
    lifecycle.forget_drain(store, NOW + timedelta(hours=1))
    assert installs(store) == []
    ingest(store, batches(spark, (2, event_line(1))), NOW)
    assert lifecycle.forget_drain(store, NOW + timedelta(hours=2)) == 0
    assert installs(store) == [install(1)]
    ask(spark, store, 1, when=NOW + timedelta(hours=3))
    assert state(store) == {install(1): False}
    lifecycle.forget_drain(store, NOW + timedelta(hours=4))
    assert installs(store) == []


def test_batch_of_another_first_install_keeps_its_ledger_row(spark, store):
    ingest(store, batches(spark, (1, [event_line(2), event_line(1)])), NOW)
    ask(spark, store, 1)
    lifecycle.forget_drain(store, NOW)
    assert installs(store) == [install(2)]
    assert store.table("ingest_batch").count() == 1


def files(store, *tables):
    return {r[0] for t in tables for r in store.table(t).select("_metadata.file_path").distinct().collect()}


def test_a_drain_rewrites_no_file_and_hides_at_once(spark, store):
    tables = ("telemetry_event", "ingest_batch")
    ingest(store, batches(spark, (1, [event_line(n) for n in range(5)]), (2, event_line(7))), NOW)
    store.register_views()
    before = files(store, *tables)
    ask(spark, store, 0, 3, 7)
    assert lifecycle.forget_drain(store, NOW) == 3
    assert files(store, *tables) == before
    assert installs(store) == [install(n) for n in (1, 2, 4)]
    assert store.events_by_install(install(3)).count() == 0 and store.ledger().count() == 0
    assert spark.table("v_run_daily").first()["distinct_installs"] == 3  # registered before
    assert store.table("telemetry_event").count() == 6


def test_what_comes_after_a_drain_stays(spark, store):
    ingest(store, batches(spark, (1, [event_line(1), event_line(2)])), NOW)
    ask(spark, store, 1)
    lifecycle.forget_drain(store, NOW)
    # the erased rows are in the files still, yet they are no duplicates of the same batch
    assert outcomes(ingest(store, batches(spark, (1, [event_line(1), event_line(2)])), NOW)) == {(key_of(1), "accepted", 1)}
    assert installs(store) == [install(1), install(2)]
    assert outcomes(ingest(store, batches(spark, (1, [event_line(1)])), NOW)) == {(key_of(1), "duplicate", 0)}
    assert lifecycle.remove_erased(store) == 2  # an event and a ledger row
    assert installs(store) == [install(1), install(2)]
    assert store.table("telemetry_event").count() == 2 and store.leaves("erasure") == []
    assert lifecycle.remove_erased(store) == 0
    ask(spark, store, 1, when=NOW + timedelta(hours=1))
    lifecycle.forget_drain(store, NOW + timedelta(hours=1))
    assert installs(store) == [install(2)]


@pytest.mark.parametrize("step", ["append", "begin_generation", "drop_partitions"])
def test_erasure_is_repeated_after_a_crash(spark, store, monkeypatch, step):
    ingest(store, batches(spark, (1, [event_line(1), event_line(2)])), NOW)
    ask(spark, store, 1)

    def die(*_args, **_more):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Store, step, die)
        with pytest.raises(RuntimeError, match="lost"):
            lifecycle.forget_drain(store, NOW)
            lifecycle.remove_erased(store)
    if step == "drop_partitions":  # removed, and still hidden
        assert installs(store) == [install(2)]
    else:
        assert state(store) == {install(1): False}
        assert lifecycle.forget_drain(store, NOW) == 1
    lifecycle.remove_erased(store)
    assert installs(store) == [install(2)] and store.leaves("erasure") == []
    assert store.table("telemetry_event").count() == 1


def test_large_leaves_are_not_gathered_again(spark, store):
    for n in range(3):
        ingest(store, batches(spark, (n, event_line(n, "2026-06-25T12:00:00+00:00"))), NOW)
    day = date(2026, 6, 25)
    assert lifecycle.scattered_leaves(store, day, day).count() > 0
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")  # three files are large then
    try:
        assert lifecycle.compact_days(store, day, day) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert lifecycle.compact_days(store, day, day) > 0


def test_logs_are_trimmed(spark, store):
    old = NOW - timedelta(days=40)
    ingest(store, batches(spark, (1, event_line(1), old), (2, "{bad", old), (3, event_line(2)), (4, "{bad")), NOW, with_rollups=True)
    entries = store.table("rollup_log").count()
    lifecycle.maintenance_cycle(store, old)
    assert lifecycle.trim_logs(store, NOW) == 3
    assert store.table("ingest_result").count() == 2 and store.table("batch_verdict").count() == 1
    assert store.table("maintenance_run").count() == 0
    assert 0 < store.table("rollup_log").count() < entries
    assert stored_rollups.due_days(store) == []


def test_bounded_rounds_take_the_oldest(spark, store):
    ingest(store, batches(spark, (1, [event_line(n) for n in (1, 2, 3)])), NOW)
    for n, hours in [(1, 3), (2, 1), (3, 2)]:
        ask(spark, store, n, when=NOW + timedelta(hours=hours))
    assert lifecycle.forget_drain(store, NOW + timedelta(hours=5), limit=2) == 2
    assert installs(store) == [install(1)]
    assert [r["install_id"] for r in forget.pending_forgets(store.forgets()).collect()] == [install(1)]


def test_cycle_runs_in_order_and_isolates_failures(spark, aged):
    ask(spark, aged, 0)

    def broken() -> int:
        raise RuntimeError("no disk")

    run = lifecycle.maintenance_cycle(aged, NOW, {"sweep_default": broken})
    log = [(r["step"], r["ok"], r["rows"]) for r in run.collect()]
    assert log == [
        ("ensure_partitions", True, 0),
        ("drop_old_partitions", True, 5),
        ("sweep_default", False, None),
        ("forget_drain", True, 1),
        ("compact", True, 2),
        ("purge_ledger", True, 0),
        ("trim_logs", True, 0),
    ]
    assert installs(aged) == [install(n) for n in (89, 90, 200)]
    assert "no disk" in run.where("not ok").first()["error"]
    lifecycle.maintenance_cycle(aged, NOW + timedelta(days=1))
    assert installs(aged) == [install(89)]
    status = {r["step"]: (r["ok"], r["failures"]) for r in reports.maintenance_status(aged.table("maintenance_run")).collect()}
    assert status["sweep_default"] == (True, 1)
    assert status["drop_old_partitions"] == (True, 0)


def test_bootstrap_is_idempotent(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:10]}"
    now = datetime(2026, 7, 1, 8, tzinfo=timezone.utc)
    store = lifecycle.bootstrap(Store(spark, name, Options(install_shards=2)), now, str(tmp_path / "db"))
    days = [r["part"] for r in store.list_partitions().collect()]
    assert len(days) == 98 and days[0] == "20260402" and days[-2:] == ["20260707", "default"]
    ingest(store, batches(spark, (1, event_line())), NOW)
    lifecycle.bootstrap(store, now)
    assert len(store.list_partitions().collect()) == 98
    assert store.table("partition_log").count() == 97
    assert spark.table("v_run_daily").count() == 1
    assert spark.table("v_step_family_daily").collect()[0]["family"] == "http"
    assert spark.table("v_step_provider_daily").collect()[0]["n"] == 1


def test_forget_bodies(spark):
    good = "550e8400-e29b-41d4-a716-446655440000"
    cases = [
        ('{"installId":"550e8400-e29b-41d4-a716-446655440000"}', good),
        ('{"INSTALLID":"{550E8400-E29B-41D4-A716-446655440000}"}', good),
        ('{"other":1,"installId":" 550e8400e29b41d4a716446655440000 "}', good),
        ('{"installId":"x","InstallId":"550e8400-e29b-41d4-a716-446655440000"}', good),
        ('{"installId":"550e8400-e29b-41d4-a716-446655440000"} x', None),
        ('{"installId":"550e8400-e29b-41d4-a716-446655440000"}]', None),
        ('{"installId":""}', None),
        ('{"installId":"not-a-guid"}', None),
        ('{"installId":5}', None),
        ('{"installId":null}', None),
        ("{}", None),
        ("[]", None),
        ("null", None),
        ("{bad", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")
    found = df.select("i", forget.forget_install(F.col("body")).alias("id")).orderBy("i").collect()
    assert [r["id"] for r in found] == [c[1] for c in cases]


def stored_daily(store):
    return sorted(map(str, store.table("run_daily").drop("rollup_day").collect()))


def fresh_daily(store):
    return sorted(map(str, rollups.run_daily(store.events()).collect()))


def test_shard_count_belongs_to_the_store(spark, store):
    ingest(store, batches(spark, (1, [event_line(n) for n in range(6)])), NOW)
    assert Store(spark, store.database).install_shards == 2
    with pytest.raises(ValueError, match="2 install shards"):
        ingest(Store(spark, store.database, Options(install_shards=16)), batches(spark, (2, event_line())), NOW)
    with pytest.raises(ValueError):
        Store(spark, store.database, Options(install_shards=16)).create_tables()
    wider = lifecycle.reshard(store, 16)
    assert wider.install_shards == Store(spark, store.database).install_shards == 16
    assert installs(wider) == [install(n) for n in range(6)]
    assert outcomes(ingest(wider, batches(spark, (3, event_line(4))), NOW)) == {(key_of(3), "accepted", 0)}
    wider.request_forget(spark.createDataFrame([(install(3), NOW)], "install_id string, requested_at timestamp"))
    assert lifecycle.forget_drain(wider, NOW) == 1
    assert installs(wider) == [install(n) for n in (0, 1, 2, 4, 5)]
    assert [r["install_id"] for r in wider.events_by_install(install(4).upper()).collect()] == [install(4)]
    plan = wider.events_by_install(install(4))._jdf.queryExecution().executedPlan().toString()
    assert "shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert lifecycle.reshard(wider, 16).install_shards == 16


def test_lookup_of_an_install_skips_row_groups(spark, tmp_path):
    """Files are sorted by install, so that one row group of many may hold it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "4096")
    try:
        store = Store(spark, f"t_{uuid.uuid4().hex[:10]}", Options(install_shards=1)).create_tables(str(tmp_path / "db"))
        lifecycle.ensure_partitions(store, date(2026, 6, 28), date(2026, 6, 29))
        mixed = [n * 787 % 2000 for n in range(2000)]  # every install once, in no order
        sent = [(k, [event_line(n) for n in mixed[k * 200 : k * 200 + 200]]) for k in range(10)]
        ingest(store, batches(spark, *sent), NOW)
    finally:
        conf.unset("parquet.block.size")
    groups, holding = 0, 0
    for path in (tmp_path / "db").rglob("telemetry_event/**/*.parquet"):
        file = pq.ParquetFile(path)
        ids = file.read(["install_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        at = file.schema_arrow.get_field_index("install_id")
        for k in range(file.num_row_groups):
            seen = file.metadata.row_group(k).column(at).statistics
            groups += 1
            holding += seen.min <= install(1234) <= seen.max
    assert groups >= 4 and holding == 1
    found = store.events_by_install(install(1234))
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(install_id,{install(1234)})" in plan  # reaches the files
    shown = spark.sql(f"DESCRIBE EXTENDED {store.name('telemetry_event')}").where("col_name = 'Storage Properties'").first()
    assert "parquet.bloom.filter.enabled#install_id=true" in shown["data_type"]


def test_reshard_finishes_between_the_renames(spark, store):
    ingest(store, batches(spark, (1, [event_line(n) for n in range(4)])), NOW)
    lifecycle.reshard(store, 4)
    spark.sql(f"ALTER TABLE {store.name('telemetry_event')} RENAME TO {store.name('telemetry_event_resharded')}")
    opened = Store(spark, store.database)
    assert installs(lifecycle.reshard(opened, 4)) == [install(n) for n in range(4)]


def test_nothing_of_a_run_stays_in_staging(spark, store, tmp_path, monkeypatch):
    from runtally import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "scratch"))
    ingest(store, batches(spark, (1, [event_line(1), event_line(2)]), (2, "{bad")), NOW, with_rollups=True)
    store.request_forget(spark.createDataFrame([(install(1), NOW)], "install_id string, requested_at timestamp"))
    lifecycle.maintenance_cycle(store, NOW)

    def fail(*_):
        raise RuntimeError("no disk")

    with monkeypatch.context() as broken:
        broken.setattr(Store, "append", fail)
        with pytest.raises(RuntimeError, match="no disk"):
            ingest(store, batches(spark, (3, event_line(1))), NOW)
    left = [p for p in (tmp_path / "scratch").rglob("*") if p.is_file()]
    assert not left


def test_stored_rollups_follow_the_store(spark, aged):
    lines = [event_line(n, at(date(2026, 6, 28))) for n in range(1, 5)]
    ingest(aged, batches(spark, (2, lines)), NOW, with_rollups=True)
    stored_rollups.mark_due(aged, aged.doomed_days(lambda df: df.withColumn("_doomed", F.lit(True))))
    stored_rollups.refresh_due(aged)
    assert stored_daily(aged) == fresh_daily(aged)
    aged.request_forget(spark.createDataFrame([(install(2), NOW), (install(89), NOW)], "install_id string, requested_at timestamp"))
    lifecycle.forget_drain(aged, NOW)
    assert stored_daily(aged) == fresh_daily(aged)
    # install 89 was alone on its day: no partition of that day is left
    assert "20260403" not in {leaf["rollup_day"] for leaf in aged.leaves("run_daily")}
    lifecycle.drop_old_partitions(aged, NOW, 90)
    lifecycle.sweep_default(aged, NOW)
    assert stored_daily(aged) == fresh_daily(aged)
    assert stored_rollups.due_days(aged) == []


def test_a_run_that_died_before_its_rollups_is_healed(spark, store, monkeypatch):
    def fail(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(stored_rollups, "refresh_due", fail)
        with pytest.raises(RuntimeError, match="executor lost"):
            ingest(store, batches(spark, (1, event_line(1))), NOW, with_rollups=True)
    assert store.events().count() == 1 and store.table("run_daily").count() == 0
    ingest(store, batches(spark, (1, event_line(1))), NOW, with_rollups=True)
    assert store.table("run_daily").count() == 1 and stored_daily(store) == fresh_daily(store)
    # the replayed arrival counts once
    assert [(r["outcome"], r["new_rows"]) for r in store.outcomes().collect()] == [("accepted", 1)]


def test_batches_and_erasures_add_to_the_partials_of_their_days(spark, store, monkeypatch):
    ingest(store, batches(spark, (1, [event_line(n, startup=n) for n in (1, 2, 3)])), NOW, with_rollups=True)

    def never(*_):
        raise AssertionError("events of earlier batches are read")

    monkeypatch.setattr(stored_rollups, "rebuild", never)
    more = [event_line(n, "2026-06-28T13:00:00+00:00", startup=n) for n in (2, 4)]
    ingest(store, batches(spark, (2, more), (3, event_line(1, startup=1))), NOW, with_rollups=True)
    assert stored_daily(store) == fresh_daily(store)
    ask(spark, store, 2, 3)
    lifecycle.forget_drain(store, NOW)
    assert stored_daily(store) == fresh_daily(store)
    day = store.table("run_daily").first()
    assert (day["events"], day["distinct_installs"], day["startup_ms_p50"]) == (2, 2, 2.5)
    families = rollups.step_family_daily(store.events()).collect()
    assert store.table("step_family_daily").drop("rollup_day").collect() == families
    rows = store.table("rollup_partial").count()
    assert stored_rollups.compact(store) == 1 and store.table("rollup_partial").count() < rows
    stored_rollups.refresh(store, [date(2026, 6, 28)])
    assert stored_daily(store) == fresh_daily(store)
    ask(spark, store, 1, 4)
    lifecycle.forget_drain(store, NOW)
    assert store.table("run_daily").count() == 0 and store.leaves("rollup_partial") == []


def test_a_run_without_rollups_leaves_its_days_due(spark, store):
    day = date(2026, 6, 28)
    ingest(store, batches(spark, (1, event_line(1))), NOW, with_rollups=True)
    ingest(store, batches(spark, (2, event_line(2))), NOW)
    assert stored_rollups.due_days(store) == [day]
    ingest(store, batches(spark, (3, event_line(3))), NOW, with_rollups=True)
    assert stored_daily(store) == fresh_daily(store) and stored_rollups.due_days(store) == []


def test_views_prune_by_day(spark, store):
    lines = [event_line(n, at(date(2026, 6, 20 + n))) for n in range(5)] + [event_line(9, at(date(2026, 6, 1)))]
    ingest(store, batches(spark, (1, lines)), NOW)
    store.register_views()
    for view in ("v_run_daily", "v_step_family_daily", "v_step_provider_daily"):
        found = spark.sql(f"SELECT * FROM {view} WHERE day >= TIMESTAMP '2026-06-23'")
        assert sorted(r["day"].day for r in found.collect()) == [23, 24]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "part#" in plan
        scans = [s.split("]")[0] for s in found._jdf.queryExecution().sparkPlan().toString().split("PartitionFilters: [")[1:]]
        events = [s for s in scans if "upto#" not in s]  # the others read tombstones
        assert events and all("part#" in s for s in events)
        assert any("to_date" in s or "gettimestamp" in s or "2026-06-23" in s for s in scans)
    assert spark.sql("SELECT * FROM v_run_daily").count() == 6


def test_store_refuses_another_time_zone(spark, store):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(RuntimeError, match="UTC"):
            Store(spark, store.database)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_whole_error_of_a_failed_step_is_kept(spark, store):
    def fail():
        raise RuntimeError("x" * 900)

    run = lifecycle.maintenance_cycle(store, NOW, {"sweep_default": fail})
    assert len(run.where("not ok").first()["error"]) == len("RuntimeError: ") + 900


def test_oversized_forget_body(spark):
    body = '{"installId":"550e8400-e29b-41d4-a716-446655440000"}' + " " * 200
    rows = spark.createDataFrame([("application/json", body, NOW)], "content_type string, body string, ts timestamp")
    assert forget.parse_forget(rows).count() == 1
    assert forget.parse_forget(rows, Options(max_body_bytes=100)).count() == 0
    assert rows.select(forget.forget_fault(Options(max_body_bytes=100))).first()[0] == "body_too_large"


def test_compaction_keeps_rows_and_leaves_one_file(spark, store):
    for n in range(4):
        ingest(store, batches(spark, (n, [event_line(n), event_line(10 + n)])), NOW)
    before = installs(store)
    day = date(2026, 6, 28)
    assert lifecycle.compact_days(store, day, day) == 2
    assert installs(store) == before and lifecycle.scattered_leaves(store, day, day).count() == 0
    assert lifecycle.compact_days(store, day, day) == 0
