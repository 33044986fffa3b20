from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import NOW, batches, event_line, install

from runtally.operators import rollups
from runtally.plans.ingest import ingest
from runtally.sources import landing
from runtally.streaming.ingest import dedup_within_window, stream_ingest

COLUMNS = "idempotency_key", "content_type", "received_at", "body"


def land(spark, path, *rows):
    batches(spark, *rows).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(tuple(map(str, row)) for row in df.select(*sorted(df.columns)).collect())


def test_stream_fills_store_and_refreshes_touched_days(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")

    def run():
        stream = landing.read_batches(spark, source, stream=True, max_files=1)
        stream_ingest(store, stream, checkpoint, NOW).awaitTermination()

    land(spark, source, (1, [event_line(1), event_line(2, "2026-06-29T01:00:00Z")]))
    land(spark, source, (1, [event_line(1), event_line(2, "2026-06-29T01:00:00Z")]), (2, "{bad"))
    run()
    assert store.events().count() == 2
    before = {r["day"].day: r["events"] for r in store.table("run_daily").collect()}
    assert before == {28: 1, 29: 1}
    land(spark, source, (3, [event_line(3), event_line(1), event_line(9, "2020-01-01T00:00:00Z")]))
    run()
    assert {r["day"].day: r["events"] for r in store.table("run_daily").collect()} == {28: 2, 29: 1, 1: 1}
    assert rows_of(store.table("run_daily").drop("rollup_day")) == rows_of(rollups.run_daily(store.events()))
    assert rows_of(store.table("step_provider_daily").drop("rollup_day")) == rows_of(
        rollups.step_provider_daily(store.events())
    )
    # Late events are kept: in the default partition when their day is not registered.
    assert [r["install_id"] for r in store.partition("default").collect()] == [install(9)]


def test_replayed_stream_adds_nothing(spark, store, tmp_path):
    source = str(tmp_path / "in")
    land(spark, source, (1, event_line(1)), (2, event_line(2)))
    for attempt in range(2):  # a new checkpoint replays everything
        stream = landing.read_batches(spark, source, stream=True)
        stream_ingest(store, stream, str(tmp_path / f"ck{attempt}"), NOW, with_rollups=False).awaitTermination()
    assert store.events().count() == 2
    assert store.table("ingest_batch").count() == 2


def test_many_micro_batches_see_each_other(spark, store, tmp_path):
    source = str(tmp_path / "in")
    assert store.events().count() == 0  # this session has the empty tables in its cache
    for i in range(5):
        again = [event_line(n) for n in range(i)]
        land(spark, source, (100 + i, [*again, event_line(i), event_line(50 + i, f"2026-06-2{i}T01:00:00Z")]), (7, event_line(7)))
    stream = landing.read_batches(spark, source, stream=True, max_files=1)
    stream_ingest(store, stream, str(tmp_path / "ck"), NOW).awaitTermination()
    found = sorted(r["install_id"] for r in store.events().collect())
    assert found == sorted(install(n) for n in [*range(5), 7, *range(50, 55)])
    assert store.table("ingest_batch").count() == 6
    assert rows_of(store.table("run_daily").drop("rollup_day")) == rows_of(rollups.run_daily(store.events()))


def test_dedup_within_window(spark, tmp_path):
    source = str(tmp_path / "in")
    land(spark, source, (1, "a", NOW), (2, "b", NOW))
    land(spark, source, (1, "a", NOW + timedelta(days=19)), (3, "c", NOW + timedelta(days=20)))
    stream = dedup_within_window(landing.read_batches(spark, source, stream=True, max_files=1))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    kept = spark.read.schema("idempotency_key string, body string").parquet(str(tmp_path / "out")).collect()
    assert sorted(r["body"] for r in kept) == ["a", "b", "c"]


def test_keys_leave_the_window_and_return(spark, tmp_path):
    source = str(tmp_path / "in")

    def run():
        stream = dedup_within_window(landing.read_batches(spark, source, stream=True), days=2)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return query.lastProgress

    days = [(0, 1), (0.5, 1), (5, 2), (9, 1), (9.5, 1), (3, 3)]  # the last is older than the watermark
    for n, (after, key) in enumerate(days):
        land(spark, source, (key, f"body {n}", NOW + timedelta(days=after)))
        last = run()
    kept = spark.read.schema("body string").parquet(str(tmp_path / "out")).collect()
    assert sorted(r["body"] for r in kept) == ["body 0", "body 2", "body 3"]
    state = last["stateOperators"][0]
    assert state["numRowsTotal"] == 1 and any(name.startswith("rocksdb") for name in state["customMetrics"])


def test_loaded_files_are_archived(spark, store, tmp_path):
    source, archive = tmp_path / "landing", tmp_path / "archive"

    def run():
        stream = landing.read_batches(spark, str(source), stream=True, max_bytes=1 << 20, archive=str(archive))
        stream_ingest(store, stream, str(tmp_path / "ck"), NOW, with_rollups=False).awaitTermination()

    land(spark, str(source), (1, event_line(1)))
    first = {p.name for p in source.glob("*.parquet")}
    run()
    land(spark, str(source), (2, event_line(2)))
    run()
    assert {p.name for p in archive.rglob("*.parquet")} == first
    assert len(list(source.glob("*.parquet"))) == 1
    assert sorted(r["install_id"] for r in store.events().collect()) == [install(1), install(2)]
    with pytest.raises(ValueError, match="files or by bytes"):
        landing.read_batches(spark, str(source), stream=True, max_files=1, max_bytes=1 << 20)


def test_body_files(spark, store, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / f"{'a' * 64}.ndjson").write_text(event_line(1) + "\r\n" + event_line(2) + "\n")
    (folder / f"{'b' * 64}.json").write_text(event_line(3))
    rows = {r["idempotency_key"]: r for r in landing.read_body_files(spark, str(folder)).collect()}
    assert rows["a" * 64]["content_type"] == "application/x-ndjson" and rows["a" * 64]["received_at"]
    stream = landing.read_body_files(spark, str(folder), stream=True)
    stream_ingest(store, stream, str(tmp_path / "ck"), NOW, with_rollups=False).awaitTermination()
    assert sorted(r["install_id"] for r in store.events().collect()) == [install(1), install(2)]
    assert [r["http_code"] for r in store.table("batch_verdict").collect()] == [415]


def test_one_landed_file_is_judged_on_all_cores(spark, store, tmp_path, monkeypatch):
    source, tasks = str(tmp_path / "in"), []
    land(spark, source, *[(i, event_line(i)) for i in range(50)])

    def judged(local, rows, *rest):
        tasks.append(rows.rdd.getNumPartitions())
        return ingest(local, rows, *rest)

    monkeypatch.setattr("runtally.streaming.ingest.ingest", judged)
    stream = landing.read_batches(spark, source, stream=True, max_files=1)
    stream_ingest(store, stream, str(tmp_path / "ck"), NOW, with_rollups=False).awaitTermination()
    assert tasks == [spark.sparkContext.defaultParallelism]
    assert store.events().count() == 50
