"""Headline timings: python bench.py  (BENCH_SF_DIR, BENCH_CPUS) -> one JSON line.

Inputs are derived from the ``events`` table first and not timed. Each timed query does
its whole work: jobs write their tables, reports are fetched. A pass over the smallest
tables warms the JVM up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.operators import reports, requests, rollups
from runtally.plans import catalog, lifecycle
from runtally.plans.catalog import Fixture
from runtally.plans.ingest import ingest
from runtally.plans.store import Store
from runtally.session import build_session, scratch_path
from runtally.sources import landing
from runtally.streaming.ingest import stream_ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


class Bench:
    def __init__(self, spark, sf_dir: str):
        self.spark = spark
        self.fixture = Fixture(spark, sf_dir)
        self.times: dict[str, float] = {}

    def timed(self, name: str, action):
        start = time.perf_counter()
        result = action()
        self.times[name] = round(time.perf_counter() - start, 3)
        return result

    def new_store(self, label: str) -> Store:
        store = self.fixture.new_store(label)
        lifecycle.ensure_partitions(store, *catalog.REGISTERED)
        return store

    def stream(self, store: Store) -> None:
        batches = landing.read_batches(self.spark, self.fixture.raw_path, stream=True)
        checkpoint = scratch_path(self.spark, "checkpoint")
        stream_ingest(store, batches, checkpoint, catalog.INGEST_AS_OF).awaitTermination()

    def all(self) -> dict[str, float]:
        f = self.fixture
        f.raw_path, f.requests  # noqa: B018 - derive the inputs
        store = self.new_store("bench")
        self.timed("ingest", lambda: ingest(store, f.raw, catalog.INGEST_AS_OF))
        self.timed("ingest_replay", lambda: ingest(store, f.raw, catalog.INGEST_AS_OF))
        events = store.events
        self.timed("v_run_daily", lambda: run(rollups.run_daily(events())))
        self.timed("v_step_family_daily", lambda: run(rollups.step_family_daily(events())))
        self.timed("v_step_provider_daily", lambda: run(rollups.step_provider_daily(events())))
        self.timed("distinct_installs", lambda: run(rollups.distinct_installs(events())))
        self.timed("version_matrix", lambda: run(rollups.version_matrix(events())))
        self.timed("env_error_by_provider", lambda: run(rollups.env_error_by_provider(events())))
        self.timed("provider_ranking", lambda: run(rollups.usage_ranking(events(), "step_providers", "provider", 10)))
        self.timed("partition_inventory", lambda: run(reports.partition_inventory(events(), store.list_partitions())))

        digests = catalog.token_digests(self.spark)
        options = catalog.REQUEST_OPTIONS
        ledger = store.table("ingest_batch")
        slim = f.requests.select("req_id", "ts", "path", "authorization")
        self.timed(
            "fixed_window_admission", lambda: run(requests.fixed_window_admission(slim, digests, options))
        )
        self.timed(
            "request_outcome",
            lambda: run(requests.request_outcome(f.requests, digests, options, ledger, catalog.INGEST_AS_OF)),
        )

        installs = events().select("install_id").distinct()
        one_percent = installs.where(F.pmod(F.xxhash64("install_id"), F.lit(100)) == 0)
        store.request_forget(one_percent.withColumn("requested_at", F.lit(catalog.RETENTION_AS_OF)))
        self.timed("forget_drain", lambda: lifecycle.forget_drain(store, catalog.RETENTION_AS_OF))
        self.timed("remove_erased", lambda: lifecycle.remove_erased(store))
        self.timed("sweep_default", lambda: lifecycle.sweep_default(store, catalog.SWEEP_AS_OF))
        self.timed("drop_old_partitions", lambda: lifecycle.drop_old_partitions(store, catalog.DROP_AS_OF))
        self.timed("purge_ledger", lambda: lifecycle.purge_ledger(store, catalog.PURGE_AS_OF))

        streamed = self.new_store("stream")
        self.timed("stream_ingest", lambda: self.stream(streamed))
        return self.times


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        app="runtally-bench",
        **{
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        Bench(spark, small).all()
    bench = Bench(spark, SF_DIR)
    times = bench.all()
    lines = bench.fixture.raw.select(F.sum(F.size(F.split("body", "\n")))).first()[0]
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "lines_ingested": lines,
                "ingest_lines_per_sec": round(lines / times["ingest"]),
                "stream_lines_per_sec": round(lines / times["stream_ingest"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
