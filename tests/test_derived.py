from __future__ import annotations

from datetime import datetime

from runtally.sources import derived


def test_runs_gather_a_user_day_in_one_list(spark):
    at = datetime(2024, 1, 9, 10, 0)
    rows = [
        (0, at, 7, "view", 1.5, '{"k": 4}'),
        (1, at.replace(hour=11), 7, "view", 2.5, '{"k": 4}'),
        (2, at.replace(hour=9), 7, "view", 0.5, '{"k": 5}'),
        (3, at, 7, "error", 9.0, '{"k": 3}'),
        (4, at, 7, "other", 1.0, '{"k": 3}'),
        (5, at.replace(day=10), 7, "signup", 1.0, '{"k": 3}'),
    ]
    columns = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    runs = derived.derive_runs(spark.createDataFrame(rows, columns))
    first, second = runs.orderBy("day").collect()
    assert first["event_timestamp"] == at.replace(hour=11)
    assert first["scenario_count"] == 3
    assert (first["step_pass"], first["step_fail"], first["step_env_error"], first["step_inconclusive"]) == (3, 0, 1, 0)
    assert (first["scenario_pass"], first["scenario_fail"], first["scenario_env_error"]) == (1, 0, 1)
    assert first["step_families"] == {"error": 1, "other": 1, "view": 3}
    assert first["step_providers"] == {"error.p0": 1, "other.p0": 1, "view.p1": 2, "view.p2": 1}
    assert (first["startup_ms"], first["time_to_first_test_ms"]) == (50, 140)
    assert (second["scenario_inconclusive"], second["step_families"]) == (1, {"signup": 1})
    # lists are gathered once, by their two phases
    plan = runs._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate(") == 2
