"""Stored copies of the dashboard rollups, kept in step with the event table.

Beside each stored day lie its *partials*: signed counts that add up, namely the sums, the uses of
families and providers, the events per install, and how often each timing occurs. A batch adds the
partials of its own events, an erasure subtracts those of the erased ones, and the rollups of a day
are read from its partials: exact percentiles from the counted values, distinct installs from the
installs whose count is not zero. Events of earlier batches are not read again.

A job that changes events first logs the days it is about to change as due, and refreshes the
due days when it is done. A job that dies in between leaves them due, and the next one rebuilds
their partials from the events, as it does for days that have none yet.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.operators import rollups
from runtally.plans.store import Store
from runtally.schema import DEFAULT_PART
from runtally.session import staging

#: Stored rollup -> how it is read from the partials of some days.
ROLLUPS = {
    "run_daily": rollups.run_daily_of,
    "step_family_daily": lambda partials: rollups.usage_daily_of(partials, "family"),
    "step_provider_daily": lambda partials: rollups.usage_daily_of(partials, "provider"),
    "install_sketch": rollups.install_sketches_of,
}


def next_version(store: Store, table: str) -> int:
    last = store.table(table).agg(F.max("version")).first()[0]
    return (last or 0) + 1


def _log(store: Store, days: Iterable[date], due: bool) -> None:
    version = next_version(store, "rollup_log")
    rows = [(day, due, version) for day in days]
    store.append("rollup_log", store.spark.createDataFrame(rows, "day date, due boolean, version bigint").coalesce(1))


def stored_days(store: Store) -> set[date]:
    """Days that have partials."""
    stored = {leaf["rollup_day"] for leaf in store.leaves("rollup_partial")}
    return {date(int(d[:4]), int(d[4:6]), int(d[6:])) for d in stored}


def kept_days(store: Store) -> set[date]:
    """Days that have stored rollups or are due."""
    return stored_days(store) | set(due_days(store))


def due_days(store: Store) -> list[date]:
    last = store.table("rollup_log").groupBy("day").agg(F.max_by("due", "version").alias("due"))
    return sorted(row["day"] for row in last.where("due").collect())  # calendar days


def trim_log(store: Store) -> None:
    """Keep the latest entry of each day alone: one row per calendar day."""
    log = store.table("rollup_log")
    if log.count() > log.select("day").distinct().count():
        with staging(store.spark, "rollup-log") as keep:
            last = log.groupBy("day").agg(F.max_by("due", "version").alias("due"), F.max("version").alias("version"))
            store.replace_partitions("rollup_log", keep(last, "last").coalesce(1))


def mark_due(store: Store, days: Iterable[date], only_kept: bool = False) -> None:
    """Log days as due; with ``only_kept`` those alone that have stored rollups."""
    days = set(days)
    if days and only_kept:
        days &= kept_days(store)
    if days:
        _log(store, sorted(days), True)


def _parts(days: Iterable[date]) -> list[str]:
    return [f"{day:%Y%m%d}" for day in days]


def _of_days(events: DataFrame, sign: int) -> DataFrame:
    """The partials of some events, added or subtracted."""
    summed = rollups.partials(events, sign)
    return summed.withColumn("rollup_day", F.date_format("day", "yyyyMMdd"))


def begin(store: Store, days: Iterable[date]) -> list[date]:
    """Before events of ``days`` change: log them as due. Returns those whose partials are right, so
    that the change can be added to them; the others are rebuilt when they are refreshed."""
    days, stale = sorted(set(days)), set(due_days(store))
    right = stored_days(store) - stale
    mark_due(store, days)
    return [day for day in days if day in right]


def add(store: Store, changed: DataFrame, days: list[date], sign: int = 1) -> None:
    """Add (or with ``sign`` -1 subtract) events to the partials of those of ``days``."""
    if days:
        store.append("rollup_partial", _of_days(changed.where(F.to_date("event_timestamp").isin(days)), sign))


def rebuild(store: Store, days: list[date]) -> None:
    """Make the partials of some days anew from the event table: their partitions and the default
    one are read."""
    day = F.to_date("event_timestamp")
    scope = store.visible("telemetry_event").where(F.col("part").isin([*_parts(days), DEFAULT_PART]))
    store.replace_partitions("rollup_partial", _of_days(scope.where(day.isin(days)), 1))
    # an overwrite leaves days without events as they were
    filled = {row[0] for row in scope.where(day.isin(days)).select(day).distinct().collect()}
    _drop(store, "rollup_partial", [d for d in days if d not in filled])


def _drop(store: Store, table: str, days: Iterable[date]) -> None:
    written = {leaf["rollup_day"] for leaf in store.leaves(table)}
    store.drop_partitions(table, [{"rollup_day": part} for part in _parts(days) if part in written])


def refresh_due(store: Store, added: Iterable[date] = ()) -> list[date]:
    """Refresh the rollups of all due days; the partials of ``added`` are right already, those of the
    others are rebuilt."""
    days = due_days(store)
    if days:
        wrong = sorted(set(days) - set(added))
        if wrong:
            rebuild(store, wrong)
        refresh(store, days)
        _log(store, days, False)
    return days


def refresh(store: Store, days: list[date]) -> None:
    """Read the stored rollups of some days from their partials; those without events are dropped."""
    with staging(store.spark, "rollups") as keep:
        held = store.table("rollup_partial").where(F.col("rollup_day").isin(_parts(days)))
        summed = keep(rollups.added_up(held), "summed")
        filled = {row[0] for row in summed.where("kind = 'total'").select(F.to_date("day")).distinct().collect()}
        for table, rollup in ROLLUPS.items():
            rows = rollup(summed).withColumn("rollup_day", F.date_format("day", "yyyyMMdd"))
            store.replace_partitions(table, rows)
            _drop(store, table, [day for day in days if day not in filled])
    _drop(store, "rollup_partial", [day for day in days if day not in filled])


def distinct_installs(store: Store, period: str, exact: bool = False) -> DataFrame:
    """(start, distinct_installs) per day, week, month, quarter or year of the stored days.

    Estimated from the daily sketches, or counted from the partials. Erased installs are in
    neither once their erasure was drained.
    """
    if exact:
        return rollups.installs_of_partials(store.table("rollup_partial"), period)
    return rollups.installs_of_sketches(store.table("install_sketch"), period)


def compact(store: Store) -> int:
    """Add up the partials of each day that lie in several files; returns the days rewritten."""
    rows = store.table("rollup_partial")
    files = rows.select("rollup_day", F.col("_metadata.file_path").alias("file")).distinct().groupBy("rollup_day")
    days = [r["rollup_day"] for r in files.agg(F.count("*").alias("n")).where("n > 1").collect()]  # calendar days
    if days:
        summed = rollups.added_up(rows.where(F.col("rollup_day").isin(days)))
        store.replace_partitions("rollup_partial", summed.withColumn("rollup_day", F.date_format("day", "yyyyMMdd")))
    return len(days)
