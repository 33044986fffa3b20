"""Dashboard rollups over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runtally.schema import VERDICT_COLUMNS

TIMINGS = ["startup_ms", "time_to_first_test_ms"]
PROBABILITIES = {"p50": 0.5, "p95": 0.95}
_RUN_DAILY = [
    "day", "events", "runs", "scenarios", *VERDICT_COLUMNS,
    *[f"{metric}_{p}" for metric in TIMINGS for p in PROBABILITIES], "distinct_installs",
]


def event_day() -> Column:
    return F.date_trunc("day", F.col("event_timestamp"))


def _day(events: DataFrame) -> Column:
    """The ``day`` that the rows already have, else that of the event."""
    return F.col("day") if "day" in events.columns else event_day().alias("day")


def _usage_daily(events: DataFrame, column: str, name: str) -> DataFrame:
    """Exploded after projecting to (day, map); an empty or null map adds nothing."""
    return (
        events.select(_day(events), F.explode(column).alias(name, "_n"))
        .groupBy("day", name)
        .agg(F.sum("_n").alias("n"))
    )


def step_family_daily(events: DataFrame) -> DataFrame:
    return _usage_daily(events, "step_families", "family")


def step_provider_daily(events: DataFrame) -> DataFrame:
    return _usage_daily(events, "step_providers", "provider")


def run_daily(events: DataFrame) -> DataFrame:
    """Counts, verdict sums, distinct installs and exact timing percentiles per UTC day."""
    totals = events.groupBy(_day(events)).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("run_count").alias("runs"),
        F.sum("scenario_count").alias("scenarios"),
        *[F.sum(name).alias(name) for name in VERDICT_COLUMNS],
        F.count_distinct("install_id").alias("distinct_installs"),
    )
    timing = timing_percentiles(events.select(_day(events), *TIMINGS), ["day"], TIMINGS)
    return totals.join(timing, "day", "left").select(*_RUN_DAILY)


def partials(events: DataFrame, sign: int = 1) -> DataFrame:
    """(day, kind, name, value, n): counts of the events that can be added up and subtracted.

    ``total``: the daily sums by name; ``family`` and ``provider``: uses; ``install``: events per install;
    ``timing``: how often a metric has a value. One pass, pre-aggregated map-side.
    """

    def cell(kind: str, name: Column, n: Column, value: Column | None = None) -> Column:
        value = F.lit(None) if value is None else value
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), value.cast("bigint").alias("value"), n.cast("bigint").alias("n")
        )

    sums = {"events": F.lit(1), "runs": F.col("run_count"), "scenarios": F.col("scenario_count")}
    sums |= {name: F.col(name) for name in VERDICT_COLUMNS}
    cells = [cell("total", F.lit(name), n) for name, n in sums.items()]
    cells.append(cell("install", F.col("install_id"), F.lit(1)))
    cells += [cell("timing", F.lit(m), F.when(F.col(m).isNotNull(), 1), F.col(m)) for m in TIMINGS]
    lists = [F.array(*cells)]
    none = F.array().cast("array<struct<kind:string,name:string,value:bigint,n:bigint>>")

    def uses(kind: str, column: str) -> Column:
        return F.coalesce(F.transform(F.map_entries(column), lambda e: cell(kind, e["key"], e["value"])), none)

    lists += [uses("family", "step_families"), uses("provider", "step_providers")]
    rows = events.select(_day(events), F.inline(F.concat(*lists))).where(F.col("n").isNotNull())
    return rows.groupBy("day", "kind", "name", "value").agg((F.sum("n") * sign).alias("n"))


def added_up(rows: DataFrame) -> DataFrame:
    """Partials with each count once; days whose events are all gone are left out."""
    summed = rows.groupBy("day", "kind", "name", "value").agg(F.sum("n").alias("n"))
    alive = summed.where("kind = 'total' AND name = 'events' AND n > 0").select("day")
    # a total of zero is a result; a count of zero is nothing
    return summed.where("n <> 0 OR kind = 'total'").join(alive, "day", "left_semi")


def usage_daily_of(summed: DataFrame, kind: str) -> DataFrame:
    """``step_family_daily`` or ``step_provider_daily`` from partials."""
    return summed.where(F.col("kind") == kind).select("day", F.col("name").alias(kind), "n")


def run_daily_of(summed: DataFrame) -> DataFrame:
    """``run_daily`` from partials."""
    names = ["events", "runs", "scenarios", *VERDICT_COLUMNS]
    totals = summed.where("kind IN ('total', 'install')").groupBy("day").agg(
        *[F.sum(F.when((F.col("kind") == "total") & (F.col("name") == name), F.col("n"))).alias(name) for name in names],
        F.count_if(F.col("kind") == "install").alias("distinct_installs"),
    )
    counts = summed.where("kind = 'timing'").select("day", F.col("name").alias("metric"), "value", "n")
    timing = percentiles_of_counts(counts, ["day"], TIMINGS)
    return totals.join(timing, "day", "left").select(*_RUN_DAILY)


def distinct_installs(events: DataFrame) -> DataFrame:
    return events.groupBy(event_day().alias("day")).agg(
        F.count_distinct("install_id").alias("distinct_installs")
    )


def distinct_installs_approx(events: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Sketch-based twin of ``distinct_installs`` for dashboards that can bear an error."""
    return events.groupBy(event_day().alias("day")).agg(
        F.approx_count_distinct("install_id", rsd).alias("distinct_installs")
    )


#: Sketches of 2^14 registers: a standard error of 0.8 % (1.04 / sqrt(2^14)) and at most 16 KB a day.
SKETCH_SIZE = 14
PERIODS = ["day", "week", "month", "quarter", "year"]


def install_sketches_of(summed: DataFrame) -> DataFrame:
    """A mergeable sketch of each day's installs, from partials."""
    installs = summed.where("kind = 'install' AND n > 0")
    return installs.groupBy("day").agg(F.hll_sketch_agg("name", SKETCH_SIZE).alias("sketch"))


def _period(period: str) -> Column:
    if period not in PERIODS:
        raise ValueError(f"the period must be one of {', '.join(PERIODS)}, not {period}")
    return F.date_trunc(period, "day").alias("start")


def installs_of_sketches(sketches: DataFrame, period: str) -> DataFrame:
    """Estimated distinct installs per period (weeks begin on Monday): an install that is seen on
    many days counts once. One row per day is read, whatever the number of events."""
    merged = sketches.groupBy(_period(period)).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("start", F.hll_sketch_estimate("sketch").alias("distinct_installs"))


def installs_of_partials(partials: DataFrame, period: str) -> DataFrame:
    """The exact count that ``installs_of_sketches`` estimates; shuffles each install once per period and task."""
    installs = partials.where("kind = 'install'").groupBy(_period(period), "name").agg(F.sum("n").alias("n"))
    return installs.where("n > 0").groupBy("start").agg(F.count(F.lit(1)).alias("distinct_installs"))


# Order-preserving bucket of a bigint: its sign, bit length and ten leading bits. At most
# about 58,000 buckets exist, each spanning under 0.2% of its values' size.
_SIZE = "abs(greatest(value, -9223372036854775807))"
_DROPPED = f"greatest(length(bin({_SIZE})) - 10, 0)"
_BUCKET = f"({_DROPPED} * 1024 + shiftright({_SIZE}, {_DROPPED})) * if(value < 0, -1, 1)"


def _wanted_ranks() -> str:
    """The ranks each percentile interpolates between, counted from zero."""
    ranks = [
        f"named_struct('p', '{name}', 'side', '{side}', 'rank', cast({rounding}((total - 1) * {p}D) as bigint), "
        f"'share', (total - 1) * {p}D - floor((total - 1) * {p}D))"
        for name, p in PROBABILITIES.items()
        for side, rounding in [("low", "floor"), ("high", "ceil")]
    ]
    return f"array({', '.join(ranks)})"


def _interpolated(metric: str, p: str) -> str:
    def at(side: str, column: str) -> str:
        return f"max(if(metric = '{metric}' and p = '{p}' and side = '{side}', {column}, null))"

    low, high = f"cast({at('low', 'value')} as double)", f"cast({at('high', 'value')} as double)"
    return f"{low} + ({high} - {low}) * {at('low', 'share')}"


def timing_percentiles(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Exact interpolated percentiles per group, without holding a group in one task.

    1. Count equal values per group: pre-aggregated map-side, spread over all values.
    2. Add the counts up per coarse bucket and walk the buckets (bounded in number) to
       find those that hold the wanted ranks: at most four per group and metric.
    3. Walk the values of just those buckets.
    """
    by = [*keys, "metric"]
    pairs = ", ".join(f"named_struct('metric', '{m}', 'value', cast({m} as bigint))" for m in metrics)
    counts = (
        rows.selectExpr(*keys, f"inline(array({pairs}))")
        .where("value is not null")
        .groupBy(*by, "value")
        .agg(F.expr("count(1) as n"))
    )
    return percentiles_of_counts(counts, keys, metrics)


def percentiles_of_counts(counts: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Steps 2 and 3 of ``timing_percentiles`` over (keys, metric, value, n)."""
    by = [*keys, "metric"]
    counts = counts.withColumn("bucket", F.expr(_BUCKET))
    group = f"partition by {', '.join(by)}"
    wanted = (
        counts.groupBy(*by, "bucket")
        .agg(F.expr("sum(n) as n"))
        .selectExpr(
            *by,
            "bucket",
            f"sum(n) over ({group}) as total",
            f"sum(n) over ({group} order by bucket) as upto",
            f"sum(n) over ({group} order by bucket) - n as start",
        )
        .selectExpr(
            *by, "bucket", "start", f"filter({_wanted_ranks()}, r -> r.rank >= start and r.rank < upto) as ranks"
        )
        .where("size(ranks) > 0")
    )
    walked = (
        counts.join(wanted, [*by, "bucket"])
        .withColumn("upto", F.expr(f"start + sum(n) over ({group}, bucket order by value)"))
        .selectExpr(*by, "value", "inline(filter(ranks, r -> r.rank >= upto - n and r.rank < upto))")
    )
    percentiles = [F.expr(f"{_interpolated(m, p)} as {m}_{p}") for m in metrics for p in PROBABILITIES]
    return walked.groupBy(*keys).agg(*percentiles)


def usage_daily_sql(rows: str, column: str, name: str) -> str:
    """``step_family_daily`` and its like as a query over a relation that has a ``day``."""
    used = f"SELECT day, explode({column}) AS ({name}, used) FROM {rows}"
    return f"SELECT day, {name}, sum(used) AS n FROM ({used}) GROUP BY day, {name}"


def run_daily_sql(rows: str) -> str:
    """``run_daily`` as a query over a relation that has a ``day``, by the same steps."""
    sums = {"events": "count(1)", "runs": "sum(run_count)", "scenarios": "sum(scenario_count)"}
    sums |= {name: f"sum({name})" for name in VERDICT_COLUMNS} | {"distinct_installs": "count(DISTINCT install_id)"}
    totals = ", ".join(f"{total} AS {name}" for name, total in sums.items())
    pairs = ", ".join(f"named_struct('metric', '{m}', 'value', cast({m} AS bigint))" for m in TIMINGS)
    percentiles = ", ".join(f"{_interpolated(m, p)} AS {m}_{p}" for m in TIMINGS for p in PROBABILITIES)
    group = "PARTITION BY day, metric"
    return f"""
        WITH totals AS (SELECT day, {totals} FROM {rows} GROUP BY day),
        counts AS (
            SELECT day, metric, value, {_BUCKET} AS bucket, count(1) AS n
            FROM (SELECT day, inline(array({pairs})) FROM {rows})
            WHERE value IS NOT NULL
            GROUP BY day, metric, value
        ),
        buckets AS (SELECT day, metric, bucket, sum(n) AS n FROM counts GROUP BY day, metric, bucket),
        spans AS (
            SELECT day, metric, bucket, sum(n) OVER ({group}) AS total,
                sum(n) OVER ({group} ORDER BY bucket) AS upto, sum(n) OVER ({group} ORDER BY bucket) - n AS start
            FROM buckets
        ),
        wanted AS (
            SELECT day, metric, bucket, start,
                filter({_wanted_ranks()}, r -> r.rank >= start AND r.rank < upto) AS ranks
            FROM spans
        ),
        walked AS (
            SELECT day, metric, value, n, ranks,
                start + sum(n) OVER ({group}, bucket ORDER BY value) AS upto
            FROM counts JOIN wanted USING (day, metric, bucket)
            WHERE size(ranks) > 0
        ),
        found AS (
            SELECT day, metric, value, inline(filter(ranks, r -> r.rank >= upto - n AND r.rank < upto)) FROM walked
        ),
        timing AS (SELECT day, {percentiles} FROM found GROUP BY day)
        SELECT {", ".join(_RUN_DAILY)} FROM totals LEFT JOIN timing USING (day)"""


def timing_trend(events: DataFrame) -> DataFrame:
    """Daily medians and their change; the ordered window runs over one row per day."""
    daily = timing_percentiles(events.select(_day(events), *TIMINGS), ["day"], TIMINGS)
    by_day = Window.orderBy("day")
    return daily.select(
        "day",
        *[f"{m}_p50" for m in TIMINGS],
        *[
            (F.col(f"{m}_p50") - F.lag(f"{m}_p50").over(by_day)).alias(f"{m}_p50_change")
            for m in TIMINGS
        ],
    )


def usage_ranking(events: DataFrame, column: str, name: str, k: int | None = None) -> DataFrame:
    """Most used families or providers; ``k`` makes it a top-k report."""
    ranked = (
        events.select(F.explode(column).alias(name, "_n"))
        .groupBy(name)
        .agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("runs"))
        .orderBy(F.desc("n"), name)
    )
    return ranked if k is None else ranked.limit(k)


def env_error_by_provider(events: DataFrame) -> DataFrame:
    """Environment errors in the runs that used a provider (verdicts are per run)."""
    return (
        events.select("step_env_error", F.explode(F.map_keys("step_providers")).alias("provider"))
        .groupBy("provider")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum(F.when(F.col("step_env_error") > 0, 1).otherwise(0)).alias("runs_with_env_error"),
            F.sum("step_env_error").alias("env_errors"),
        )
    )


def version_matrix(events: DataFrame) -> DataFrame:
    return events.groupBy("tool_version", "engine_version", "dotnet_version").agg(
        F.sum("run_count").alias("runs"), F.count_distinct("install_id").alias("installs")
    )
