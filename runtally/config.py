"""Limits and retention settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


DEFAULT_SHARDS = 16


@dataclass(frozen=True)
class Options:
    # The service's default limits.
    max_body_bytes: int = 2_097_152
    max_batch_lines: int = 500
    rate_permits: int = 120
    rate_window_seconds: int = 60
    global_rate_factor: int = 10
    future_tolerance_days: int = 2
    retention_days: int = 90
    precreate_days: int = 7
    dedup_retention_days: int = 35
    job_interval_hours: int = 24
    log_retention_days: int = 30

    # Storage layout: every day is split into so many install shards, so that erasing a
    # few installs rewrites a few shards and not whole days. The count belongs to the
    # store: it is fixed when the store is created (DEFAULT_SHARDS if not given) and read
    # from there; a different count given for an existing store is refused.
    install_shards: int | None = None

    @classmethod
    def from_session(cls, spark: SparkSession) -> Options:
        """Defaults overridden by ``spark.runtally.<field>`` settings."""
        found = {}
        for field in fields(cls):
            value = spark.conf.get(f"spark.runtally.{field.name}", None)
            if value is not None:
                found[field.name] = int(value)
        return cls(**found)


def validate_options(options: Options) -> Options:
    """Reject settings that would delete live data; reports every fault at once."""
    at_least = {
        "retention_days": 1,
        "dedup_retention_days": 1,
        "job_interval_hours": 1,
        "log_retention_days": 1,
        "precreate_days": 0,
        "install_shards": 1,
    }
    given = {name: getattr(options, name) for name in at_least if getattr(options, name) is not None}
    faults = [
        f"{name} must be >= {at_least[name]} (got {value})"
        for name, value in given.items()
        if value < at_least[name]
    ]
    if faults:
        raise ValueError("; ".join(faults))
    return options
