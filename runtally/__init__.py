"""Usage-telemetry ingest, quality gate, dedup, lifecycle and rollups on Spark."""

from runtally.config import Options, validate_options
from runtally.plans.store import Store
from runtally.session import build_session, prepare

__all__ = ["Options", "Store", "build_session", "prepare", "validate_options"]
