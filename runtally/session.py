"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    # Days, partitions and retention are all UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_local_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", app: str = "runtally", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="runtally-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/runtally/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging(spark: SparkSession, label: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``materialize`` into a folder of its own that is deleted at the end, also on failure.

    Nothing that is read from it may be used afterwards.
    """
    folder = scratch_path(spark, label)
    try:
        yield lambda df, name: materialize(df, name, folder)
    finally:
        delete_path(spark, folder)


#: Whether Spark deletes the shuffle files of a query as soon as it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them ends, and not when the driver happens to
    collect its garbage: for a chain of queries that each store what the next one reads."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a copy that survives lost executors, and gives the planner
    the true size: a small result is then broadcast by Spark's own threshold and a
    large one is joined by a shuffle, with no hint either way.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utc(instant: datetime) -> datetime:
    """The instant in UTC; one without a zone is taken to be UTC already."""
    if instant.tzinfo is None:
        return instant.replace(tzinfo=timezone.utc)
    return instant.astimezone(timezone.utc)
