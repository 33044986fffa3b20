"""Readers for landed batches and request logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from runtally.schema import INGEST_MEDIA_TYPE, RAW_BATCH, REQUEST


def _stream(spark: SparkSession, max_files: int | None, max_bytes: int | None, archive: str | None) -> DataStreamReader:
    if max_files and max_bytes:
        raise ValueError("a trigger is bounded by files or by bytes, not by both")
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader


def read_batches(
    spark: SparkSession,
    path: str,
    stream: bool = False,
    max_files: int | None = None,
    max_bytes: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Raw batches landed as parquet: one row per body with its key and arrival time.

    Of a stream, ``max_files`` or ``max_bytes`` bound a micro-batch, and files are
    moved to ``archive`` (in the same file system, outside ``path``) once a later micro-batch
    begins, so that the listing of the landing folder does not grow with its history.
    """
    reader = _stream(spark, max_files, max_bytes, archive) if stream else spark.read
    return reader.schema(RAW_BATCH).parquet(path)


def read_body_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw batches landed as one ``<key>.ndjson`` file per body.

    Convenient for small drops; at volume land parquet, which packs many bodies per file.
    """
    reader = spark.readStream if stream else spark.read
    bodies = reader.schema("value string").text(path, wholetext=True)
    file_name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return bodies.select(
        F.regexp_extract(file_name, r"^(.*)\.ndjson$", 1).alias("idempotency_key"),
        F.when(file_name.endswith(".ndjson"), INGEST_MEDIA_TYPE).alias("content_type"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("body"),
    )


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST).parquet(path)
