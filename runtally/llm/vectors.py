"""Vectors of a table: which take part, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v: array<double> of the rows with an id and a vector that is neither null, empty
    nor zero and has finite components only. Repeated rows stay."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by cosine; a bounded sample on the driver."""
    rng = np.random.default_rng(7)
    centres = points[rng.choice(len(points), size=min(k, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres
