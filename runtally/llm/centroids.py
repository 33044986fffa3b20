"""Centroid clustering: exact k-means on integer grids, assigned by the threshold algorithm.

Every component becomes ``floor(scale * x)``. A vector's nearest centroid is found from one
sorted list of centroid values per dimension: the lists are walked outward from the vector's
value, one centroid per list and step, the closer side first. A centroid met for the first time
gets its exact distance. One not met yet is at least as far as the walk in every dimension, so
the search ends once the squared gaps of the walk add up to strictly more than the best exact
distance; an equal sum goes on, as the unseen centroid might have the smaller number.

How it runs. Each round is one pass: a task walks the lists for its vectors in portions and sends
one row of counts and sums per centroid, however many vectors a centroid has; those rows are added
up and the new centroids (k x width integers, bounded by parameters) go to the next pass. Nothing
is stored, the table is read ``rounds`` + 3 times, and a lost task is simply run again.

Defined results: vectors of another width, null ones, and those with a null or non-finite
component are left out; components beyond 2**27 / scale are drawn to that bound, so that distances
fit a long; a null id is an id like any other but starts no centroid before the others do;
repeated rows are vectors of their own; equal distances go to the smaller number; with fewer than
``k`` vectors there are as many centroids as vectors; equal start vectors leave the later centroid
empty, and an empty centroid keeps its place; an empty table gives an empty table; other columns
are left out, whatever their names. Sums beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest component on the grid: a squared distance of 64 such gaps still fits a long.
BOUND = 1 << 27
#: Vectors walked at once in a task.
PORTION = 2048


def on_grid(df: DataFrame, vec_id: str, embedding: str, width: int, scale: int) -> DataFrame:
    """vec_id, v: array<int> of the vectors that take part."""
    found = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = F.lit(float(BOUND))
    grid = F.transform("v", lambda x: F.floor(F.greatest(-edge, F.least(edge, x * scale))).cast("int"))
    return found.where((F.size("v") == width) & finite).select("vec_id", grid.alias("v"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, by the threshold algorithm."""
    k, width = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    far = np.iinfo(np.int64).max
    best, number = np.full(len(vectors), far), np.zeros(len(vectors), dtype=np.int64)
    seen = np.zeros((len(vectors), k), dtype=bool)
    above = np.stack([np.searchsorted(values[:, d], vectors[:, d]) for d in range(width)], axis=1)
    below = above - 1
    dims = np.arange(width)
    going = np.arange(len(vectors))
    for _ in range(k):
        x, low, high = vectors[going], below[going], above[going]
        gap_low = np.where(low >= 0, x - values[np.maximum(low, 0), dims], far)
        gap_high = np.where(high < k, values[np.minimum(high, k - 1), dims] - x, far)
        down = gap_low <= gap_high
        met = order[np.where(down, low, high), dims]
        below[going], above[going] = low - down, high + ~down
        fresh = np.zeros((len(going), k), dtype=bool)
        fresh[np.arange(len(going))[:, None], met] = True
        fresh &= ~seen[going]
        seen[going] |= fresh
        for c in np.flatnonzero(fresh.any(axis=0)):
            rows = going[fresh[:, c]]
            distance = np.square(vectors[rows] - centroids[c]).sum(axis=1)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (c < number[rows]))
            best[rows[closer]], number[rows[closer]] = distance[closer], c
        frontier = np.square(np.minimum(gap_low, gap_high)).sum(axis=1)
        going = going[frontier <= best[going]]
        if not len(going):
            break
    return number, best


def _portions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, PORTION):
            part = batch.slice(start, PORTION)
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.astype(np.int64).reshape(-1, width)


def _totals(grid: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Per centroid with vectors: their number, the sums of their components and of their
    distances. At most k * (width + 2) numbers reach the driver."""
    k, width = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k, dtype=np.int64)
        sums = np.zeros((k, width), dtype=np.int64)
        distances = [0] * k
        for _, vectors in _portions(batches, width):
            number, distance = nearest(vectors, centroids)
            np.add.at(sums, number, vectors)
            for c in np.flatnonzero(np.bincount(number, minlength=k)):
                mine = number == c
                counts[c] += int(mine.sum())
                distances[c] += sum(distance[mine].tolist())
        held = np.flatnonzero(counts).tolist()
        rows = [(c, "n", int(counts[c])) for c in held] + [(c, "distance", distances[c]) for c in held]
        rows += [(c, str(d), int(sums[c, d])) for c in held for d in range(width)]
        names, kinds = ("c", "item", "value"), (pa.int32(), pa.string(), pa.string())
        columns = zip(*rows) if rows else ((), (), ())
        columns = (values if name != "value" else map(str, values) for name, values in zip(names, columns))
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds)], names=names)

    parts = grid.select("v").mapInArrow(add_up, "c int, item string, value string")
    added = parts.groupBy("c", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, dict[str, int]] = {}
    for r in added.collect():
        found.setdefault(r["c"], {})[r["item"]] = int(r["value"])
    return {c: (x["n"], [x[str(d)] for d in range(width)], x["distance"]) for c, x in found.items()}


def first_centroids(grid: DataFrame, k: int, seed: str) -> np.ndarray | None:
    """The vectors whose id has the smallest hash; equal ones in the order of their components."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = grid.withColumn("key", key).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64) if rows else None


def cluster(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    seed: str = "3:",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>) and its
    centroid_sha256, a row per vector that takes part."""
    spark = df.sparkSession
    grid = on_grid(df, vec_id, embedding, width, scale)
    centroids = first_centroids(grid, k, seed)
    model = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if centroids is None:
        rows: list[tuple] = []
        centroids = np.zeros((1, width), dtype=np.int64)
    else:
        for _ in range(rounds):
            centroids = centroids.copy()
            for c, (n, sums, _) in _totals(grid, centroids).items():
                centroids[c] = [s // n for s in sums]
        last = {c: distance for c, (_, _, distance) in _totals(grid, centroids).items()}
        whole = sum(last.values())
        rows = []
        for c, distance in last.items():
            values = centroids[c].tolist()
            digest = hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()
            rows.append((c, *(x if x < 1 << 63 else None for x in (distance, whole)), values, digest))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _portions(batches, width):
            number, distance = nearest(vectors, centroids)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": part.column("vec_id"),
                    "cluster": pa.array(number, pa.int32()),
                    "distance": pa.array(distance, pa.int64()),
                }
            )

    assigned = grid.mapInArrow(assign, "vec_id long, cluster int, distance long")
    # k rows
    return assigned.join(F.broadcast(spark.createDataFrame(rows, model)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
