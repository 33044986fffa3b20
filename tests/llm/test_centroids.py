import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtally.llm import centroids

from .twins import assert_twin

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=8, rounds=10, width=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    grid = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64)
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), grid[j].tolist()))
    centres = grid[order[:k]].copy()

    def nearest():
        distance = np.square(grid[:, None] - centres[None]).sum(axis=2)
        return distance.argmin(axis=1), distance.min(axis=1)

    for _ in range(rounds):
        of, _ = nearest()
        centres = centres.copy()
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = [int(s) // int((of == c).sum()) for s in grid[of == c].sum(axis=0)]
    of, distance = nearest()
    inertia = {c: int(distance[of == c].sum()) for c in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted(
        (i, int(c), int(d), inertia[c], sum(inertia.values()), digest[c]) for (i, _), c, d in zip(kept, of, distance)
    )


def clustered(df, **options):
    return sorted(tuple(r) for r in centroids.cluster(df, **options).drop("centroid").collect())


@pytest.mark.parametrize("k,width", [(1, 3), (7, 64), (60, 2), (200, 16)])
def test_walk_finds_the_nearest_with_the_smallest_number(k, width):
    rng = np.random.default_rng(k)
    for spread in (3, 1000):
        centres = rng.integers(-spread, spread, (k, width))
        centres[k // 2] = centres[0]  # an equal one
        vectors = np.concatenate([rng.integers(-2 * spread, 2 * spread, (300, width)), centres])
        distance = np.square(vectors[:, None] - centres[None]).sum(axis=2)
        number, best = centroids.nearest(vectors, centres)
        assert (number == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_walk_stops_early():
    centres = np.arange(0, 100_000, 100).reshape(-1, 1)
    calls = []
    original = np.square
    try:
        np.square = lambda x: calls.append(len(x)) or original(x)
        centroids.nearest(np.array([[50_010]]), centres)
    finally:
        np.square = original
    assert len(calls) < 10


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(7, rows[7][1])]  # equal vectors, a repeated row
    bad = [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [None] + [1.0] * 5), (2004, [float("nan")] * 6)]
    bad += [(2005, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    assert clustered(df, width=6) == brute(rows, width=6)


def test_few_vectors_empty_table_and_clashing_columns(spark):
    rows = [(i, [float(i), 0.5]) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clustered(df, width=2) == brute(rows, width=2)
    clash = df.withColumns({c: F.lit(1) for c in ("v", "cluster", "distance", "key")})
    assert clustered(clash, width=2) == brute(rows, width=2)
    assert clustered(df.where("false"), width=2) == []


def test_huge_components_and_null_ids(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (None, [0.0, 0.0])]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA), width=2, k=2, rounds=1).collect()
    assert len(got) == 3 and all(r["distance"] is not None for r in got)


def test_twin(spark):
    assert_twin(spark, "op13_centroids", SMALL)
