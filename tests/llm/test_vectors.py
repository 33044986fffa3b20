import numpy as np
import pytest
from pyspark.sql import functions as F

from runtally.llm import forest, graph


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def unit(rng, n, d=16):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def families(seed=1):
    rng = np.random.default_rng(seed)
    rows = list(unit(rng, 300))
    for size in (60, 7, 2):
        base = unit(rng, 1)[0]
        rows += [base + rng.normal(scale=0.03, size=16) for _ in range(size)]
    rows += [rows[0]] * 120 + [rows[5] * 2.0]
    return [(k * 7 % 10_007, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


ODD = [
    (20_001, None),
    (20_002, [0.0] * 16),
    (20_003, [float("nan")] + [1.0] * 15),
    (20_004, [float("inf")] + [1.0] * 15),
    (20_005, [None] + [1.0] * 15),
    (20_006, [1.0] * 8),
    (20_007, []),
    (None, [1.0] * 16),
]


def test_links_and_components_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 64)
    monkeypatch.setattr(graph, "PART", 100)
    rows = families()
    got = {r["vec_id"]: r for r in graph.near_duplicates(table(spark, rows + ODD)).collect()}
    ids = np.array([i for i, _ in rows])
    v = np.array([np.float32(x) for _, x in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        parent[a] = b
    smallest = {}
    for k in range(len(ids)):
        smallest[find(k)] = min(smallest.get(find(k), 10**9), ids[k])
    for k, i in enumerate(ids):
        row = got[i]
        assert (row["n_links"], row["component_id"]) == (near[k].sum() - 1, smallest[find(k)])
        assert row["kept"] == (row["component_id"] == i)
    for i, _ in ODD[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert len(got) == len(rows) + len(ODD)


def test_nearest_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARE", 50)
    rows = families(2)
    got = forest.nearest(table(spark, rows + ODD), F.col("vec_id") % 10 == 0, k=10).collect()
    ids = np.array([i for i, _ in rows])
    v = np.array([np.float32(x) for _, x in rows], dtype=np.float64)
    for q in np.flatnonzero(ids % 10 == 0):
        distance = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != ids[q])
        want = others[np.lexsort((ids[others], distance[others]))][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [(r, i) for r, i, _ in mine] == [(k + 1, ids[x]) for k, x in enumerate(want)]
        assert np.allclose([s for _, _, s in mine], distance[want], rtol=0, atol=1e-12)
    assert {r["query_id"] for r in got} == {i for i in ids if i % 10 == 0}


def test_audit_widens_a_narrow_search(spark):
    rng = np.random.default_rng(3)
    v = unit(rng, 3000, 12)
    rows = [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]
    got = forest.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, search=200).collect()
    v = np.float32(v).astype(np.float64)
    hits = 0
    for q in range(0, 3000, 100):
        distance = ((v - v[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        hits += len(set(np.argsort(distance)[:10]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / 300 >= 0.9 and len(got) == 300


@pytest.mark.parametrize("rows", [[], ODD[:4], [(1, [1.0, 2.0])]])
def test_tables_without_neighbours(spark, rows):
    assert forest.nearest(table(spark, rows), F.col("vec_id") >= 0).count() == 0
    got = graph.near_duplicates(table(spark, rows)).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(i for i, _ in rows)
    assert all(r["n_links"] == 0 and r["kept"] for r in got)


def test_candidates_fewer_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.1]), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    got = forest.nearest(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 5), (2, 7)]


def test_robust_prune_keeps_a_connected_graph():
    v = unit(np.random.default_rng(4), 500)
    edges = graph.build(v)
    seen, todo = {0}, [0]
    while todo:
        for n in edges[todo.pop()]:
            if n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) == 500
    assert graph.build(v[:1])[0].size == 0


def wide_families(rng, sizes, cosine, others, d=64):
    """Families whose centres have the given cosine, members nearly equal, and a further family."""
    base = np.linalg.qr(rng.normal(size=(d, len(sizes) + 1)))[0].T
    centres = [base[0]] + [cosine * base[0] + np.sqrt(1 - cosine**2) * b for b in base[1 : len(sizes)]]
    centres.append(base[len(sizes)])
    v = np.concatenate([c + rng.normal(scale=0.002, size=(n, d)) for c, n in zip(centres, (*sizes, others))])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def links(v, least=0.9):
    return (v @ v.T >= least).sum(axis=1) - 1


def found_links(spark, v):
    rows = [(k, [float(x) for x in np.float32(row)]) for k, row in enumerate(v)]
    got = {r["vec_id"]: r["n_links"] for r in graph.near_duplicates(table(spark, rows)).collect()}
    return np.array([got[k] for k in range(len(v))])


def test_search_leaves_a_family_wider_than_the_pool():
    v = wide_families(np.random.default_rng(5), (100, 100), 0.93, 400)
    edges = graph.padded(graph.build(v))
    for q in range(0, 200, 7):
        hits, scores = graph.in_range(v[q], v, edges, [400, q], 0.9, q)
        assert sorted(hits) == [k for k in range(200) if k != q] and (scores >= 0.9).all()


def test_links_between_wide_families(spark):
    v = wide_families(np.random.default_rng(6), (100, 100), 0.93, 300)
    assert (found_links(spark, v) == links(v)).all()


def test_exact_comparison_where_the_search_misses(spark, monkeypatch):
    monkeypatch.setattr(graph, "in_range", lambda *_: (np.empty(0, np.int64), np.empty(0)))
    v = wide_families(np.random.default_rng(7), (40, 30), 0.95, 50)
    assert (found_links(spark, v) == links(v)).all()


def test_rare_links_are_audited_until_seen(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 32)
    monkeypatch.setattr(graph, "SAMPLE", 200)
    rng = np.random.default_rng(8)
    v = unit(rng, 1200, 64)
    pairs = v[-40:] * 0.91 + unit(rng, 40, 64) * 0.4
    v = np.concatenate((v, pairs / np.linalg.norm(pairs, axis=1, keepdims=True)))
    # the linked ones come last in the order of the audit
    order = [r["id"] for r in spark.range(len(v)).orderBy(F.xxhash64("id", F.lit("audit"))).collect()]
    placed = np.empty_like(v)
    placed[order] = v
    want = links(placed)
    assert want.sum() >= 40 and not want[order[:1100]].any()
    assert (found_links(spark, placed) == want).all()


def test_vectors_of_every_length_take_part(spark):
    rows = [(i, [1.0, 0.1 * i, 0.0]) for i in range(1, 6)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [2.0, -1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in graph.near_duplicates(df).select("vec_id", "n_links", "component_id").collect()}
    assert (got[100], got[101], got[102], got[200]) == ((1, 100), (1, 100), (0, 102), (0, 200))
    assert {got[i][1] for i in range(1, 6)} == {1} and len(got) == len(rows)
    near = forest.nearest(df, F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in near.collect()] == [(100, 1, 101, 0.0), (100, 2, 102, pytest.approx(10**0.5))]
