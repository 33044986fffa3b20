"""Approximate nearest neighbours: a forest of random-projection trees.

The trees' hyperplanes (halfway between two sample points) are fitted on a bounded sample; every vector is
then routed through every tree, so the index holds all rows. A query walks all trees with one
shared priority queue, nearest hyperplane margins first, until the leaves it took hold
``search`` vectors; their members are ranked by exact distance in double precision.

Before the search, an audit compares a bounded sample of queries with all rows and doubles
``search`` until ``TARGET`` of their nearest classes are found (or all vectors are read).

Equal vectors are one class: a vector that a third of all rows share is routed, stored and
compared once, and its rows are ranked only where the class is an answer. Leaves beyond
``SHARE`` classes are dealt out to several tasks; each task returns the best of its share.

Defined results: null, empty, zero or non-finite vectors and rows without an id take no part;
vectors of one length are searched among themselves, a forest for each length; ties go to
the smaller id; a repeated row counts once, and an id with different vectors asks once for each;
rows with the query's id are no candidates; a query without candidates has no rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runtally.llm.vectors import matrix, valid
from runtally.session import materialize

#: Vectors the hyperplanes are fitted on, trees, sample points per leaf at most, vectors whose
#: distance a query computes at least (in all trees together), classes of a leaf per task.
SAMPLE, TREES, LEAF, SEARCH, SHARE = 20_000, 16, 64, 20_000, 4096
#: Queries of the audit and the share of their nearest classes to be found.
AUDITED, TARGET = 64, 0.95
#: Salts for ranking the rows of one class.
SALTS = 16


@dataclass(frozen=True)
class Tree:
    """Inner node n: ``planes[n] @ v - offsets[n]``; children >= 0 are nodes, others ~leaf."""

    planes: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def route(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0 if len(self.planes) else ~0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                side = points[rows] @ self.planes[node] >= self.offsets[node]
                todo += [(self.right[node], rows[side]), (self.left[node], rows[~side])]
        return out


def grow(points: np.ndarray, leaf: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    planes, offsets, left, right, leaves = [], [], [], [], 0

    def split(rows: np.ndarray):
        for _ in range(5):
            a, b = points[rng.choice(rows, 2, replace=False)]
            plane = b - a
            length = np.linalg.norm(plane)
            if length > 0:
                plane = plane / length
                offset = plane @ (a + b) / 2
                side = points[rows] @ plane >= offset
                if 0.05 * len(rows) <= side.sum() <= 0.95 * len(rows):
                    return plane, offset, side
        return None

    todo = [(np.arange(len(points)), None, 0)]
    while todo:
        rows, parent, is_right = todo.pop()
        cut = split(rows) if len(rows) > leaf else None
        if cut is None:
            name, leaves = ~leaves, leaves + 1
        else:
            name = len(planes)
            planes.append(cut[0])
            offsets.append(cut[1])
            left.append(0)
            right.append(0)
            todo += [(rows[cut[2]], name, 1), (rows[~cut[2]], name, 0)]
        if parent is not None:
            (right if is_right else left)[parent] = name
    return Tree(np.array(planes), np.array(offsets), np.array(left, np.int64), np.array(right, np.int64), leaves)


def leaves_of(query: np.ndarray, trees: list[Tree], sizes: dict[tuple[int, int], int], search: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees until they hold ``search`` rows."""
    queue = [(-np.inf, t, 0 if len(tree.planes) else ~0) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < search:
        worst, t, node = heapq.heappop(queue)
        if node < 0:
            size = sizes.get((t, ~node), 0)
            if size:
                found.append((t, ~node))
                held += size
            continue
        tree = trees[t]
        margin = float(query @ tree.planes[node] - tree.offsets[node])
        near, far = (tree.right, tree.left) if margin >= 0 else (tree.left, tree.right)
        heapq.heappush(queue, (worst, t, int(near[node])))
        heapq.heappush(queue, (max(worst, abs(margin)), t, int(far[node])))
    return found


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    trees: int = TREES,
    search: int = SEARCH,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: Euclidean distance, for each query row.

    ``is_query`` is a condition on ``vec_id``. ``search`` is where the audit starts.
    """
    rows = valid(df, vec_id, embedding).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        out = out.unionAll(_nearest(rows.where(F.size("v") == width), is_query, k, trees, search, sample))
    return out


def _nearest(rows: DataFrame, is_query: Column, k: int, trees: int, search: int, sample: int) -> DataFrame:
    """``nearest`` among vectors (vec_id, v) of one length."""
    spark = rows.sparkSession
    members = materialize(rows, "vectors")
    classes = materialize(members.groupBy("v").agg(F.min("vec_id").alias("class")), "classes")
    picked = classes.orderBy(F.xxhash64("class"), "class").limit(sample).toPandas()
    points = np.stack(picked["v"].to_numpy())
    forest = spark.sparkContext.broadcast([grow(points, LEAF, seed) for seed in range(trees)])

    def routed(batches):
        for batch in batches:
            names = batch.schema.names
            v = matrix(batch.column(names.index("v")))
            for t, tree in enumerate(forest.value):
                leaf = pa.array(tree.route(v).astype(np.int32))
                columns = [pa.array(np.full(len(v), t, np.int32)), leaf, *(batch.column(names.index(c)) for c in ("class", "v"))]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "class", "v"])

    index = materialize(classes.mapInArrow(routed, "tree int, leaf int, class long, v array<double>"), "index")
    # One row per leaf: bounded by the trees.
    sizes = {(r["tree"], r["leaf"]): r["count"] for r in index.groupBy("tree", "leaf").count().toLocalIterator()}
    known = spark.sparkContext.broadcast(sizes)

    def visiting(search):
        def visits(batches):
            for batch in batches:
                names = batch.schema.names
                v = matrix(batch.column(names.index("v")))
                found = [leaves_of(q, forest.value, known.value, search) for q in v]
                at = np.repeat(np.arange(len(v)), [len(f) for f in found])
                flat = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 2)
                share = [-(-known.value[(int(t), int(x))] // SHARE) for t, x in flat]
                part = np.concatenate([np.arange(s, dtype=np.int32) for s in share]) if share else np.empty(0, np.int32)
                wide = np.repeat(np.arange(len(flat)), share).astype(np.int64)
                taken = batch.take(pa.array(at[wide], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat[wide, 0]),
                        pa.array(flat[wide, 1]),
                        pa.array(part),
                        pa.array(np.ones(len(wide), dtype=bool)),
                        taken.column(names.index("class")),
                        taken.column(names.index("v")),
                    ],
                    names=["tree", "leaf", "part", "asks", "class", "v"],
                )

        return visits

    queries = members.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asking = classes.join(queries.select("v").distinct(), "v", "leftsemi").select("class", "v")
    shares = F.broadcast(
        # Bounded by the trees, as above.
        spark.createDataFrame([(t, x, -(-n // SHARE)) for (t, x), n in sizes.items()], "tree int, leaf int, parts int")
    )
    dealt = index.join(shares, ["tree", "leaf"]).select(
        "tree", "leaf", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "class", "v"
    )

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        v, ids = matrix(table.column("v")), table.column("class").to_numpy()
        stored, names = v[~asks], ids[~asks]
        out: list[list[np.ndarray]] = [[], [], []]
        for q, name in zip(v[asks], ids[asks]):
            if not len(names):
                break
            squares = ((stored - q) ** 2).sum(axis=1)
            top = np.lexsort((names, squares))[: k + 1] if len(names) <= k + 1 else None
            if top is None:
                edge = np.partition(squares, k)[k]
                some = np.flatnonzero(squares <= edge)
                top = some[np.lexsort((names[some], squares[some]))][: k + 1]
            for column, values in zip(out, (np.full(len(top), name), names[top], np.sqrt(squares[top]))):
                column.append(values)
        flat = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"asker": flat[0].astype(np.int64), "class": flat[1].astype(np.int64), "score": flat[2].astype(float)})

    # k + 1 classes hold k rows besides the query's own.
    top = Window.partitionBy("asker").orderBy("score", "class")

    def nearest_classes(near: DataFrame) -> DataFrame:
        return near.distinct().withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")

    def searched(asking: DataFrame, search: int) -> DataFrame:
        asked = asking.mapInArrow(
            visiting(search), "tree int, leaf int, part int, asks boolean, class long, v array<double>"
        )
        both = asked.unionAll(dealt).groupBy("tree", "leaf", "part")
        return nearest_classes(both.applyInArrow(best, "asker long, class long, score double"))

    asking = materialize(asking, "asking")
    few = asking.orderBy(F.xxhash64("class", F.lit("audit")), "class").limit(AUDITED)
    sample = few.toPandas()
    points = spark.sparkContext.broadcast((sample["class"].to_numpy(), list(sample["v"])))

    def exact(batches):
        for batch in batches:
            names = batch.schema.names
            v, ids = matrix(batch.column(names.index("v"))), batch.column(names.index("class")).to_numpy()
            for name, q in zip(*points.value):
                squares = ((v - q) ** 2).sum(axis=1)
                few = np.lexsort((ids, squares))[: k + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(few), name)), pa.array(ids[few]), pa.array(np.sqrt(squares[few]))],
                    names=["asker", "class", "score"],
                )

    true = materialize(nearest_classes(classes.mapInArrow(exact, "asker long, class long, score double")), "audit")
    few = materialize(few, "audited")
    wanted = true.count()
    every = trees * classes.count()
    while search < every:
        if searched(few, search).join(true, ["asker", "class"], "leftsemi").count() >= TARGET * wanted:
            break
        search *= 2
    near = materialize(searched(asking, search), "near")
    # The first k + 1 rows of the classes that are answers; salts keep a large class spread.
    named = members.join(classes, "v").select("class", "vec_id")
    answers = named.join(near.select("class").distinct(), "class", "leftsemi").distinct()
    salted = Window.partitionBy("class", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    whole = Window.partitionBy("class").orderBy("vec_id")
    firsts = answers.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    firsts = firsts.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("class", "vec_id")
    named_queries = queries.join(classes, "v").select("query_id", F.col("class").alias("asker"))
    pairs = named_queries.join(near, "asker").join(materialize(firsts, "firsts"), "class").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id", "asker").orderBy("score", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
