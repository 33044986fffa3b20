"""Embedding near-duplicates by a robust-pruned flat graph.

1. Every vector goes to the shards of its ``overlap`` nearest cluster centres; a shard beyond
   ``PART`` vectors is dealt out to several parts.
2. Each part builds a graph: nearest candidates, robust-pruned so that edges lead in different
   directions, one far edge from each of a geometric series of rank ranges (a family of near
   vectors fills the nearest ranks, so these leave it), with reverse edges. Adjacency lists of
   a vector are united across shards.
3. In its nearest shard every vector searches all parts: greedily from the medoids of the
   part's clusters (and from itself where stored), then from every vector in range to its
   neighbours until none is new. Links are verified in double precision.
4. An audit compares samples of vectors with all rows until it is known, one more miss per
   stratum allowed for, whether ``TARGET`` of the links are found. If not, every vector is
   compared with all of its nearest shard instead of searching it, and then shards overlap
   more, until the audit holds or every vector was compared with all.

Equal vectors are one class and searched once. Centres are fitted on a bounded sample.

Defined results: null, empty, zero or non-finite vectors link with nothing; vectors of one
length are compared among themselves, a search for each length; a row without an id links
with nothing and has no component; repeated rows are vectors of their own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.llm.components import components
from runtally.llm.vectors import kmeans, matrix, valid
from runtally.session import materialize

#: Classes per shard aimed at, centres at most, vectors of a part at most, sample for centres.
SHARD, CENTRES, PART, SAMPLE = 512, 4096, 4096, 20_000
#: Candidates and kept edges per vector, the prune's factor, width of the greedy search.
POOL, DEGREE, ALPHA, BEAM = 64, 24, 1.2, 32
#: First rank and growth of the far edges' rank ranges, clusters whose medoids start a search.
FAR, GROWTH, MEDOIDS = 16, 1.5, 16
#: Vectors per stratum of the audit's first round and its growth, vectors compared at once, the
#: share of the links to be found, and how far below a link the best cosine of a close vector is.
AUDITED, MORE, BLOCK, TARGET, CLOSE = 256, 4, 1024, 0.99, 0.1


def build(v: np.ndarray) -> list[np.ndarray]:
    """Out-edges of each unit vector: robust-pruned nearest candidates, far and reverse edges."""
    m = len(v)
    if m < 2:
        return [np.empty(0, np.int64)] * m
    near = v @ v.T
    np.fill_diagonal(near, -np.inf)
    pool = min(POOL, m - 1)
    bounds = [FAR]
    while bounds[-1] < m - 1:
        bounds.append(min(m - 1, int(bounds[-1] * GROWTH)))
    ranked = np.argpartition(-near, sorted({pool - 1, *(b for b in bounds if b < m)}), axis=1)
    rng = np.random.default_rng(7)
    far = [ranked[np.arange(m), rng.integers(a, b, m)] for a, b in zip(bounds, bounds[1:])]
    candidates = ranked[:, :pool]
    order = np.argsort(-np.take_along_axis(near, candidates, 1), axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    np.fill_diagonal(near, 1.0)
    distance = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, candidates, 1), 0))
    alive = np.ones(candidates.shape, dtype=bool)
    kept = np.full((m, DEGREE), -1, np.int64)
    rows = np.arange(m)
    for slot in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        picked = candidates[rows, first]
        kept[some, slot] = picked[some]
        # a candidate that the picked one is clearly nearer to needs no edge of its own
        between = np.sqrt(np.maximum(2 - 2 * near[picked[:, None], candidates], 0))
        alive &= ALPHA * between > distance
        alive[rows, first] = False
    source, target = np.repeat(rows, DEGREE), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    source, target = np.concatenate((source, *[rows] * len(far))), np.concatenate((target, *far))
    both = np.unique(np.concatenate((source * m + target, target * m + source)))
    return np.split(both % m, np.searchsorted(both // m, rows[1:]))


def padded(edges: list[np.ndarray]) -> np.ndarray:
    """[vector, slot] with the number of vectors where there is no edge."""
    m = len(edges)
    lengths = np.array([len(e) for e in edges])
    out = np.full((m, max(1, int(lengths.max(initial=0)))), m, np.int64)
    out[np.repeat(np.arange(m), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = (
        np.concatenate(edges) if m else out[:0]
    )
    return out


def in_range(
    q: np.ndarray, v: np.ndarray, edges: np.ndarray, starts: list[int], least: float, own: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Stored vectors but ``own`` with cosine >= least that the search reaches and their cosines;
    if there are none, the best one reached."""
    m = len(v)
    seen = np.zeros(m + 1, dtype=bool)
    seen[m] = True
    seen[starts] = True
    known = np.array(starts)
    score = v[known] @ q
    opened = np.zeros(len(known), dtype=bool)
    # greedy: open the best unopened until the beam holds opened ones only
    while True:
        top = np.argsort(-score, kind="stable")[:BEAM]
        fresh = top[~opened[top]][:4]
        if not len(fresh):
            break
        opened[fresh] = True
        new = np.unique(edges[known[fresh]])
        new = new[~seen[new]]
        seen[new] = True
        known = np.concatenate((known, new))
        score = np.concatenate((score, v[new] @ q))
        opened = np.concatenate((opened, np.zeros(len(new), dtype=bool)))
    # expand: open everything in range
    while len(wide := np.flatnonzero((score >= least) & ~opened)):
        opened[wide] = True
        new = np.unique(edges[known[wide]])
        new = new[~seen[new]]
        seen[new] = True
        known = np.concatenate((known, new))
        score = np.concatenate((score, v[new] @ q))
        opened = np.concatenate((opened, np.zeros(len(new), dtype=bool)))
    others = known != own if own is not None else np.ones(len(known), dtype=bool)
    known, score = known[others], score[others]
    hit = score >= least
    if not hit.any():
        hit = np.arange(len(score)) == (score.argmax() if len(score) else -1)
    return known[hit], score[hit]


def medoids(v: np.ndarray) -> list[int]:
    """The members nearest to the mean and to the centres of ``MEDOIDS`` clusters."""
    middles = np.concatenate((v.mean(axis=0)[None], kmeans(v, MEDOIDS)))
    return np.unique((middles @ v.T).argmax(axis=1)).tolist()


def _search(classes: DataFrame, centres: np.ndarray, overlap: int, least: float, compare: bool = False) -> DataFrame:
    """(a, b, score): directed links between classes; for a class that finds none in a part, the
    best other that it saw there, if any. ``compare``: all pairs within a shard, without a graph."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def dealt(batches):
        for batch in batches:
            names = batch.schema.names
            v = matrix(batch.column(names.index("v")))
            near = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :overlap].astype(np.int32)
            for k in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near[:, k]), pa.array(np.full(len(v), k == 0)), *(batch.column(names.index(c)) for c in ("class", "v"))],
                    names=["shard", "nearest", "class", "v"],
                )

    placed = materialize(classes.mapInArrow(dealt, "shard int, nearest boolean, class long, v array<double>"), "shards")
    # One row per centre.
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes = F.broadcast(materialize(sizes, "shard-sizes"))
    placed = placed.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))

    def linked(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        edges = build(matrix(table.column("v")))
        return pa.table({"class": ids, "neighbours": pa.array([ids[e] for e in edges], pa.list_(pa.int64()))})

    def compared(names: np.ndarray, points: np.ndarray, ids: np.ndarray, v: np.ndarray):
        """The hits and the best others of asking vectors, a block at a time."""
        for at in range(0, len(ids), BLOCK):
            block = ids[at : at + BLOCK]
            near = v[at : at + BLOCK] @ points.T
            near[block[:, None] == names] = -np.inf
            best = near.argmax(axis=1)
            hit = near >= least
            top = near[np.arange(len(block)), best]
            alone = np.flatnonzero((top < least) & (top > -np.inf))
            i, j = np.nonzero(hit)
            i, j = np.concatenate((i, alone)), np.concatenate((j, best[alone]))
            yield block[i], names[j], near[i, j]

    def found(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, v = table.column("class").to_numpy(), matrix(table.column("v"))
        lists = table.column("neighbours").combine_chunks().to_pylist()
        stored = np.flatnonzero(~asks)
        stored = stored[np.argsort(ids[stored], kind="stable")]
        names, points = ids[stored], v[stored]
        if not len(names):
            return pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "score": np.empty(0)})
        if compare:
            parts = list(compared(names, points, ids[asks], v[asks]))
            a, b, score = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(score, pa.float64())})
        edges = []
        for row in stored:
            other = np.asarray(lists[row] or [], dtype=np.int64)
            at = np.minimum(np.searchsorted(names, other), len(names) - 1)
            edges.append(at[names[at] == other])
        edges = padded(edges)
        entries = medoids(points)
        a, b, score = [], [], []
        for row in np.flatnonzero(asks):
            own = int(np.searchsorted(names, ids[row]))
            stored_here = own < len(names) and names[own] == ids[row]
            starts = [*entries, own] if stored_here and own not in entries else entries
            hits, scores = in_range(v[row], points, edges, starts, least, own if stored_here else None)
            a.append(np.full(len(hits), ids[row]))
            b.append(names[hits])
            score.append(scores)
        none = np.empty(0, np.int64)
        return pa.table(
            {
                "a": np.concatenate((none, *a)),
                "b": np.concatenate((none, *b)),
                "score": np.concatenate((np.empty(0), *score)),
            }
        )

    if compare:
        stored = placed.select("shard", "part", F.lit(False).alias("asks"), "class", "v", F.lit(None).cast("array<long>").alias("neighbours"))
    else:
        lists = placed.groupBy("shard", "part").applyInArrow(linked, "class long, neighbours array<long>")
        # One list per shard of a class: at most ``overlap``.
        united = lists.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
        united = materialize(united, "adjacency")
        stored = placed.join(united, "class").select("shard", "part", F.lit(False).alias("asks"), "class", "v", "neighbours")
    asking = placed.where("nearest").select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(True).alias("asks"),
        "class",
        "v",
        F.lit(None).cast("array<long>").alias("neighbours"),
    )
    return stored.unionAll(asking).groupBy("shard", "part").applyInArrow(found, "a long, b long, score double")


def audit(classes: DataFrame, directed: DataFrame, links: DataFrame, least: float) -> bool:
    """Whether ``links`` (a, b) holds ``TARGET`` of the links, by comparing samples with all classes.

    Strata are classes with links, classes whose best cosine in ``directed`` is close to a link,
    and the rest. A stratum's misses are carried on from its sample, and unless all of it was
    sampled one more miss is taken to be in the sample: no miss seen among few is no evidence.
    Samples grow until the claim holds with that miss or fails without it; where links are so
    rare that no sample can tell, they grow to all classes.
    """
    spark = classes.sparkSession
    best = directed.groupBy(F.col("a").alias("class")).agg(F.max("score").alias("best"))
    ends = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class"))).distinct()
    level = F.when(F.col("linked"), 0).when(F.col("best") >= least - CLOSE, 1).otherwise(2)
    strata = classes.join(ends.withColumn("linked", F.lit(True)), "class", "left").join(best, "class", "left")
    strata = materialize(strata.select("class", "v", level.alias("stratum"), F.xxhash64("class", F.lit("audit")).alias("at")), "strata")
    sizes = {r["stratum"]: r["count"] for r in strata.groupBy("stratum").count().collect()}
    known = materialize(
        links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("x"), F.col("b").alias("y")),
        "both-ways",
    )
    found = known.count()
    misses, taken = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    last: dict[int, tuple[int, int]] = {}
    want = AUDITED
    while True:
        for stratum, size in sizes.items():
            while taken[stratum] < min(want, size):
                rest = strata.where(F.col("stratum") == stratum)
                if stratum in last:
                    at, cls = last[stratum]
                    rest = rest.where((F.col("at") > at) | ((F.col("at") == at) & (F.col("class") > cls)))
                # At most BLOCK vectors on the driver at a time.
                picked = rest.orderBy("at", "class").limit(min(BLOCK, min(want, size) - taken[stratum])).toPandas()
                last[stratum] = (int(picked["at"].iloc[-1]), int(picked["class"].iloc[-1]))
                taken[stratum] += len(picked)
                misses[stratum] += _missed(spark, classes, known, picked, least)
        sure = sum(sizes[s] / taken[s] * misses[s] for s in sizes)
        cautious = sum(sizes[s] / taken[s] * (misses[s] + (taken[s] < sizes[s])) for s in sizes)
        # Misses over all link ends; ``found`` counts each found link from both ends.
        if cautious <= (1 - TARGET) * (found + cautious):
            return True
        if sure > (1 - TARGET) * (found + sure):
            return False
        want *= MORE


def _missed(spark, classes: DataFrame, known: DataFrame, picked, least: float) -> int:
    """Link ends of the picked classes that ``known`` (x, y) lacks."""
    sample = spark.sparkContext.broadcast((picked["class"].to_numpy(), np.stack(picked["v"].to_numpy())))

    def exact(batches):
        ids, points = sample.value
        for batch in batches:
            names = batch.schema.names
            near = points @ matrix(batch.column(names.index("v"))).T >= least
            other = batch.column(names.index("class")).to_numpy()
            i, j = np.nonzero(near)
            real = ids[i] != other[j]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i][real]), pa.array(other[j][real])], names=["x", "y"])

    count = classes.mapInArrow(exact, "x long, y long").join(known, ["x", "y"], "left_anti").count()
    sample.unpersist()
    return count


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, overlap: int = 2
) -> DataFrame:
    """vec_id, n_links, component_id (the smallest id reachable), kept (it is its own)."""
    rows = valid(df, vec_id, embedding)
    every = df.select(F.col(vec_id).cast("long").alias("vec_id"))
    # Exact products first: equal vectors stay equal, and tiny or huge ones have a norm.
    big = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / big)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = rows.withColumn("v", scaled).withColumn("v", F.transform("v", lambda x: x / norm + F.lit(0.0)))
    members = materialize(unit, "units")
    of_members = every.sparkSession.createDataFrame([], "vec_id long, n_links long, component_id long")
    for width in sorted(r[0] for r in members.select(F.size("v")).distinct().collect()):
        of_members = of_members.unionAll(_linked(members.where(F.size("v") == width), least, overlap))
    # Rows that took no part: as many as the table has beyond the members, id by id.
    rest = every.exceptAll(members.select("vec_id")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return of_members.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(members: DataFrame, least: float, overlap: int) -> DataFrame:
    """vec_id, n_links, component_id of unit vectors (vec_id, v) of one length."""
    classes = materialize(members.groupBy("v").agg(F.min("vec_id").alias("class"), F.count("*").alias("members")), "classes")
    count = classes.count()
    picked = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("v").toPandas()
    centres = kmeans(np.stack(picked["v"].to_numpy()), min(CENTRES, -(-count // SHARD)))
    compare = False
    while True:
        directed = materialize(_search(classes.select("class", "v"), centres, overlap, least, compare), "directed")
        links = directed.where(F.col("score") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = materialize(links.distinct(), "links")
        if compare and overlap >= len(centres):
            break  # all pairs were compared
        if audit(classes.select("class", "v"), directed, links, least):
            break
        if compare:
            overlap *= 2
        compare = True
    sizes = classes.select("class", "members")
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionAll(
        links.select(F.col("b").alias("class"), F.col("a").alias("other"))
    )
    linked = ends.join(sizes.select(F.col("class").alias("other"), F.col("members").alias("n")), "other")
    linked = linked.groupBy("class").agg(F.sum("n").alias("linked"))
    found = components(links).select(F.col("node").alias("class"), "component")
    facts = (
        classes.join(linked, "class", "left")
        .join(found, "class", "left")
        .select(
            "v",
            (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("component_id"),
        )
    )
    facts = materialize(facts, "facts")
    return members.join(facts, "v").select("vec_id", "n_links", "component_id")
