"""Near-duplicate documents by a grouped prefix join on word-shingle sets.

Two documents link when ``100 * |A n B| >= percent * |A u B|``. If they do, their prefixes
(the first ``n - ceil(n * percent / 100) + 1`` shingles in one global order) share a shingle.
The order puts shingles that many documents share last, so prefixes hold rare ones.

1. ``signatures``: one row per document with set size, set digest and prefix. Documents with
   one set are a class, classes with one prefix and size are a group; only groups are joined.
2. Star round: every group meets the smallest group of each prefix shingle, every class the
   first class of its group. Verified links give components, so a family of copies costs
   pairs in proportion to its members.
3. Exact round: all group pairs that share a prefix shingle, pass the filters and are not yet in
   one component are expanded to classes and verified. The filters stand in the join: sizes;
   what is left behind the shared shingle on either side suffices; and, for groups of one set,
   a bitmap of at most ``SKETCH`` longs. Behind it, the number of shared prefix shingles must
   do with what lies behind the prefixes. After it, every pair that could link was either
   verified or lies in one component.

Candidates pass an exact bound before their sets are compared: each set has a bitmap of about
one bit per shingle, the parity of its shingles per bit. Bitmaps differ in no more bits than
sets in shingles, so a pair with too many different bits cannot link. Sets are compared only
for the classes that are left; their texts are read again.

Defined results: null, empty and blank texts have no shingles and link with nothing; shorter
texts than a shingle are one shingle; repeated rows get one row each; a row without an id
links with nothing and has no component; an id is one document, and one that occurs with several
texts brings the links of each (ids are to be unique); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runtally.llm.components import components
from runtally.llm.words import bounded_batches, mixed, portions, shingles, texts_words, trimmed
from runtally.session import delete_path, materialize, scratch_path, tidy_shuffles

#: A shingle in at least so many documents of one Arrow batch counts as common, and so many
#: of the most common ones are put last. Both shape the order only; any order gives all links.
COMMON, ORDERED = 16, 1 << 17
#: Longs of the bitmap that a posting of the exact round carries.
SKETCH = 4
#: Characters of text whose words are hashed at once.
PORTION = 1 << 19


def _sets(texts: pa.Array, width: int):
    for some in portions(texts, PORTION):
        words, ends = texts_words(some)
        for k in range(len(some)):
            yield shingles(words[ends[k] : ends[k + 1]], width)


def common_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``ORDERED`` common shingles in ascending order with their counts."""

    def work(batches):
        for batch in batches:
            found = [s for s in _sets(batch.column(0), width)]
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            often = counts >= COMMON
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "docs"]
            )

    seen = docs.select(F.col(text).cast("string")).mapInArrow(trimmed(work), "shingle long, docs long")
    top = seen.groupBy("shingle").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "shingle").limit(ORDERED)
    rows = top.toPandas()
    values = rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], rows["docs"].to_numpy(dtype=np.int64)[order]


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """doc_id, n, sig_a, sig_b (digest of the set), prefix, bits (arrays of long) of each document."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, width))

    def work(batches):
        known, counts = common.value
        for batch in batches:
            n, a, b, prefixes, bits = [], [], [], [], []
            for found in _sets(batch.column(1), width):
                size = len(found)
                n.append(size)
                spread = mixed(found)
                a.append(int(spread.sum(dtype=np.uint64).view(np.int64)))
                b.append(int(np.bitwise_xor.reduce(mixed(spread ^ np.uint64(size))).view(np.int64)) if size else 0)
                keep = size - (percent * size + 99) // 100 + 1 if size else 0
                if len(known) and size:
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = np.where(known[at] == found, counts[at], 0)
                    found = found[np.argsort(often, kind="stable")]
                prefixes.append(found[:keep].view(np.int64))
                bits.append(parities(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "sig_a", "sig_b", "prefix", "bits"],
            )

    plain = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return plain.mapInArrow(trimmed(work), "doc_id long, n long, sig_a long, sig_b long, prefix array<long>, bits array<long>")


def parities(found: np.ndarray) -> np.ndarray:
    """Longs of a bitmap whose size is the power of two from the set's size on, 64 at least.
    Halves folded by XOR give the bitmap of half the size."""
    size = max(64, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((mixed(found) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _different(a: str, b: str) -> Column:
    """Different bits of two bitmaps, the larger folded to the smaller."""
    half = lambda c: F.zip_with(
        F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")),
        F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")),
        lambda x, y: x.bitwiseXOR(y),
    )
    left = F.when(F.size(a) > F.size(b), half(F.col(a))).otherwise(F.col(a))
    right = F.when(F.size(b) > F.size(a), half(F.col(b))).otherwise(F.col(b))
    bits = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)


def _folded(bits: str) -> Column:
    """A bitmap of at most ``SKETCH`` longs: places of a larger one that agree modulo its size, xored."""
    longs = F.sequence(F.lit(0), F.lit(SKETCH - 1))
    small = F.transform(
        longs,
        lambda i: F.aggregate(
            F.filter(F.col(bits), lambda _, k: k % SKETCH == i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)
        ),
    )
    return F.when(F.size(bits) <= SKETCH, F.col(bits)).otherwise(small)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two sets that share the shingle at their places ``pos`` can link, by sizes and places."""
    i, j, nx, ny = F.col(f"{x}.pos"), F.col(f"{y}.pos"), F.col(f"{x}.n"), F.col(f"{y}.n")
    shared = F.least(i, j) + 1 + F.least(nx - i, ny - j) - 1
    return _sizes_fit(f"{x}.n", f"{y}.n", percent) & (shared * (100 + percent) >= (nx + ny) * percent)


def _enough(common: str, x: str, y: str, percent: int) -> Column:
    """Whether sets of ``x`` and ``y`` shingles that share ``common`` prefix shingles can link.

    One of the prefixes ends first in the order; shingles behind it are all that its set can
    share besides the common ones.
    """
    behind = F.ceil(F.greatest(x, y) * percent / 100).cast("long") - 1
    return (F.col(common) + behind) * (100 + percent) >= (F.col(x) + F.col(y)) * percent


def full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """node, shingles: array<long> for the documents that are nodes."""

    def work(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in _sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    plain = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    return plain.join(nodes, "node", "leftsemi").mapInArrow(trimmed(work), "node long, shingles array<long>")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, or its own)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, "jaccard")
    try:
        with tidy_shuffles(spark):
            return _similar(docs, doc_id, text, width, percent, folder)
    except BaseException:
        delete_path(spark, folder)
        raise


def _similar(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, folder: str) -> DataFrame:
    """``similar_documents`` with its intermediate results in ``folder``: each is deleted once all that
    read it are stored, so that they do not add up on disk; what the result reads stays."""
    keep = lambda df, name: materialize(df, name, folder)

    def drop(*names: str) -> None:
        for name in names:
            delete_path(docs.sparkSession, f"{folder}/{name}")

    signed = keep(signatures(docs, doc_id, text, width, percent), "signatures")
    digests = keep(signed.select("doc_id", "n", "sig_a", "sig_b"), "digests")
    sets = signed.where("n > 0 AND doc_id IS NOT NULL")
    key = F.xxhash64("n", "prefix")
    classes = keep(
        sets.groupBy("n", "sig_a", "sig_b").agg(
            F.min("doc_id").alias("class"), F.count("*").alias("docs"), F.min(key).alias("prefix_key")
        ),
        "classes",
    )

    facts = sets.select(F.col("doc_id").alias("node"), "n", "bits")

    sizes = facts.select("node", "n").distinct()

    def verified(pairs: DataFrame, stage: str) -> DataFrame:
        """The linked ones of (a, b) class pairs, a < b; reads what is kept as ``stage``.

        Sizes alone rule out most pairs; bitmaps travel for the nodes of the others only.
        """
        pairs = pairs.distinct()
        for end in "ab":
            pairs = pairs.join(sizes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end)
        fitting = keep(pairs.where(_sizes_fit("n_a", "n_b", percent)), f"{stage}/fitting")
        ends = fitting.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = keep(facts.join(ends, "node", "leftsemi"), f"{stage}/bitmaps")
        near = fitting
        for end in "ab":
            near = near.join(known.select(*(F.col(c).alias(x) for c, x in (("node", end), ("n", f"n_{end}"), ("bits", f"bits_{end}")))), [end, f"n_{end}"])
        # 100 s >= percent (na + nb - s) with s = (na + nb - d) / 2 bounds the difference d
        room = (F.col("n_a") + F.col("n_b")) * (100 - percent)
        near = near.where(_different("bits_a", "bits_b") * (100 + percent) <= room)
        near = keep(near.select("a", "b", "n_a", "n_b").distinct(), f"{stage}/candidates")
        drop(f"{stage}/fitting", f"{stage}/bitmaps")
        nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = keep(full_sets(docs, keep(nodes, f"{stage}/nodes"), doc_id, text, width), f"{stage}/sets")
        left = near.join(texts.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        shared = F.size(F.array_intersect("left", "right"))
        return both.where(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent).select("a", "b").distinct()

    # Groups of classes with one size and prefix; the first class stands for the group.
    grouped = classes.groupBy("n", "prefix_key").agg(F.min("class").alias("group"))
    member = keep(
        classes.join(grouped, ["n", "prefix_key"]).select("class", "n", "group"), "members"
    )
    leaders = member.where("class = group").select(F.col("class").alias("doc_id"))
    prefixes = sets.select("doc_id", "prefix").join(leaders, "doc_id", "leftsemi")
    exploded = prefixes.select(F.posexplode("prefix").alias("pos", "shingle"), F.col("doc_id").alias("group"))
    # A query of its own: all prefix shingles are shuffled here and again in the join behind it, and
    # of the two only one lies on disk at a time.
    several = keep(
        exploded.groupBy("shingle")
        .agg(F.min("group").alias("pivot"), F.max("group").alias("last"))
        .where("pivot <> last")
        .select("shingle", "pivot"),
        "several",
    )
    postings = keep(exploded.join(several, "shingle"), "postings")
    drop("several")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    star_pairs = (
        postings.where("group <> pivot")
        .select(*ordered("group", "pivot"))
        .unionAll(member.where("class <> group").select(*ordered("group", "class")))
    )
    links = keep(verified(star_pairs, "star"), "star-links")
    drop("star")
    found = keep(components(links), "star-components")

    # Exact round: what shares a shingle and is not in one component yet.
    owned = member.join(found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    owned = keep(owned, "owned")
    spans = owned.groupBy("group").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max("n").alias("n"), F.count("*").alias("sets")
    )
    places = postings.select("shingle", "group", "pos")
    within = places.join(spans.select("group", "low", "high"), "group")
    mixed_shingles = within.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h")
    left_open = keep(places.join(mixed_shingles.select("shingle"), "shingle", "leftsemi"), "left-open")
    drop("postings", "star-components")
    # Sizes and bitmaps meet the narrow postings last; a group of several sets has no one bitmap.
    groups = spans.join(left_open.select("group").distinct(), "group", "leftsemi")
    sketches = facts.select(F.col("node").alias("group"), _folded("bits").alias("bits")).dropDuplicates(["group"])
    alone = groups.where("sets = 1").select("group").join(sketches, "group")
    described = keep(groups.join(alone, "group", "left"), "groups")
    open_postings = keep(left_open.join(described, "group"), "open")
    drop("left-open", "groups")
    one, two = open_postings.alias("x"), open_postings.alias("y")
    room = (F.col("x.n") + F.col("y.n")) * (100 - percent)
    near = F.coalesce(_different("x.bits", "y.bits") * (100 + percent) <= room, F.lit(True))
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    group_pairs = (
        one.join(two, F.expr("x.shingle = y.shingle AND x.group < y.group") & apart & _may_link("x", "y", percent) & near)
        .groupBy(F.col("x.group").alias("g"), F.col("y.group").alias("h"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny"))
        .agg(F.count("*").alias("common"))
        .where(_enough("common", "nx", "ny", percent))
        .select("g", "h")
        .unionAll(spans.where("low <> high").select(F.col("group").alias("g"), F.col("group").alias("h")))
    )
    firsts = owned.select(
        F.col("group").alias("g"), F.col("class").alias("ca"), F.col("component").alias("ka")
    )
    seconds = owned.select(
        F.col("group").alias("h"), F.col("class").alias("cb"), F.col("component").alias("kb")
    )
    class_pairs = (
        group_pairs.join(firsts, "g").join(seconds, "h").where("ka <> kb AND (g <> h OR ca < cb)")
    ).select(*ordered("ca", "cb"))
    more = verified(class_pairs, "exact")
    drop("signatures", "open", "members", "owned")
    every = keep(links.unionAll(more), "links")
    drop("exact", "star-links")
    component = keep(components(every), "components")
    drop("links")
    by_set = (
        classes.join(component.select(F.col("node").alias("class"), "component"), "class", "left")
        .select("n", "sig_a", "sig_b", F.coalesce("component", "class").alias("component_id"), "docs", "class")
        .where("docs > 1 OR component_id <> class")
        .select("n", "sig_a", "sig_b", "component_id")
    )
    rows = digests.join(by_set, ["n", "sig_a", "sig_b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
