"""Prefix trie of conversations by ROLLUP over positional turn columns.

A node of depth d is a distinct sequence of first d turns (role, text). Every conversation is cut
into blocks of ``BLOCK`` turns, one row each, with a column per position; one
``GROUP BY block, prior, ROLLUP (t1, ..., tB)`` then aggregates all prefixes of all blocks at once,
and ``grouping_id`` tells the depth of a group. ``prior`` is the node where the block begins, so a
long conversation goes on in further blocks without a join and without a loop.

Turns and nodes are named by two 64-bit hashes: a turn's hash mixes its place, and a node's is the
xor of its turns', so that the name of any prefix is a running xor. Texts are hashed and measured
where they are read and never shuffled.

Sums over a subtree need no walk either. A node is *owned* by its smallest member; a conversation
owns the nodes from where it leaves all smaller ones down to its end. So the nodes of a subtree are
what its members own, less the part of its smallest member's that lies above the node. A first
rollup finds owners, a second one adds up what the members own.

How it runs. A conversation is sorted by one window (which spills) and never gathered; a prefix
that a third of all conversations share is counted map-side. ``ends`` is a hash over all
members that end at a node, in order: they are joined to short strings per range of 4,096 ids
first, so that the one task which must see them all in order streams few rows and holds one.

Defined results: turns are ordered by ``turn``, nulls first, equal ones by the hash of role and
text; a null role or text is empty; repeated rows are turns of their own; rows without an id are
in no conversation; empty texts are turns like others; an empty table has no node, not even a root;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runtally.session import materialize, staging

#: Turn columns of a block. A row meets the rollup once per column, whatever the length of
#: its conversation.
BLOCK = 8
#: Ids joined to one string before they are hashed.
ID_RANGE = 4096


def _hash(seed: int, *of: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def numbered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), a, b (hashes of role and text), size (code points of the text)."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    turns = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        _hash(1, *said).alias("a"),
        _hash(2, *said).alias("b"),
        F.length(said[1]).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "a", "b")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "a", "b", "size")


def rebuilt(turns: DataFrame, family: int = 100, spread: int = 6) -> DataFrame:
    """Conversations that share beginnings: conversation c takes the first ``crc32(c) % spread``
    turns of conversation c - c % family and goes on with its own later ones.

    ``turns`` as from ``numbered``; one more row of each conversation, at position 0, stands for
    its beginning, so that it is there even without turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    # at most spread - 1 turns of one conversation in ``family``
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < spread))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("head")
    )
    # the beginning carries the head's turns along
    known = turns.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    known = known.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h")))
    beginning = F.struct(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("size"))
    own = F.struct((F.size("head") + F.col("pos") - F.col("h")).alias("pos"), "a", "b", "size")
    made = F.concat(
        F.when(F.col("pos") == 1, F.concat(F.array(beginning), F.col("head"))).otherwise(F.array().cast(heads.schema["head"].dataType)),
        F.when(F.col("pos") > F.col("h"), F.array(own)).otherwise(F.array().cast(heads.schema["head"].dataType)),
    )
    return known.select("conv_id", F.inline(made))


def blocks(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """A row per conversation and block: conv_id, block, prior (the node where it begins: pa, pb and
    its code points psize), t1 to t<width> (a, b, size), total and n_turns of the whole
    conversation, and its last node (ea, eb)."""
    placed = turns.select(
        "conv_id",
        F.when(F.col("pos") > 0, F.expr(f"(pos - 1) div {width}")).otherwise(F.lit(0)).cast("int").alias("block"),
        F.when(F.col("pos") > 0, (F.col("pos") - 1) % width).otherwise(F.lit(-1)).alias("place"),
        F.when(F.col("pos") > 0, _hash(3, "pos", "a")).otherwise(F.lit(0)).cast("long").alias("a"),
        F.when(F.col("pos") > 0, _hash(4, "pos", "b")).otherwise(F.lit(0)).cast("long").alias("b"),
        "size",
    )
    # at most ``width`` turns, in order
    cell = F.when(F.col("place") >= 0, F.struct("place", F.struct("a", "b", "size").alias("turn")))
    rows = placed.repartition("conv_id").groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(cell)).alias("turns"),
        F.bit_xor("a").alias("xa"),
        F.bit_xor("b").alias("xb"),
        F.sum("size").alias("xsize"),
    )
    rows = rows.withColumn("xturns", F.size("turns").cast("long"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return rows.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("xa").over(before), zero).alias("pa"),
        F.coalesce(F.bit_xor("xb").over(before), zero).alias("pb"),
        F.coalesce(F.sum("xsize").over(before), zero).alias("psize"),
        *[F.get("turns", F.lit(i))["turn"].alias(f"t{i + 1}") for i in range(width)],
        F.sum("xsize").over(whole).alias("total"),
        F.sum("xturns").over(whole).alias("n_turns"),
        F.bit_xor("xa").over(whole).alias("ea"),
        F.bit_xor("xb").over(whole).alias("eb"),
    )


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """The nodes of all blocks: depth, na, nb (name), ma, mb (the parent's name), above (code points
    before the last turn), last (those of the last turn), and ``sums``."""
    turns = [f"t{i + 1}" for i in range(width)]
    grouped = rows.sparkSession.sql(
        f"SELECT block, pa, pb, psize, {', '.join(turns)}, grouping_id() AS gid, {sums} "
        f"FROM {{rows}} GROUP BY block, pa, pb, psize, ROLLUP ({', '.join(turns)})",
        rows=rows,
    )
    # the last columns of a group of level d are rolled up: width - d bits are set
    level = F.expr(f"{width} - bit_count(gid)")
    # at its level's column a group that lies behind the end of its conversations has a null
    held = F.expr(f"if(level = 0, block = 0, element_at(array({', '.join(turns)}), greatest(level, 1)) IS NOT NULL)")

    def xor(name: str, part: str, upto: int) -> Column:
        terms = [F.expr(f"if(level > {i + upto}, coalesce(t{i + 1}.{part}, 0L), 0L)") for i in range(width)]
        out = F.col(name)
        for term in terms:
            out = out.bitwiseXOR(term)
        return out

    before = F.col("psize")
    for i in range(width):
        before = before + F.expr(f"if(level > {i + 1}, coalesce(t{i + 1}.size, 0L), 0L)")
    aggregates = [c for c in grouped.columns if c not in {"block", "pa", "pb", "psize", "gid", *turns}]
    return (
        grouped.withColumn("level", level)
        .where(held)
        .select(
            (F.col("block") * width + F.col("level")).cast("long").alias("depth"),
            xor("pa", "a", 0).alias("na"),
            xor("pb", "b", 0).alias("nb"),
            xor("pa", "a", 1).alias("ma"),
            xor("pb", "b", 1).alias("mb"),
            before.alias("above"),
            F.expr(f"coalesce(element_at(array({', '.join(turns)}), greatest(level, 1)).size, 0L)").alias("last"),
            *aggregates,
        )
    )


def _hashed_ends(rows: DataFrame) -> DataFrame:
    """na, nb, ends_sha256 of the nodes that conversations end at (depth > 0 or not)."""
    ends = rows.where("block = 0").select(F.col("ea").alias("na"), F.col("eb").alias("nb"), "conv_id")
    span = F.expr(f"conv_id div {ID_RANGE}")
    joined = ends.groupBy("na", "nb", span.alias("span")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def row() -> pa.RecordBatch:
            values = {"na": [name[0]], "nb": [name[1]], "ends_sha256": [state.hexdigest()]}
            kinds = {"na": pa.int64(), "nb": pa.int64(), "ends_sha256": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(values[c], t) for c, t in kinds.items()], names=list(kinds))

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ids"))):
                if name == (a, b):
                    state.update(b",")
                else:
                    if name is not None:
                        done.append(row())
                    name, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if len(done) > 0:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if name is not None:
            yield row()

    dealt = joined.repartition("na", "nb").sortWithinPartitions("na", "nb", "span")
    return dealt.select("na", "nb", "ids").mapInArrow(digest, "na long, nb long, ends_sha256 string")


def trie(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """All nodes of the conversations in ``turns`` (conv_id, pos from 1, a, b, size; a row at position
    0 stands for the beginning of each): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    with staging(turns.sparkSession, "trie") as keep:
        return materialize(_nodes(turns, width, keep), "trie-result")


def _nodes(turns: DataFrame, width: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    rows = keep(blocks(turns, width), "blocks")
    # who owns what: a conversation's own nodes have it as their smallest member
    owned = keep(
        _rollup(rows, width, "min(conv_id) AS conv_id, max(n_turns) AS longest")
        .groupBy("conv_id")
        .agg(
            F.sum("last").alias("owned"),
            F.min("above").alias("shared"),
            F.max(F.expr("int(longest = depth)")).cast("long").alias("leaf"),
        ),
        "owned",
    )
    weighed = rows.join(owned.select("conv_id", "owned", "leaf"), "conv_id", "left").na.fill(0, ["owned", "leaf"])
    nodes = keep(
        _rollup(
            weighed,
            width,
            "min(conv_id) AS conv_id, count(1) AS n_convs, sum(total) AS total, sum(owned) AS owned, sum(leaf) AS n_leaves",
        ),
        "nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("ma").alias("na"), F.col("mb").alias("nb")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    # one row per node that has children: what its children and the node itself need of it
    parents = nodes.join(children, ["na", "nb"], "left")
    heads = parents.where("n_children IS NOT NULL").select(
        F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("conv_id").alias("parent_conv_id")
    )
    below = parents.join(heads, ["ma", "mb"], "left").join(owned.select("conv_id", "shared"), "conv_id")
    ended = below.join(_hashed_ends(rows), ["na", "nb"], "left")
    of_members = F.col("total") - F.col("n_convs") * F.col("above")
    of_nodes = F.col("owned") - (F.col("above") - F.col("shared"))
    return ended.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        (of_members - of_nodes).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
