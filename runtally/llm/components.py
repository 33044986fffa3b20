"""Connected components of an edge table by alternating large-star and small-star steps.

Each step joins every node's neighbours with the smallest of them; after about log(n) rounds
every node hangs on the smallest node of its component. Hubs are met by map-side minima and
by joins that adaptive execution splits. Each round is written to the shared folder, so a
lost executor costs one round at most, and nothing but two totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.session import materialize


def _totals(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the smallest node reachable.

    Null ends, loops and repeated edges are ignored; an empty table gives an empty table.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    before = _totals(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        after = _totals(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
