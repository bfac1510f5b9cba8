"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm._common import dropped, staged


def connected(edges: DataFrame) -> DataFrame:
    """Components of the graph whose edges are rows (u, v).

    Returns one row (node, component) for every node that is not the smallest of its component;
    the component is that smallest node. Self loops and repeated edges are allowed, null ends
    are ignored. Each round keeps a linear number of edges; a hot node is a skewed join key that
    AQE splits, since both sides of each join are plain shuffles of stored tables.
    """
    e = staged(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        print_of = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if print_of == before or not print_of[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = print_of
        # large star: every larger neighbour of a node meets the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        dropped(e)
        dropped(least)
        # small star: every smaller neighbour of a node, and the node, meet the smallest one
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(least, "u")
        e = staged(
            linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        dropped(large)
        dropped(least)
