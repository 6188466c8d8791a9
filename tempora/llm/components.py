"""Connected components of a graph of links, by alternating large and small stars.

Each pass replaces a node's links by links to the smallest neighbour, found by partial aggregation, so the hub of a
large group is one row of a minimum and a join that can be split. Passes end when the links no longer change; the
number of passes grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tempora.session import materialize


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v): root is the smallest node that it is connected with."""
    edges = links.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = large.join(_smallest(large), "u")
        small = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node") \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
