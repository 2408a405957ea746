"""Connected components by alternating large and small stars, written to the shared folder after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, the root being the smallest node it reaches.

    ``edges`` has columns a and b of one type. Every round joins each edge to one minimum for each node, so a hub
    with many edges costs rows in proportion to its edges.
    """
    ends = lambda x, y: edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = saved(ends("a", "b").where("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = saved(small.where("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b"))).distinct()
