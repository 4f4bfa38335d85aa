"""Connected components of links between 64-bit keys, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import stored


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v) but the roots: the root is the smallest node that can be reached.

    Each round hangs the larger neighbours of every node, then the smaller ones, under the smallest neighbour, and
    writes the links to shared storage. A hub is summed before the shuffle and its links are joined, never gathered
    in one row. The rounds grow with the logarithm of the longest chain. Self links and repeats do no harm.
    """
    edges = stored(links.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v u", "least(u, m) v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(u, m v), struct(v u, m v)))").where("u <> v").distinct()
        edges = stored(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.selectExpr("u node", "v root")
