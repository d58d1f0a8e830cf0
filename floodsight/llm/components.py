"""Connected components of links, as rounds of joins (large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links(a, b)`; component is the smallest node reachable.

    Each round points every node at the smallest node of its neighbourhood, first for the larger
    neighbours and then for the smaller ones, until nothing changes. Only minima are grouped, so a
    node with very many links is combined before the shuffle. The links stay on the executors; each
    round is a table in the shared folder.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct(), "links")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
    return tuple(row)
