"""Connected components by alternating star contraction, and cluster merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.session import cut_lineage


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest node of its neighbourhood. Only minima and
    edges move between tasks: the work per round is linear in the edges, hubs included."""
    if larger_only:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    smallest = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = sides.join(smallest, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(smallest.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list (a, b); the root is the smallest node."""
    current = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda f: tuple(f.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(current)
    for _ in range(max_rounds):
        current = cut_lineage(_stars(_stars(current, True), False))
        after = mark(current)
        if after == before:
            roots = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merge_clusters(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """``membership`` (uniprot_id, cluster_id) with the clusters of every pair merged under the smallest id."""
    side = lambda c, n: membership.select(F.col("uniprot_id").alias(c), F.col("cluster_id").alias(n))
    edges = pairs.join(side("reference_id", "a"), "reference_id").join(side("query_id", "b"), "query_id").select("a", "b")
    roots = components(edges).select(F.col("node").alias("cluster_id"), "root")
    return membership.join(roots, "cluster_id", "left").select("uniprot_id", F.coalesce("root", "cluster_id").alias("cluster_id"), F.col("cluster_id").alias("previous_id"))


def absorbed(merged: DataFrame) -> DataFrame:
    return merged.where("cluster_id <> previous_id").agg(F.count_distinct("previous_id").alias("absorbed"))
