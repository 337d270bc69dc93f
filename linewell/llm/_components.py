"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.sources.shared import checkpointed


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours re-linked to the least of them (edges have a > b).

    With ``larger`` a node re-links its larger neighbours, else itself and its
    smaller ones.  The least neighbour is a pre-aggregated minimum; a node with very
    many neighbours meets it in a join that Spark can split.
    """
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return linked.distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); the root is its component's least node.

    Any orderable type will do.  Self links and repeated links are harmless; a node
    named only in a self link is its own root.  Rounds are logarithmic in the
    longest path; each is checkpointed.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = checkpointed(flat.distinct())
    nodes = current.select(F.col("a").alias("node")).union(current.select("b")).distinct()
    current, seen = current.filter("a > b"), None
    while True:
        current = checkpointed(_stars(_stars(current, True), False))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
