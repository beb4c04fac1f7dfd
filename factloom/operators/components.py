"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: hang the larger (or the smaller) neighbours of a node on the least one.

    The least neighbour is a map-side combined aggregate that is joined back, so that
    the links of a hub are never gathered in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
    least = least.select("node", F.least("node", "low").alias("low"))
    hung = both.join(least, F.col("src") == F.col("node"))
    if large:
        out = hung.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = hung.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            least.select(F.col("node").alias("src"), F.col("low").alias("dst"))
        )
    return out.where(F.col("src") != F.col("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; a component is named by its least node.

    Self-loops give a node of its own; null endpoints are ignored. Rounds go on until one
    changes nothing; they are logarithmic in the number of nodes, and each is materialised
    in the checkpoint folder.
    """
    clean = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    clean = cut_lineage(clean.distinct())
    nodes = clean.select(F.col("src").alias("node")).union(clean.select("dst")).distinct()
    stars, mark = clean.where("src <> dst"), None
    while True:
        stars = cut_lineage(_star(_star(stars, large=True), large=False))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    named = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
