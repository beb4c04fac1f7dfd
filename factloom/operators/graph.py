"""Undirected multigraphs as edge tables ``(src, dst, weight, ref)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.components import connected_components
from factloom.operators.store import dense_ids
from factloom.runtime import cut_lineage


#: Labels and frontiers are broadcast up to so many nodes, and joined by shuffle beyond.
BROADCAST_LABELS = 1_000_000
#: Rounds of a path search after which what has been seen is written out as one table.
MERGE_ROUNDS = 16


def build(edges: DataFrame, nodes: int) -> DataFrame:
    """Both directions of each edge between known nodes; multi-edges stay, a self-loop has two slots."""
    fine = edges.where(F.col("src").between(0, nodes - 1) & F.col("dst").between(0, nodes - 1))
    turned = [F.col("dst").alias("src"), F.col("src").alias("dst")]
    rest = [c for c in fine.columns if c not in ("src", "dst")]
    return fine.select("src", "dst", *rest).unionByName(fine.select(*turned, *rest))


def degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def neighbours(graph: DataFrame, node: int) -> DataFrame:
    """Neighbours of a node with the edges' weights and provenance."""
    return graph.where(F.col("src") == node).drop("src").withColumnRenamed("dst", "node")


def khop(graph: DataFrame, source: int, hops: int) -> DataFrame:
    """``(node, depth)`` of the nodes within ``hops`` of the source, without the source."""
    spark = graph.sparkSession
    seen = spark.createDataFrame([(source, 0)], "node long, depth int")
    front = seen
    for depth in range(1, hops + 1):
        reached = graph.join(front, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(reached.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def shortest_path(graph: DataFrame, a: int, b: int) -> DataFrame:
    """``(step, node)`` of a shortest path with both ends; empty if there is none.

    Two frontiers grow, the smaller first, each node keeping its least parent, until a node
    is seen from both sides; the path is then read back parent by parent.
    """
    spark = graph.sparkSession
    schema = "step int, node long"
    if a == b:
        return spark.createDataFrame([(0, a)], schema)
    sides = [spark.createDataFrame([(x, None, 0)], "node long, parent long, depth int") for x in (a, b)]
    fronts, sizes, depths = list(sides), [1, 1], [0, 0]
    near = graph.select("src", "dst").repartition("src").persist()
    try:
        return _met(near, sides, fronts, sizes, depths)
    finally:
        near.unpersist()


def _met(near: DataFrame, sides: list[DataFrame], fronts: list[DataFrame], sizes: list[int], depths: list[int]) -> DataFrame:
    """The path between the origins of two sides, each grown from its front over the edges ``near``."""
    spark, schema = near.sparkSession, "step int, node long"
    while True:  # each round sees new nodes or ends, so there are at most as many as nodes
        k = 0 if sizes[0] <= sizes[1] else 1
        depths[k] += 1
        front = fronts[k].select("node")
        step = near.join(F.broadcast(front) if sizes[k] <= BROADCAST_LABELS else front, F.col("src") == F.col("node"))
        step = step.groupBy(F.col("dst").alias("next")).agg(F.min("src").alias("parent")).withColumnRenamed("next", "node")
        step = step.join(sides[k].select("node"), "node", "left_anti").select("node", "parent", F.lit(depths[k]).alias("depth"))
        fronts[k] = cut_lineage(step)
        other = sides[1 - k].select(F.col("node").alias("seen"))
        sizes[k], met = fronts[k].join(other, F.col("node") == F.col("seen"), "left").agg(F.count("*"), F.min("seen")).first()
        if not sizes[k]:
            return spark.createDataFrame([], schema)
        sides[k] = sides[k].unionByName(fronts[k])
        if depths[k] % MERGE_ROUNDS == 0:
            sides[k] = cut_lineage(sides[k])
        if met is not None:
            halves = [_trace(sides[i], met) for i in range(2)]
            path = halves[0][::-1] + halves[1][1:]
            return spark.createDataFrame(list(enumerate(path)), schema)


def _trace(side: DataFrame, node: int | None) -> list[int]:
    """Nodes from the meeting point back to the side's origin; one look-up per step of the path."""
    path = []
    while node is not None:
        path.append(node)
        node = side.where(F.col("node") == node).agg(F.max("parent")).first()[0]
    return path


def label_propagation(graph: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``(node, label)``: each round every node takes its neighbours' most frequent label, the least of equals.

    Edges are dealt by their source once and kept, so votes are counted where they lie; labels
    travel, by broadcast while there are few (their number is that of the nodes).
    """
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    near = graph.select("src", "dst").repartition("src").persist()
    few = labels.count() <= BROADCAST_LABELS
    for _ in range(rounds):
        votes = near.join(F.broadcast(labels) if few else labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("label")).alias("back"))).alias("top"))
        best = best.select(F.col("src").alias("node"), (-F.col("top.back")).alias("next"))
        moved = cut_lineage(labels.join(best, "node", "left").select("node", F.coalesce("next", "label").alias("label"), F.coalesce(F.col("next") != F.col("label"), F.lit(False)).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            break
    near.unpersist()
    return labels


def components(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)``, numbered by least node."""
    found = connected_components(graph.select("src", "dst")).withColumnRenamed("component", "root")
    rooted = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    ranks = dense_ids(rooted.select("root").distinct().withColumn("at", F.col("root")), "root", "at")
    return rooted.join(ranks, "root").select("node", F.col("entity_id").alias("component"))


def chain_roots(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``(child, root)`` of supersession chains by pointer doubling; of a cycle, the least member.

    ``links`` has one parent per child. A pointer doubles its reach each round while it keeps
    the least node that it has passed, which names a cycle once it has been round it.
    """
    one = links.groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("up"))
    ends = one.select(F.col("up").alias("node")).join(one, "node", "left_anti").distinct()
    jump = one.unionByName(ends.select("node", F.col("node").alias("up"))).withColumn("low", F.least("node", "up"))
    jump = cut_lineage(jump)
    for _ in range(64):
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("low").alias("far_low"))
        now = jump.join(far, "up").select("node", F.col("far").alias("up"), F.least("low", "far_low").alias("low"), (F.col("far") != F.col("up")).alias("moved"), (F.col("far_low") < F.col("low")).alias("lower"))
        now = cut_lineage(now)
        stuck = now.where("lower").isEmpty() and now.where("moved").join(now.select(F.col("node").alias("up"), F.col("up").alias("u2")), "up").where("up = u2").isEmpty()
        jump = now.select("node", "up", "low")
        if stuck:
            break
    settled = jump.join(ends.select(F.col("node").alias("end")), F.col("up") == F.col("end"), "left")
    low_of = jump.select(F.col("node").alias("up"), F.col("low").alias("cycle"))
    named = settled.join(low_of, "up", "left")
    roots = named.select("node", F.when(F.col("end").isNotNull(), F.col("end")).otherwise(F.col("cycle")).alias("root"))
    return one.select("node").join(roots, "node").select(F.col("node").alias(child), "root")
