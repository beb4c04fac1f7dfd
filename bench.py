"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line with the best of several runs of each.

Facts of the events are replicated to ``FACTS`` or more (shifted copies with ids, entities and
transactions of their own), stored in system order and in key order, as ingest and compaction
leave them; statistics by chunk and key cell are stored beside them. ``load`` is that step.
The graph has 200 000 nodes and 800 000 edges. ``rates`` has rows a second, and the share of
facts that statistics allow a scan to skip.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
FACTS = int(os.environ.get("BENCH_FACTS", "2000000"))
NODES, EDGES = 200_000, 800_000


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from factloom import fixtures, queries
    from factloom.functions import columns as C
    from factloom.operators import graph, resolution, spatial, store
    from factloom.plans import compiler
    from factloom.plans.language import parse
    from factloom.runtime import cut_lineage, session

    folder = tempfile.mkdtemp(prefix="factloom-bench-")
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.checkpoint.dir": f"{folder}/checkpoints", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.ui.showConsoleProgress": "false"}
    spark = session("factloom-bench", f"local[{CPUS}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name: str, run, runs: int = RUNS) -> None:
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)

    began = time.perf_counter()
    one = cut_lineage(fixtures.facts(spark, SF_DIR, "event_id"))
    held = one.agg(F.count("*").alias("n"), F.max("sys_from").alias("txns"), F.max("entity").alias("e")).first()
    copies = max(1, -(-FACTS // held["n"]))
    many = one.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
    moved = {
        "fact_id": F.col("fact_id") + F.col("copy") * held["n"], "entity": F.col("entity") + F.col("copy") * (held["e"] + 1), "sys_from": F.col("sys_from") + F.col("copy") * held["txns"],
        "sys_to": F.when(F.col("sys_to") < C.OPEN_SYSTEM, F.col("sys_to") + F.col("copy") * held["txns"]).otherwise(F.col("sys_to")),
        "chunk": F.shiftright(F.col("fact_id") + F.col("copy") * held["n"], C.CHUNK_BITS),
    }
    many = many.withColumns(moved).select(*one.columns)
    for order in ("system", "space"):
        store.write_facts(many, f"{folder}/{order}", "overwrite", order, int(CPUS))
    facts, by_space = spark.read.parquet(f"{folder}/system"), spark.read.parquet(f"{folder}/space")
    store.chunk_stats(facts).coalesce(1).write.parquet(f"{folder}/chunks")
    store.key_cells(facts).coalesce(1).write.parquet(f"{folder}/cells")
    chunks, cells = spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/cells")
    times["load"] = round(time.perf_counter() - began, 4)
    n = facts.count()
    geo = by_space.where(F.col("attr") == "position")
    last, at = held["txns"] * copies, queries.T
    early = held["txns"] // 10

    def text(query: str):
        parsed = parse(query).query
        return compiler.points(compiler.entities(by_space, parsed, queries.BINDING, at, last, at + C.EPOCH_2000), parsed)

    timed("bitemporal_slice", lambda: store.slice_at(facts, at, last).agg(F.count("*"), F.sum("fact_id")))
    timed("early_slice", lambda: store.slice_at(facts, at, early).agg(F.count("*"), F.sum("fact_id")))
    timed("zone_map_prune", lambda: store.prune_counts(chunks, at, early))
    timed("where_order_limit", lambda: text(queries.FLAGSHIP))
    timed("bbox_filter", lambda: spatial.box_filter(geo, (10.0, 10.0, 20.0, 20.0)))
    timed("within_radius", lambda: text("quakes within 1500km of (10, 15)"))
    timed("knn_topk", lambda: spatial.nearest(geo, 15.0, 15.0, 10, reach_m=100_000.0))
    timed("point_projection", lambda: spatial.query_points(facts, at, last, "position", "magnitude"))
    recs = cut_lineage(queries.er_records(spark, SF_DIR))
    timed("entity_resolution", lambda: resolution.score(resolution.candidate_pairs(recs), recs))
    ends = spark.range(EDGES).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(NODES)).alias("src"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(NODES)).alias("dst"))
    ends = cut_lineage(ends)
    timed("graph_build", lambda: graph.build(ends, NODES))
    edges = cut_lineage(graph.build(ends, NODES))
    timed("khop_3", lambda: graph.khop(edges, 0, 3))
    timed("label_propagation_10", lambda: graph.label_propagation(edges, spark.range(NODES).withColumnRenamed("id", "node"), 10), 1)
    rates["slice_rows_per_sec"] = round(n / times["bitemporal_slice"])
    rates["er_records_per_sec"] = round(recs.count() / times["entity_resolution"])
    rates["graph_edges_per_sec"] = round(EDGES / times["graph_build"])
    rates["label_nodes_per_sec"] = round(NODES * 10 / times["label_propagation_10"])
    pruned = store.prune_counts(chunks, at, early).first()
    rates["zone_map_skipped"] = round(pruned["chunks_skipped"] / pruned["chunks_total"], 4)
    under = store.rows_in_ranges(cells, "position", spatial.box_ranges((10.0, 10.0, 20.0, 20.0))).first()[0]
    rates["bbox_skipped"] = round(1 - under / geo.count(), 4)
    total = round(sum(v for k, v in times.items() if k != "load"), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "rates": rates, "facts": n, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
