"""Time the headline queries and print one JSON line.

The graph is stored once (timed as ``ingest``); the queries then run over the stored
tables, each once to warm up and three times for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hopline.model import PropertyGraph  # noqa: E402
from hopline.operators import (  # noqa: E402
    cells,
    checks,
    filters,
    hybrid,
    knn,
    measure,
    paths,
    pattern,
    synth,
    traverse,
)
from hopline.plans import commerce  # noqa: E402
from hopline.plans.catalog import DIM, EDGE_KEY, EDGE_ORDER, K, START, TARGET, TS_HI, TS_LO  # noqa: E402
from hopline.plans.lineage import scratch_path  # noqa: E402
from hopline.plans.session import recommended_settings  # noqa: E402
from hopline.sources import tables  # noqa: E402

WARMUP, RUNS = 1, 3


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hopline-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in recommended_settings().items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}

    def timed(name, run, warmup=WARMUP, runs=RUNS):
        for _ in range(warmup):
            run()
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 4)

    node_path, edge_path = scratch_path(spark, "nodes"), scratch_path(spark, "edges")

    def ingest():
        source = commerce.commerce_tables(spark, sf_dir)
        nodes, edges = commerce.commerce_nodes(source), commerce.commerce_edges(source)
        tables.materialise_clustered(nodes, node_path, ["id"])
        tables.materialise_clustered(edges, edge_path, EDGE_ORDER)

    timed("ingest", ingest, warmup=1, runs=1)
    graph = PropertyGraph.of(
        tables.read_nodes(spark, node_path), tables.read_edges(spark, edge_path), endpoints_ok=True
    )
    window = traverse.time_slice(graph, TS_LO, TS_HI)
    vectors = commerce.commerce_vectors(spark, sf_dir)
    query = list(vectors.orderBy("id").first()["embedding"])
    asked = vectors.select(
        F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    samples = commerce.samples(spark, sf_dir)

    timed("point_lookup", lambda: filters.point_lookup(graph, START).collect())
    timed("hop_1", lambda: traverse.walk_rows(graph, START, 1).collect())
    timed("hop_2", lambda: traverse.walk_rows(graph, START, 2).collect())
    timed("hop_3", lambda: traverse.walk_rows(graph, START, 3).collect())
    timed("hop_3_walks", lambda: traverse.walk_count(graph, START, 3).collect())
    timed("hop_3_ends", lambda: traverse.end_count(graph, START, 3).collect())
    timed("shortest_path", lambda: paths.shortest_length(graph, START, TARGET).collect())
    timed("shortest_route", lambda: paths.shortest_route(graph, START, TARGET).collect())
    timed("reach", lambda: drain(paths.reach(graph, START)))
    timed("filtered_traversal", lambda: traverse.walk_count(window, START, 3).collect())
    timed("filtered_ends", lambda: traverse.end_count(window, START, 3).collect())
    timed("filtered_simple", lambda: traverse.walk_count(window, START, 3, simple=True).collect())
    timed("pattern_match", lambda: pattern.triples(graph, "supplier", 1_000).collect())
    timed("pattern_match_set", lambda: pattern.distinct_triples(graph, "supplier", 1_000).collect())
    timed("pattern_count", lambda: pattern.triple_count(graph, "order").collect())
    timed("endpoint_check", lambda: checks.missing_endpoints(graph).collect())
    timed("keyed_upsert", lambda: drain(tables.latest_per_key(graph.edges, EDGE_KEY, "ts")))
    timed("vector_knn", lambda: knn.nearest(vectors, query, K).collect())
    timed("vector_knn_batch", lambda: drain(knn.nearest_many(vectors, asked, K, DIM)))
    timed(
        "hybrid_vector_hop",
        lambda: hybrid.distinct_neighbour_count(
            hybrid.neighbours_of_nearest(graph, vectors, query, K)
        ).collect(),
    )
    cell_path = scratch_path(spark, "cells")
    timed("index_build", lambda: cells.build_cells(vectors, cell_path, 32, DIM))
    index = cells.build_cells(vectors, cell_path, 32, DIM)
    timed("index_knn", lambda: cells.nearest_in_cells(spark, index, query, K, 4).collect())
    timed("sample_statistics", lambda: drain(measure.summarise(samples)))
    edges = graph.edges.count()
    timed("synth_edges", lambda: drain(synth.generate_edges(spark, 100_000, edges)))

    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "edges": edges,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
