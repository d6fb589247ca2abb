"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("knn_batch_topk", "knn_overfetch_filter", "bm25_ranked", "fts_match_count", "hybrid_search", "hybrid_filtered", "mmr_search", "parent_expansion", "connection_graph", "doctor", "index_actions", "eval_metrics", "dedup_hash", "frontmatter_violations")
#: Queries asked together in the batched runs.
BATCHES = (1, 100, 1000)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quarry.model import SearchOptions
    from quarry.plans import catalogue
    from quarry.plans.search import search
    from quarry.sources.index import stored

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalogue.queries(), {}
    began = time.perf_counter()
    stored(spark, SF_DIR)
    build = round(time.perf_counter() - began, 3)
    known[QUERIES[0]](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # a resident process is compared, so neither start nor index are timed
    for name in QUERIES:
        began = time.perf_counter()
        known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    batches = {}
    kb, asked = stored(spark, SF_DIR), catalogue.every_query(spark, SF_DIR)
    for n in BATCHES:  # the same few hundred queries again and again, under ids of their own
        few = asked.limit(min(n, 100)).crossJoin(spark.range(max(1, n // 100)).withColumnRenamed("id", "c")).select((F.col("query_id") * 1000 + F.col("c")).alias("query_id"), "query", "vector")
        began = time.perf_counter()
        search(kb, few, SearchOptions(limit=10)).write.format("noop").mode("overwrite").save()
        batches[str(n)] = round(n / (time.perf_counter() - began), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1], "index_build_sec": build, "hybrid_queries_per_sec_by_batch": batches}))
    spark.stop()


if __name__ == "__main__":
    main()
