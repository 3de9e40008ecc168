"""Headline timings, one JSON line.

Each query reads the whole tables at $BENCH_SF_DIR and is timed to its last row. The index
is built once (timed as ``index_build``); the searches read it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from duoglot_checks import queries as registered

HEADLINE = ("corpus_ingest", "csv_ingest", "fold_text", "query_analysis", "postings",
            "hash_encode", "knn_cosine", "knn_tiled", "knn_lsh", "bm25_topk", "bm25_fields",
            "hybrid_search", "hybrid_rrf", "search_lsh", "search_filtered", "search_fallback",
            "rerank_overlap", "named_vector_search", "extractive_answer", "rag_prompt",
            "retrieval_quality", "index_upsert")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("duoglot-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}

    def timed(name, run):
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    # Start the JVM's code paths and the Python workers outside the timings.
    registered.QUERIES["fold_text"](spark, folder).limit(1).collect()
    for kind in ("documents", "conversations"):
        timed(f"index_build_{kind}", lambda: registered._index(spark, folder, kind))
    for name in names:
        timed(name, lambda: registered.QUERIES[name](spark, folder)
              .write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total wall time of the headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
