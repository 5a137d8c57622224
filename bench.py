"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR is the data folder (default sf0.1), BENCH_CPUS the local cores,
BENCH_QUERIES an optional comma list.  Each query is timed once, to a no-op sink.
Before that it runs untimed on the smallest folder beside the data folder, so
that the JVM has compiled it and Python workers are up (BENCH_WARM=0 skips this).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from labelwright.queries import all_queries
from labelwright.session import get_spark

HEADLINE = [
    "label_scan_verdicts", "label_value_totals", "first_declarations_per_package", "document_declarations",
    "commodity_class", "label_scan", "column_clusters", "reading_order", "package_verdict", "provision_trigger",
    "token_document_frequency", "bm25_documents", "bm25_provisions", "dense_topk", "exact_provisions",
    "intent_normalise", "hybrid_fusion", "rerank_composite", "retrieval_metrics", "provision_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_spark("labelwright-bench", cores, spark__sql__shuffle__partitions=cores, spark__driver__memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).repartition(int(cores)).mapInArrow(lambda it: it, "id long").agg(F.sum("id")).collect()
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    warm = os.environ.get("BENCH_WARM", "1") != "0" and os.path.isdir(small)
    times = {}
    for name in names:
        if warm:
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "warmed_up": warm,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
