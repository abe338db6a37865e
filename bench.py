"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)

from harrow.entries import QUERIES, index  # noqa: E402
from harrow.session import local_session  # noqa: E402

HEADLINE = ["bm25_top", "bm25_and", "bm25_phrase", "bm25_prefix_at_zero", "bm25_facet", "bm25_ordering_scan", "query_set", "match_phrase", "match_near3", "match_fuzzy", "match_regex", "match_not", "count_queries", "term_stats", "anomalous_docs", "edit_distance_order_all", "substring_like", "substring_ilike", "nearest_l2", "nearest_query_set", "fused_l2", "reciprocal_rank_fusion", "snippet_all", "ingest_current", "scan_top", "scan_near3"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    begun = time.perf_counter()
    index(spark, sf_dir)
    times = {"index_build": round(time.perf_counter() - begun, 4)}
    QUERIES["bm25_top"](spark, sf_dir).collect()  # compiled code and file metadata are warm for all
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        times[name] = round(min(runs), 4)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
