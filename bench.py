"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {"q": sec, ...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver).  One warm-up query starts the
JVM and Python workers before timing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pre_rank", "url_hash", "content_hash", "word_count", "dup_lookup", "greedy_dedup",
    "event_merge", "page_extract", "summary_md", "daily_digest", "story_cards",
    "items_fingerprint", "feed_items", "expand_sources", "ingest_batch", "trending",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from broadsheet.plans.queries import QUERIES
    from broadsheet.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
