"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query is planned and fully executed with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mentiongraph.plans.catalog import QUERIES  # noqa: E402
from mentiongraph.session import get_session  # noqa: E402

HEADLINE = [
    "cooccurrence_pairs", "top_pairs", "node_state", "entity_deltas", "edge_deltas", "graph_totals_by_article",
    "relationship_strength", "pagerank_full", "hourly_rate", "sentences", "mentions_text", "sentence_sentiment",
    "term_dedupe", "page_text", "post_normalise", "processing_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_session(f"local[{cpus}]", app="mentiongraph-bench", shuffle_partitions=max(8, cpus * 2))
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
