"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from parcelscope.plans.catalog import QUERIES
from parcelscope.session import local_session

HEADLINE = (
    "sales_summary", "area_stats", "area_rank", "search_matches", "price_history_events", "agent_metrics", "snapshot_diff",
    "lifecycle", "hunt_report", "sold_comps", "comp_valuation", "reconcile", "risk_flags", "viability", "decision", "page_cards",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["mode_rollup"](spark, sf_dir).collect()  # start-up and file footers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
