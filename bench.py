"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from holdfast.plans import catalogue  # noqa: E402
from holdfast.session import local_session  # noqa: E402

HEADLINE = [
    "exact_extraction",
    "pair_table",
    "curation_waterfall",
    "repeated_partition",
    "partition_overlap",
    "macro_baseline_report",
    "coverage_audit",
    "paired_seed_contrast",
    "leave_one_out_audit",
    "temporal_baseline_report",
    "group_diversity",
    "cliff_context_burden",
    "classification_table",
    "paired_bootstrap",
    "nearest_benchmark_item",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = catalogue.queries()
    seconds = {}
    for name in only:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
