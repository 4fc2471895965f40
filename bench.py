"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from queries.check import session
from queries.catalogue import QUERIES

HEADLINE = [
    "json_explode",
    "canonical_page",
    "first_per_key",
    "first_seen",
    "next_event",
    "followed_by",
    "nearest_match",
    "attribute_within",
    "stage_chain",
    "lead_type",
    "suppress_covered",
    "flags_month",
    "labels_month",
    "two_era_purchase",
    "funnel_request_basis",
    "funnel_lead_basis",
    "by_source_toggle_lead",
    "conversion_as_of",
    "unconverted_leads",
    "funnel_full",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in names or HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        # the first run warms the session up
        times[name] = round(statistics.median(took[1:] or took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps({**line, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main(sys.argv[1:])
