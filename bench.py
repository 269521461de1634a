"""Headline-query timings.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line. Each query is fully
executed into Spark's ``noop`` sink (no collect), after one warm-up query;
the reported time is the best of ``$BENCH_RUNS`` (default 2) runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "relation_scores",          # C5 flagship: ordered decayed fold per pair (skew-safe)
    "relation_scores_feed",     # C4 per-event feed (two-pass scan)
    "relation_scores_by_day",   # C6 JVM-only tree fold
    "interaction_counts_feed",  # C1
    "interaction_counts_windowed",  # C3
    "event_time_locf",          # B5 (one group over all rows)
    "snapshot_counts",          # C10
    "country_mean",             # D4
    "changes_only",             # D3
    "activity_series",          # D7
    "sgd_step",                 # F10
    "negative_samples",         # F13
    "top_k",                    # G2 (no pruning)
    "top_k_li",                 # G6 (LEMP LI)
    "train_step",           # F14
    "train_mf",             # F11
    "ndcg",                     # G9
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from relflow.queries import QUERIES
    from relflow.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus)
    # warm-up: JVM, Python workers, parquet footers
    QUERIES["interaction_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for n in names:
        best = None
        for _ in range(runs):
            t = time.time()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            d = time.time() - t
            best = d if best is None else min(best, d)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
