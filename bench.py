"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Every query is run
to its last row (the noop sink), once, after one warm-up run of the first one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from valora.plans.catalog import QUERIES
from valora.session import build_session

HEADLINE = [
    "f2_group_median_topn", "c1_price_window", "b16_extract_attrs", "b37_answer_price", "d9_top_per_profile", "e3_resolve_category",
    "e6_poi_radius_counts", "e7_supply_density", "f9_box_stats", "f13_word_counts", "g1_dedupe_first", "g2_relative_to_group",
    "g5_average_ranks", "k2_target_encode", "k4_out_of_fold_encoding", "l1_similar", "l3_bm25", "l4_cosine_topk", "m2_accuracy",
    "m3_three_views", "m9_wilcoxon", "n1_weekly_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["f2_group_median_topn"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
