"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessella.plans import registry
from tessella.session import local_session

HEADLINES = [
    "t6_lexical_pairs", "a1_pair_counts", "a3_top_targets", "a3_top_items", "f1_f2_relative_frequencies", "f1_item_frequencies", "f3_f6_rule_features",
    "f7_f8_lexical_features", "p3_context", "a6_vocabulary", "a10_cells", "l1_cross_covariance", "l6_cca", "c2_cca_scores", "c9_softmax", "e2_e5_report",
    "g2_lexical_edges", "g4_binary_edges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, shuffle_partitions=cores, name="bench")
    found = registry.queries()
    times: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):  # the first run also compiles; the faster one counts
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cores}))


if __name__ == "__main__":
    main()
