"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sparkwalk.session import local_session
from sparkwalk.workload import QUERIES

HEADLINE = [
    "trips_connected",
    "node_in_zone",
    "nearest_edge",
    "odpt_to_node",
    "od_points",
    "sample_od",
    "candidate_crosswalks",
    "chains_contracted",
    "edge_trips_current",
    "betweenness_current",
    "links_vs_trips",
    "mean_distance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
