"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pageloom.plans import QUERIES  # noqa: E402
from pageloom.session import local_session  # noqa: E402

HEADLINE = [
    "a08_page_outcome", "j03_overlap_join", "j05_smallest_container", "j06_layout_tree", "j14_delta", "j16_merge3",
    "p23_correction_allowed", "a02_window_stats", "a05_batch_status", "a10_union_area", "a12_page_version",
    "a14_uniformity", "w01_reading_order", "w09_page_context", "m04_union", "m06_components", "f06_wrap", "k10_checkpoint_reuse",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "pageloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_orderkey").count().write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
