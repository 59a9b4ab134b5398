"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds.

Each query runs once to warm up and then three times; the median counts. Results are written to Spark's noop sink, so all
rows are computed and none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sparkloom.plans import registry
from sparkloom.session import local_session

HEADLINE = (
    "p02_filter", "p20_pricing_summary", "p10_star_join", "p11_sort_merge_join", "p12_left_join", "p13_semi_join", "p14_range_join", "p15_asof_join", "p22_cube", "p24_statistics", "p30_ranking",
    "p32_frames", "p40_top_k_per_group", "p63_explode", "p65_variant", "p70_sessions", "p70_sliding", "p70_tumbling", "p71_stream_tumbling",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    registry.load_all()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
