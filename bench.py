"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from framejobs.plans import load_all
from framejobs.plans.registry import QUERIES
from framejobs.session import local_session

HEADLINE = (
    "import_images", "route_products", "plan_batch", "frame_catalog", "framing_violations", "batch_rollup",
    "merge_creatives", "sweep_orphans", "export_manifest", "suppress_persons", "parse_features", "assess_quality",
    "edge_content", "stream_job_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
