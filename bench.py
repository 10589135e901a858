"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is executed in full with the `noop` sink (every row computed,
nothing collected to the driver).  One small warm-up query runs first so
JIT compilation is not charged to the first timed query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, app="quire-bench")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, 2 * cpus)))

    QUERIES["ledger_health"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]

    n_posts = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    pipeline = sum(times.get(q, 0.0) for q in ("enriched_prompt", "analysis_valid", "publish_rows", "page_blocks"))
    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "cpus": cpus,
        "spark": spark.version,
        "posts": n_posts,
        "posts_per_sec_publish_pipeline": round(n_posts / pipeline, 1) if pipeline else None,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
