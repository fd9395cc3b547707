"""Benchmark the headline queries.

Runs each headline query over the whole tables at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion with the ``noop`` sink (the full plan
runs, nothing is collected to the driver). Two untimed warm-up queries run
first so JVM start-up and JIT are not charged to the first timed query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A1_repository_profile",
    "A6_A7_A8_project_overview",
    "A15_project_features",
    "A17_team_metrics",
    "N3_flatten_changelog",
    "N7_link_features",
    "A22_describe",
    "I7_apply_plan",
    "I15_column_transformer",
    "W6_sample_exact",
    "M4_evaluate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    os.environ.setdefault("TICKETLENS_DRIVER_MEMORY", os.environ.get("BENCH_DRIVER_MEMORY", "4g"))

    from ticketlens.plans.catalog import load_all
    from ticketlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2), app_name="ticketlens-bench")
    registry = load_all()
    names = [n for n in HEADLINE if n in registry]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if re.search(only, n)]

    # untimed warm-up: JVM start and JIT of the scan/join/aggregate code paths the stand-ins use
    for w in ("A4_count_by_project", "N4_unwind"):
        registry[w].build(spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
