"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully executed into Spark's ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qplate.plans.registry import REGISTRY  # noqa: E402
from qplate.session import local_session  # noqa: E402

HEADLINE = ["report", "technical_qc", "relative_expression", "loo_outliers", "sample_summary", "welch_test",
            "ranksum_test", "recalculate", "annotate_first_match", "layout_expand", "magnitude_breaks",
            "heatmap_matrix", "zscore_lineitem"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # shuffle partitions sized to the input: one per core at bench scale (AQE coalesces further)
    cores = int(cpus) if str(cpus).isdigit() else (os.cpu_count() or 8)
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cores)))
    names = [q for q in (sys.argv[1:] or HEADLINE) if q in REGISTRY]
    # warm-up (reported separately): one full analysis at the smallest scale factor loads the
    # classes and fills the generated-code cache, so the timings below are steady-state
    w0 = time.perf_counter()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for q in ("report", "welch_test"):
        REGISTRY[q](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - w0, 3)
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "warmup_sec": warmup}))


if __name__ == "__main__":
    main()
