"""Print the physical plans of the analysis stages (scan pruning, exchanges, joins).

usage: python tools/show_plans.py [sf_dir] [--formatted]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from qplate.operators.expression import group_expression  # noqa: E402
from qplate.operators.outliers import loo_outliers  # noqa: E402
from qplate.operators.replicate_qc import band_counts, screened_values  # noqa: E402
from qplate.plans.pipeline import CARRY, GROUP, analyse, bio_table  # noqa: E402
from qplate.plans.registry import EVENT_CFG, _wells  # noqa: E402
from qplate.session import local_session  # noqa: E402


def summary(df) -> str:
    p = df._jdf.queryExecution().executedPlan().toString()
    counts = {k: len(re.findall(pat, p)) for k, pat in [
        ("shuffle", r"(?<![A-Za-z])Exchange (hash|range|Single|Round)"), ("broadcast", r"BroadcastExchange"),
        ("window", r"\bWindow \["), ("scan", r"FileScan parquet"), ("smj", r"SortMergeJoin"),
        ("bhj", r"BroadcastHashJoin")]}
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", p)
    return f"{counts}\n    scans: " + "\n           ".join(f"cols=[{c}] pushed=[{f}]" for c, f in scans)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 and not sys.argv[1].startswith("--") else "/root/testdata/sf0.1"
    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # static plans; AQE re-plans at run time
    cfg = EVENT_CFG
    w = _wells(spark, sf).filter(F.col("replicate_name").isNotNull())
    vals = screened_values(w, cfg.bad_replicate_cp, GROUP, "Cp", CARRY)
    stages = {"1 distinct values (one scan) + band counts": band_counts(vals, GROUP, "Cp", cfg.tolerance,
                                                                             cfg.chunk_width)}
    a = analyse(_wells(spark, sf), cfg)
    stages["2 group expression (from pinned band counts)"] = group_expression(a.values, GROUP)
    stages["3 leave-one-out (from pinned groups)"] = loo_outliers(bio_table(a.groups))
    stages["4 well-level report (final join)"] = a.report(ordered=False)
    stages["5 Welch statistics (from pinned bio table)"] = a.statistics
    for name, df in stages.items():
        print(f"== {name}\n    {summary(df)}")
        if "--formatted" in sys.argv:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
