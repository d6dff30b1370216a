"""Leave-one-out flags, sample summary poison rule and z-scores."""

import math
import random
import statistics

from pyspark.sql import functions as F

from qplate.operators.outliers import loo_outliers
from qplate.operators.summary import sample_summary, zscore

SCHEMA = "sample_name string, Gene string, replicate_name string, well_ord long, normalized_expression double"


def _mk(spark, groups):
    data = []
    for s, vals in groups.items():
        for i, v in enumerate(vals):
            data.append((s, "G", f"{s}.{i}", len(data), v))
    return spark.createDataFrame(data, SCHEMA)


def _brute(vals, k):
    out = []
    for i, x in enumerate(vals):
        others = vals[:i] + vals[i + 1:]
        nn = [o for o in others if o is not None]
        mo = statistics.fmean(nn) if len(others) >= 1 and nn else None
        so = statistics.stdev(nn) if len(others) >= 2 and len(nn) >= 2 else None
        if so is None:
            flag = "GOOD"
        elif x is None:
            flag = None
        else:
            flag = "BAD" if abs(x - mo) > k * so else "GOOD"
        out.append((mo, so, flag))
    return out


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def test_loo_matches_brute_force(spark):
    rng = random.Random(11)
    groups = {}
    for g in range(40):
        n = rng.choice([1, 2, 3, 4, 6, 9])
        groups[f"S{g}"] = [None if rng.random() < 0.15 else rng.lognormvariate(0, 2) for _ in range(n)]
    groups["DOM"] = [1.0, 1.0, 1.0, 1000.0]          # one value dominates the variance
    df = _mk(spark, groups)
    for chunk_rows in (4096, 1):                      # chunk_rows=1 salts every group into many chunks
        got = {r.replicate_name: (r.mean_others, r.sd_others, r.qc_flag)
               for r in loo_outliers(df, k=2.5, chunk_rows=chunk_rows).collect()}
        for s, vals in groups.items():
            for i, exp in enumerate(_brute(vals, 2.5)):
                mo, so, flag = got[f"{s}.{i}"]
                assert _close(mo, exp[0]) and _close(so, exp[1]) and flag == exp[2], (s, i, got[f"{s}.{i}"], exp)


def test_s10_missing_value_flags(spark):
    # own value missing with sd present -> NULL flag; with sd missing -> GOOD
    df = _mk(spark, {"A": [None, 1.0, 1.1, 0.9], "B": [None, 1.0]})
    got = {r.replicate_name: r.qc_flag for r in loo_outliers(df).collect()}
    assert got["A.0"] is None and got["B.0"] == "GOOD"


def _summ(spark, rows):
    df = spark.createDataFrame(rows, "sample_name string, Gene string, replicate_name string, well_ord long, "
                                     "file_name string, Pos string, zscoring_group string, testing_group string, "
                                     "type_of_gene string, normalized_expression double, "
                                     "log2_expression_value double, qc_flag string")
    return sample_summary(df).collect()[0]


def test_s11_poison_and_s13_single(spark):
    base = ("S", "G", None, None, "p", None, "z", "t", "Normal")
    r = _summ(spark, [base[:2] + ("S.1", 1) + base[4:5] + ("A1",) + base[6:] + (1.0, 0.0, "GOOD"),
                      base[:2] + ("S.2", 2) + base[4:5] + ("A2",) + base[6:] + (None, None, None)])
    assert r.normalized_expression_mean is None and r.normalized_expression_sd is None
    r = _summ(spark, [base[:2] + ("S.1", 1) + base[4:5] + ("A1",) + base[6:] + (2.0, 1.0, "GOOD"),
                      base[:2] + ("S.2", 2) + base[4:5] + ("A2",) + base[6:] + (9.0, 3.0, "BAD")])
    assert r.normalized_expression_mean == 2.0 and r.normalized_expression_sd is None
    assert r.replicate_name == "S.1" and r.Pos == "A1"


def test_d1_representative_is_first_replicate_by_name(spark):
    rows = [("S", "G", "S.2", 1, "p", "A1", "z", "t", "Normal", 1.0, 0.0, "GOOD"),
            ("S", "G", "S.1", 2, "p", "B1", "z", "t", "Normal", 3.0, 1.0, "GOOD")]
    r = _summ(spark, rows)
    assert r.Pos == "B1" and r.normalized_expression_mean == 2.0


def test_zscore_mean_zero_sd_one_and_zero_sd(spark):
    df = spark.createDataFrame([("z", "G", float(v)) for v in [1, 2, 3, 4, 10]] + [("c", "G", 5.0), ("c", "G", 5.0)],
                               "zscoring_group string, Gene string, log2_expression_value_mean double")
    out = zscore(df)
    zs = [r.zscored_value for r in out.filter(F.col("zscoring_group") == "z").collect()]
    assert abs(statistics.fmean(zs)) < 1e-12 and abs(statistics.stdev(zs) - 1) < 1e-12
    assert all(r.zscored_value is None for r in out.filter(F.col("zscoring_group") == "c").collect())
