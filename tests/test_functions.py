"""Column helpers: NaN/zero guards (S-1), rounding, Chan merge, p-value functions."""

import math
import random
import statistics

from pyspark.sql import functions as F

from qplate.functions.numeric import (
    chan_merge,
    log2_or_null,
    normal_two_sided_p,
    round_sig,
    safe_div,
    student_t_two_sided_p,
)


def test_guards_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (6.0, 3.0), (0.0, 2.0)], "a double, b double")
    out = df.select(safe_div(F.col("a"), F.col("b")).alias("q"), log2_or_null(F.col("a")).alias("l"),
                    round_sig(F.col("a") / 7, 4).alias("r")).collect()
    assert [r.q for r in out] == [None, None, 2.0, 0.0]
    assert out[3].l is None and out[2].l == math.log2(6.0)
    assert out[2].r == 0.8571 and out[3].r == 0.0


def test_chan_merge_matches_direct(spark):
    rng = random.Random(1)
    xs = [rng.lognormvariate(0, 3) for _ in range(9)]
    a, b = xs[:4], xs[4:]

    def summ(v):
        m = statistics.fmean(v)
        return len(v), m, sum((x - m) ** 2 for x in v)
    na, ma, qa = summ(a)
    nb, mb, qb = summ(b)
    row = spark.range(1).select(*[e.alias(n) for n, e in zip(
        ("n", "m", "q"), chan_merge((F.lit(na), F.lit(ma), F.lit(qa)), (F.lit(nb), F.lit(mb), F.lit(qb))))]).collect()[0]
    n, m, q = summ(xs)
    assert row.n == n and math.isclose(row.m, m, rel_tol=1e-12) and math.isclose(row.q, q, rel_tol=1e-10)
    empty = spark.range(1).select(*[e.alias(k) for k, e in zip(
        ("n", "m", "q"), chan_merge((F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double")),
                                    (F.lit(na), F.lit(ma), F.lit(qa))))]).collect()[0]
    assert empty.n == na and empty.m == ma and empty.q == qa


def test_p_values(spark):
    row = spark.range(1).select(student_t_two_sided_p(F.lit(2.0), F.lit(10.0)).alias("t"),
                                normal_two_sided_p(F.lit(1.959963984540054)).alias("z"),
                                normal_two_sided_p(F.lit(None).cast("double")).alias("zn")).collect()[0]
    assert abs(row.t - 0.0733880347707403) < 1e-12
    assert abs(row.z - 0.05) < 1e-12 and row.zn is None
