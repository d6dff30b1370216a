"""Two-group significance tests per (zscoring_group, gene).

Guards follow the original dispatch and the R tests it calls, but return a
NULL p-value plus ``test_status`` instead of stopping:

* fewer than 2 distinct groups (a missing group counts) or fewer than 2 rows -> 'insufficient_data'
* after dropping missing values, not exactly 2 groups                        -> 'not_two_groups'
* Welch: a group with < 2 values -> 'not_enough_observations'; standard error
  below 10*eps*max|mean| -> 'constant_data'
* rank-sum: all values tied -> 'constant_data'

Welch: per-group (n, mean, var) via partial aggregation, then
p = I_{df/(df+t^2)}(df/2, 1/2) (regularized incomplete beta on the JVM).

Rank-sum (Wilcoxon / Mann-Whitney): W = sum of first-group average ranks
minus n1(n1+1)/2.  Ranks come from one range-partitioned numbering of the
distinct values of all tests (skew-safe, see ``_ranked_groups``).  Exact p when
both groups < 50 and no ties (null distribution built once per distinct
(n1, n2), as one array in DataFrame functions), else the normal approximation
with tie and continuity correction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qplate.functions.numeric import normal_two_sided_p, student_t_two_sided_p
from qplate.operators._util import materialize, number_rows

TEST_KEYS = ("zscoring_group", "Gene")
DOUBLE_EPS = 2.220446049250313e-16
EXACT_LIMIT = 50


def _levels(df: DataFrame, keys: Sequence[str], value: str, group: str) -> DataFrame:
    """Per test: total rows, number of distinct groups (NULL counts), and the sorted list of
    non-missing groups with their (n, mean, var)."""
    x = F.col(value)
    per = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_rows"), F.count(x).alias("n"),
                                       F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    lvl = F.when(F.col(group).isNotNull() & (F.col("n") > 0),
                 F.struct(F.col(group).alias("g"), "n", "mean", "var"))
    return per.groupBy(*keys).agg(F.sum("_rows").alias("_total_rows"), F.count(F.lit(1)).alias("_n_groups"),
                                  F.sort_array(F.collect_list(lvl)).alias("_lv"))


def _base_status() -> F.Column:
    return (F.when((F.col("_n_groups") < 2) | (F.col("_total_rows") < 2), F.lit("insufficient_data"))
            .when(F.size("_lv") != 2, F.lit("not_two_groups")))


def welch_test(df: DataFrame, keys: Sequence[str] = TEST_KEYS, value: str = "normalized_expression",
               group: str = "testing_group") -> DataFrame:
    """(keys..., pvalue, test_status) - two-sided Welch t-test."""
    g = _levels(df, keys, value, group)
    a, b = F.get("_lv", F.lit(0)), F.get("_lv", F.lit(1))
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    se = F.sqrt(va + vb)
    t = (a["mean"] - b["mean"]) / se
    dof = (va + vb) ** 2 / (va ** 2 / (a["n"] - 1) + vb ** 2 / (b["n"] - 1))
    status = (_base_status()
              .when((a["n"] < 2) | (b["n"] < 2), F.lit("not_enough_observations"))
              .when(se < F.lit(10 * DOUBLE_EPS) * F.greatest(F.abs(a["mean"]), F.abs(b["mean"])), F.lit("constant_data"))
              .otherwise(F.lit("ok")))
    out = g.withColumn("test_status", status)
    p = student_t_two_sided_p(t, dof)
    return out.select(*keys, F.when(F.col("test_status") == "ok", p).alias("pvalue"), "test_status")


def _ranked_groups(df: DataFrame, keys: Sequence[str], value: str, group: str) -> DataFrame:
    """One row per test: ``_total_rows``, ``_n_groups``, ``_lv`` (its non-missing groups in order, each with n and the sum of its average
    ranks), ``_ties`` (sum of t^3 - t over its values) and ``_tmax`` (the most frequent value's count).

    The rows are counted by (test, value, group) first.  One dense numbering of these counts by (test, value) gives every value
    the number of values below it: its bounds are sampled from the data, so a test with most of the rows, or
    with all values in a narrow range, is cut wherever its own quantiles lie.  Nothing is joined.
    """
    keys = list(keys)
    seen = F.col(value).isNotNull() & F.col(group).isNotNull()
    counted = df.groupBy(*keys, F.when(seen, F.col(value)).alias("_v"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
    counted = materialize(counted.withColumn("_t", F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)), "table")
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_v").asc_nulls_first(), F.col("_g").asc_nulls_first()]
    placed = number_rows(counted, order, F.col("_t"))
    # a value's rows are as many as the test has groups
    same = Window.partitionBy(*keys, "_v")
    d = placed.select(*keys, "_v", "_g", "_c", "_t", F.sum("_t").over(same).alias("_ties"), F.min("_before").over(same).alias("_less"),
                      (F.row_number().over(same.orderBy(F.col("_g").asc_nulls_first())) == 1).alias("_one"))
    # twice the average rank is whole; _less counts from the start of the whole order, the test's own start is its least
    rank = (2 * F.col("_less") + F.col("_ties") + 1).cast("decimal(19,0)")
    valued = F.col("_v").isNotNull()
    cubes = F.when(valued & F.col("_one"), F.col("_ties") * F.col("_ties") * F.col("_ties") - F.col("_ties")).otherwise(0)
    per = d.groupBy(*keys, "_g").agg(
        F.sum("_c").alias("_rows"), F.sum("_t").alias("n"), F.min(F.when(valued, F.col("_less"))).alias("_low"),
        F.sum(F.when(valued, F.col("_t").cast("decimal(18,0)") * rank)).alias("ranks"), F.sum(cubes).alias("_cubes"), F.max(F.when(valued, F.col("_ties"))).alias("_most"))
    level = F.when(F.col("n") > 0, F.struct(F.col("_g").alias("g"), "n", "ranks"))
    # a test's groups are few: two of them make a test, more of them none
    g = per.groupBy(*keys).agg(F.sum("_rows").alias("_total_rows"), F.count(F.lit(1)).alias("_n_groups"), F.min("_low").alias("_start"),
                               F.sum("_cubes").alias("_ties"), F.max("_most").alias("_tmax"), F.sort_array(F.collect_list(level)).alias("_lv"))
    start = (2 * F.col("_start")).cast("decimal(19,0)")
    own = F.transform("_lv", lambda e: F.struct(e["g"].alias("g"), e["n"].alias("n"), (
        (e["ranks"] - e["n"].cast("decimal(18,0)") * start).cast("double") / 2).alias("ranks")))
    return g.withColumn("_lv", own).drop("_start")


def null_distribution(n1: Column, n2: Column) -> Column:
    """P(W <= w) for w from 0 to n1 * n2 of the Mann-Whitney null distribution, as one array.

    The items are taken in rank order; entry k of the state holds, for k of them in the first group, the number of ways to
    each rank sum (beyond its least).  Item j adds the ways with it in the first group, where j - k of the second lie below it.
    """
    def item(state: Column, j: Column) -> Column:
        def ways(k: Column) -> Column:
            below = j - k
            without = F.get(state, k)
            with_it = F.concat(F.array_repeat(F.lit(0.0), below), F.get(state, k - 1))
            both = F.zip_with(without, with_it, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
            return F.when((k < 1) | (below < 0) | (below > n2), without).otherwise(both)
        return F.transform(F.sequence(F.lit(0), n1), ways)

    start = F.transform(F.sequence(F.lit(0), n1), lambda k: F.when(k == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")))
    ways = F.element_at(F.aggregate(F.sequence(F.lit(1), n1 + n2), start, item), -1)
    # running sums, the last of which is the number of all ways
    sums = F.aggregate(ways, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
    return F.transform(F.array(sums), lambda s: F.transform(s, lambda x: x / F.element_at(s, -1)))[0]


def ranksum_test(df: DataFrame, keys: Sequence[str] = TEST_KEYS, value: str = "normalized_expression",
                 group: str = "testing_group", exact: bool | None = None,
                 exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """(keys..., statistic W, pvalue, test_status, method) - two-sided Wilcoxon rank-sum test.

    ``method`` says which rule made the p-value: ``exact`` when both groups have fewer than ``exact_limit`` values
    and no value is tied, else ``normal``; ``exact=True`` / ``False`` overrides the limit (ties always use ``normal``).
    """
    keys = list(keys)
    g = _ranked_groups(df, keys, value, group)
    a, b = F.get("_lv", F.lit(0)), F.get("_lv", F.lit(1))  # NULL where a test has fewer groups
    g = g.withColumn("_n1", a["n"]).withColumn("_n2", b["n"]).withColumn("_r1", a["ranks"])
    n1, n2 = F.col("_n1").cast("double"), F.col("_n2").cast("double")
    w = F.col("_r1") - n1 * (n1 + 1) / 2
    use_exact = (F.col("_n1") < exact_limit) & (F.col("_n2") < exact_limit) & (F.col("_tmax") <= 1)
    if exact is not None:
        use_exact = F.lit(bool(exact)) & (F.col("_tmax") <= 1)
    g = g.withColumn("statistic", w).withColumn("method", F.when(use_exact & (F.size("_lv") == 2), "exact").otherwise("normal"))
    g = materialize(g, "table")  # a row per test; the pairs and the p-values both read it
    # normal approximation with continuity and tie correction
    nn = n1 + n2
    sigma = F.sqrt((n1 * n2 / 12.0) * ((nn + 1) - F.col("_ties") / (nn * (nn - 1))))
    zc = F.col("statistic") - n1 * n2 / 2.0
    z = (zc - F.signum(zc) * 0.5) / sigma
    p_norm = F.least(F.lit(1.0), normal_two_sided_p(z))
    # exact: one distribution per distinct (n1, n2)
    pairs = g.filter(F.col("method") == "exact").select("_n1", "_n2", "method").distinct() \
        .withColumn("_cdf", null_distribution(F.col("_n1").cast("int"), F.col("_n2").cast("int")))
    g = g.join(pairs, ["_n1", "_n2", "method"], "left")
    at = F.col("statistic").cast("int")
    p_exact = F.least(F.lit(1.0), F.when(F.col("statistic") > n1 * n2 / 2, 2 * (1 - F.coalesce(F.get("_cdf", at - 1), F.lit(0.0))))
                      .otherwise(2 * F.get("_cdf", at)))
    status = (_base_status()
              .when((F.col("method") == "normal") & ((sigma == 0) | sigma.isNull()), F.lit("constant_data"))
              .otherwise(F.lit("ok")))
    g = g.withColumn("test_status", status)
    p = F.when(F.col("test_status") == "ok", F.when(F.col("method") == "exact", p_exact).otherwise(p_norm))
    return g.select(*keys, F.when(F.col("test_status") == "ok", F.col("statistic")).alias("statistic"),
                    p.alias("pvalue"), "test_status", F.when(F.col("test_status") == "ok", F.col("method")).alias("method"))


def two_group_test(df: DataFrame, keys: Sequence[str] = TEST_KEYS, value: str = "normalized_expression",
                   group: str = "testing_group", kind: str = "ttest", exact_limit: int = EXACT_LIMIT,
                   with_method: bool = False) -> DataFrame:
    """Dispatch: ``kind='ttest'`` (Welch) or ``'wilcox'`` (rank-sum); output keys, pvalue, test_status and,
    with ``with_method``, the rule that made the p-value (``welch``, ``exact`` or ``normal``)."""
    if kind in ("ttest", "welch"):
        out = welch_test(df, keys, value, group).withColumn("method", F.when(F.col("test_status") == "ok", F.lit("welch")))
    elif kind in ("wilcox", "ranksum"):
        out = ranksum_test(df, keys, value, group, exact_limit=exact_limit)
    else:
        raise ValueError(f"unknown test kind {kind!r}: use 'ttest' or 'wilcox'")
    return out.select(*keys, "pvalue", "test_status", *(["method"] if with_method else []))
