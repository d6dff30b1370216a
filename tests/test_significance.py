"""Welch and rank-sum tests: reference values, guards, exact distribution vs enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from qplate.operators.significance import null_distribution, ranksum_test, welch_test

SCHEMA = "zscoring_group string, Gene string, testing_group string, normalized_expression double"


def _df(spark, groups, key="z"):
    return spark.createDataFrame([(key, "G", g, v) for g, vals in groups.items() for v in vals], SCHEMA)


def _welch_p(x, y):
    """Welch p from first principles with a regularized-beta series (independent of the JVM code)."""
    mx, my = sum(x) / len(x), sum(y) / len(y)
    vx = sum((a - mx) ** 2 for a in x) / (len(x) - 1) / len(x)
    vy = sum((a - my) ** 2 for a in y) / (len(y) - 1) / len(y)
    t = (mx - my) / math.sqrt(vx + vy)
    df = (vx + vy) ** 2 / (vx ** 2 / (len(x) - 1) + vy ** 2 / (len(y) - 1))
    # two-sided p = 1 - 2 * integral_0^|t| of the t density (fine midpoint rule)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n = 200000
    h = abs(t) / n
    s = sum((1 + ((i + 0.5) * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n)) * h
    return 1 - 2 * c * s


def test_welch_against_first_principles(spark):
    x, y = [1.1, 2.3, 1.9, 3.2, 2.2], [2.9, 3.8, 4.1, 3.3]
    p = welch_test(_df(spark, {"a": x, "b": y})).collect()[0]
    assert p.test_status == "ok" and abs(p.pvalue - _welch_p(x, y)) < 1e-8


def test_guards(spark):
    one = welch_test(_df(spark, {"a": [1.0, 2.0, 3.0]})).collect()[0]
    assert one.pvalue is None and one.test_status == "insufficient_data"
    few = welch_test(_df(spark, {"a": [1.0], "b": [2.0, 3.0]})).collect()[0]
    assert few.test_status == "not_enough_observations"
    three = welch_test(_df(spark, {"a": [1.0, 2.0], "b": [2.0, 3.0], "c": [1.0, 5.0]})).collect()[0]
    assert three.test_status == "not_two_groups"
    const = welch_test(_df(spark, {"a": [1.0, 1.0], "b": [1.0, 1.0]})).collect()[0]
    assert const.test_status == "constant_data"


def _enumerate_cdf(n1, n2):
    counts = {}
    for ranks in itertools.combinations(range(1, n1 + n2 + 1), n1):
        w = sum(ranks) - n1 * (n1 + 1) // 2
        counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    acc, out = 0, []
    for w in range(n1 * n2 + 1):
        acc += counts.get(w, 0)
        out.append(acc / total)
    return out


def test_exact_null_distribution_matches_enumeration(spark):
    pairs = [(1, 1), (2, 3), (4, 4), (3, 7), (7, 3), (6, 5)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", null_distribution(F.col("a"), F.col("b")).alias("cdf")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert len(r.cdf) == r.a * r.b + 1
        assert max(abs(x - y) for x, y in zip(r.cdf, _enumerate_cdf(r.a, r.b))) < 1e-12


def test_exact_null_distribution_at_the_limit(spark):
    r = spark.createDataFrame([(49, 49)], "a int, b int").select(null_distribution(F.col("a"), F.col("b")).alias("cdf")).first().cdf
    assert r[-1] == 1 and len(r) == 49 * 49 + 1 and all(x <= y for x, y in zip(r, r[1:]))
    assert r[1200] + (r[1200] - r[1199]) / 2 == pytest.approx(0.5, abs=0.01) and r[0] == pytest.approx(1 / math.comb(98, 49))
    assert all(abs(r[k] + r[49 * 49 - 1 - k] - 1) < 1e-9 for k in range(0, 49 * 49, 97))  # symmetric


def _plain_ranksum(pairs):
    """(W, sum of t^3 - t) of (group, value) pairs of groups a and b."""
    values = sorted(v for _, v in pairs)
    rank = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in set(values)}
    n = sum(g == "a" for g, _ in pairs)
    return sum(rank[v] for g, v in pairs if g == "a") - n * (n + 1) / 2


def test_ranks_of_a_hot_test_in_a_narrow_range(spark):
    """One test holds most rows, all within a millionth of each other; others stand before and behind it in the order."""
    rng = random.Random(8)
    tests = {"hot": [(rng.choice("ab"), 5.0 + rng.randrange(4000) * 2.0 ** -32) for _ in range(6000)]}
    tests |= {f"t{i}": [(rng.choice("ab"), rng.choice([-1.5, 0.0, rng.random(), 7.0])) for _ in range(rng.randint(5, 40))] for i in range(30)}
    tests = {k: v for k, v in tests.items() if {g for g, _ in v} == {"a", "b"}}
    rows = [(k, None if k == "t3" else "G", g, v) for k, pairs in tests.items() for g, v in pairs]
    rows += [("hot", "G", None, 5.0), ("hot", "G", "a", None)]  # count for the guards only
    got = {r.zscoring_group: r for r in ranksum_test(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["hot"].test_status == "not_two_groups" or got["hot"].statistic is not None
    for k, pairs in tests.items():
        assert got[k].statistic == _plain_ranksum(pairs), k


def test_ranksum_needs_no_python_and_few_exchanges(spark):
    df = _df(spark, {"a": [1.0, 2.0], "b": [2.5, 3.0]})
    plan = ranksum_test(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange ") <= 12


def test_ranksum_exact_and_normal(spark):
    rng = random.Random(5)
    x = [rng.random() for _ in range(6)]
    y = [rng.random() + 0.3 for _ in range(5)]
    r = ranksum_test(_df(spark, {"a": x, "b": y})).collect()[0]
    allv = sorted(x + y)
    w = sum(allv.index(v) + 1 for v in x) - 6 * 7 / 2
    cdf = _enumerate_cdf(6, 5)
    p = 2 * (1 - cdf[int(w) - 1]) if w > 15 else 2 * cdf[int(w)]
    assert r.method == "exact" and r.statistic == w and abs(r.pvalue - min(1, p)) < 1e-12
    # ties force the normal approximation with tie and continuity correction
    x2, y2 = [1.0, 2.0, 2.0, 3.0, 4.0], [2.0, 5.0, 6.0, 6.0, 7.0]
    r2 = ranksum_test(_df(spark, {"a": x2, "b": y2})).collect()[0]
    vals = sorted(x2 + y2)
    rank = {v: (vals.index(v) + 1 + len(vals) - vals[::-1].index(v)) / 2 for v in set(vals)}
    w2 = sum(rank[v] for v in x2) - 15
    ties = sum(c ** 3 - c for c in (vals.count(v) for v in set(vals)))
    sigma = math.sqrt(25 / 12 * (11 - ties / (10 * 9)))
    z = (w2 - 12.5 - math.copysign(0.5, w2 - 12.5)) / sigma
    assert r2.method == "normal" and abs(r2.pvalue - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
