"""Property tests (random groups): exact tolerance counts and order invariance of keep flags."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from qplate.operators.replicate_qc import technical_qc

SCHEMA = "replicate_name string, Gene string, type_of_gene string, well_ord long, Cp double"

# two-decimal Cps on a narrow range so exact-tolerance gaps are frequent
cps = st.lists(st.integers(min_value=2000, max_value=2300).map(lambda v: v / 100.0), min_size=1, max_size=7)
groups = st.lists(cps, min_size=1, max_size=6)


def _brute(vals, tol, slack=2):
    n = len(vals)
    valid = [sum(1 for y in vals if abs(y - x) <= tol) - 1 for x in vals]
    if all(v == n - 1 for v in valid):
        return ["keep"] * n
    if all(v == 0 for v in valid):
        return ["keep"] * n
    return ["keep" if v >= n - slack else "NO keep" for v in valid]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=groups, tol=st.sampled_from([0.5, 0.25, 1.0]), seed=st.integers(0, 1000))
def test_keep_flags_match_brute_force_and_ignore_order(spark, groups, tol, seed):
    rows, expect = [], {}
    for g, vals in enumerate(groups):
        for x, k in zip(vals, _brute(vals, tol)):
            expect[len(rows)] = k
            rows.append((f"R{g}", "G", "Normal", len(rows), x))
    rng = random.Random(seed)
    perm = list(range(len(rows)))
    rng.shuffle(perm)
    permuted = [(r[0], r[1], r[2], perm[i], r[4]) for i, r in enumerate(rows)]   # new arrival order
    inverse = {perm[i]: i for i in range(len(rows))}
    for data, key in ((rows, lambda o: o), (permuted, lambda o: inverse[o])):
        df = spark.createDataFrame(data, SCHEMA)
        got = {key(r.well_ord): r.keep_this_value for r in technical_qc(df, tol, 2, chunk_width=0.75).collect()}
        assert got == expect
