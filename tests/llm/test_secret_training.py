"""Training of the secret scan: all findings count, however many documents and shards there are."""

import random

import numpy as np


def _docs(spark, n):
    r = random.Random(5)
    pick = lambda k: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k - 1)) + "7"
    make = (lambda: "ghp_" + pick(36), lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)))
    texts = [f"we found {make[i % 2]()} there " + pick(3) for i in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, "")], "doc_id long, text string")


def test_all_findings_are_taught_or_held_out(spark):
    """More documents and findings than the bounds of 2,000 and 4,000 that training once had."""
    from qplate.llm.secret_scan import made_findings, scan, train
    n = 4600
    docs = _docs(spark, n)
    net = train(docs, epochs=2, shard=2000)  # several shards, averaged
    assert net.n_taught + net.n_held == n + len(set(made_findings()))
    got = scan(docs, net).selectExpr("doc_id % 2 AS kind", "n_model").groupBy("kind").avg("n_model").collect()
    share = {r[0]: r[1] for r in got}
    assert share[0] > 0.9 and share[1] < 0.1


def test_training_does_not_depend_on_the_partitions(spark):
    from qplate.llm.secret_scan import train
    docs = _docs(spark, 300)
    a, b = train(docs.repartition(5), epochs=1, shard=1500), train(docs.coalesce(1), epochs=1, shard=1500)
    assert all(np.allclose(a.p[k], b.p[k], rtol=0, atol=1e-9) for k in a.p) and abs(a.threshold - b.threshold) < 1e-6


def test_packed_windows_and_platt():
    from qplate.llm.secret_scan import INSIDE, packed, platt, unpacked, windows
    text = "key: " + "aB3" * 40 + " end é"
    for end in (21, 5 + INSIDE, 6 + INSIDE, 125):
        assert (unpacked(packed(text, 5, end), end - 5) == windows(text, 5, end)).all()
    r = np.random.default_rng(2)
    z = r.normal(0, 6, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.3 * z - 2)))).astype(float)

    def means(a, b):
        u = a * z + b
        p = 1 / (1 + np.exp(-u))
        w = p * (1 - p)
        return [v.mean() for v in ((p - y) * z, p - y, w * z * z, w * z, w, np.logaddexp(0, u) - y * u)]

    slope, shift = platt(means)
    assert abs(slope - 0.3) < 0.05 and abs(shift + 2) < 0.3
    at = means(slope, shift)
    assert abs(at[0] + 1e-3 * (slope - 1)) < 1e-6 and abs(at[1] + 1e-3 * shift) < 1e-6
