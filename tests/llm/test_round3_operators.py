"""Spelling variants, Merkle manifest and language identification against plain versions."""

import os
import random
import string
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from qplate.llm import kdtree, language_id, merkle, queries, spelling  # noqa: E402
from qplate.llm.common import pin  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, tree string, _row string, n string, score string"


def _table(spark, folder, rows, parts=4):
    """rows: (doc_id, text, lang, source, n_chars); the columns behind them clash with names that the operators use."""
    spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(parts) \
        .write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same(df, want, cols):
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted((tuple(w) for w in want), key=repr)


# ---- spelling variants

SPELLING = ["word", "form", "root", "n", "n_near", "form_n"]


def _misspelt(seed, n_docs):
    r = random.Random(seed)
    syllables = ["tion", "ment", "ab", "er", "ou", "ça", "ü", "st", "an", "th", "ÿ"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(3, 5))) for _ in range(40)]

    def edit(w):
        i, k = r.randrange(len(w)), r.randrange(4)
        return (w, w[:i] + w[i + 1:], w[:i] + r.choice("aeé") + w[i:], w[:i] + r.choice("xyz") + w[i + 1:])[k]

    return [" ".join(edit(w) if r.random() < 0.3 else w.capitalize() for w in r.choices(words, range(40, 0, -1), k=60)) + "×÷ 12" for _ in range(n_docs)]


@pytest.fixture(scope="module")
def spelling_dir(spark, tmp_path_factory):
    texts = _misspelt(1, 150)
    texts += ["", None, "12 -- ..", "kürbis"] + ["abcdefg abcdefh abcdegf"] * 6 + ["ABCDEFGH ÄBCDEFG äbcdefg"] * 40 + ["q" * 40_000 + " " + "q" * 40_001] * 5
    texts.append(" ".join(["chainxaa"] * 5 + ["chainxab"] * 25 + ["chainxbb"] * 130))  # a form of a form
    rows = [(i * 7 % 997, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), rows[3], rows[3], (rows[4][0], "other clashing letters", "en", "s", 1)]
    return _table(spark, tmp_path_factory.mktemp("spelling"), rows), rows


def test_spelling(spark, spelling_dir):
    folder, rows = spelling_dir
    same(queries.op11_spelling(spark, folder), brute.spelling([r[:2] for r in rows]), SPELLING)


@pytest.mark.parametrize("cell_words", [4])
def test_spelling_over_many_cells(spark, spelling_dir, cell_words):
    """Upper trees of several levels, with words whose letters are the same and cells dealt in parts."""
    folder, rows = spelling_dir
    got = spelling.variants(spark.read.parquet(f"{folder}/documents.parquet"), cell_words=cell_words, slip_every=50)
    want = brute.spelling([r[:2] for r in rows], slip_every=50)
    assert sum(w[4] for w in want) > 50 and any(w[2] != w[1] and w[1] for w in want)
    same(got, want, SPELLING)


def test_spelling_cells_fitted_on_few_words(spark):
    """Cells that no sampled word helped to split still answer whole."""
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcd") for _ in range(8)) for _ in range(3000)})
    table = pin(spark.createDataFrame([(w, 5 + i % 7) for i, w in enumerate(words)], "word string, n long"), "words")
    got = {w: (n, m, f) for w, n, m, f in spelling.near_words(table, cell_words=100, sample_words=60).collect()}
    n_of = dict((w, 5 + i % 7) for i, w in enumerate(words))
    for w in words[::50]:
        near = [x for x in (w[:i] + c + w[i + 1:] for i in range(8) for c in "abcd") if x in n_of and x != w]
        best = min(near, key=lambda x: (-n_of[x], x), default=None)
        assert got.get(w) == (None if best is None else (len(set(near)), n_of[best], best))


def test_kd_tree_reaches_all_vectors_in_range():
    r = np.random.default_rng(0)
    v = r.poisson(0.7, (800, kdtree.DIMENSIONS)).astype(np.uint8)
    v[:, 8:] = 0
    tree = kdtree.KdTree(v, 16)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(800)) and len(tree.members) > 20
    d = v[:, None].astype(int) - v[None]
    for gain, loss in ((0, 0), (1, 1), (1, 0), (0, 1)):
        wanted = (np.maximum(-d, 0).sum(axis=2) <= gain) & (np.maximum(d, 0).sum(axis=2) <= loss)
        reached = np.zeros((800, 800), dtype=bool)
        for leaf, who in tree.search(v, gain, loss):
            assert not reached[np.ix_(who, tree.members[leaf])].any()
            reached[np.ix_(who, tree.members[leaf])] = True
        assert reached[wanted].all() and reached.mean() < 0.6


def test_signatures_bound_the_distance():
    r = random.Random(4)
    words = ["".join(r.choice("aabcé") for _ in range(12)) for _ in range(200)]
    counts = kdtree.letter_counts(kdtree.code_matrix(words))
    s, c = kdtree.signatures(counts), counts.astype(int)
    assert (np.bitwise_count(s[:, None] ^ s[None]) <= np.abs(c[:, None] - c[None]).sum(axis=2)).all()
    one = kdtree.one_edit
    m = lambda *w: kdtree.code_matrix(list(w))
    assert one(m("abcd", "abcd", "aaaa"), m("abxd", "abdc", "aaaa")).tolist() == [True, False, False]
    assert one(m("abcd", "abcd", "aaaa"), m("abcde", "xbcda", "aaaaa")).tolist() == [True, False, True]


# ---- Merkle manifest

MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _leaves(n):
    r = random.Random(n)
    sources = ["a", "é", "", None, "null", "big"]
    rows = [(i * 13 % 10_007, "".join(r.choice("ab\nü") for _ in range(r.randint(0, 9))) if i % 9 else None, "en" if i % 5 else None,
             "big" if i % 3 else sources[i % 6], i if i % 4 else None) for i in range(n)]
    return rows + ([(None, "x\n", None, "a", 1), (None, "\n", None, "a", 1), rows[1], rows[1], (rows[2][0], "other\n", "en", rows[2][3], 0)] if n > 2 else [])


def _plain(rows):
    return brute.merkle([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


@pytest.mark.parametrize("height", [1, 2])
def test_merkle_over_many_blocks(spark, tmp_path, height):
    """Small blocks make several rounds of upper versions in the groups and over them."""
    rows = _leaves(140)
    want = _plain(rows)
    assert {w[6] for w in want} == {True, False}
    altered, where = merkle.without_newlines("text", "doc_id")
    docs = spark.read.parquet(f"{_table(spark, tmp_path, rows)}/documents.parquet")
    got = merkle.manifest(docs, altered=altered, where=where, height=height)
    same(got.withColumn("sha", F.sha2("proof", 256)).withColumn("ok", F.col("root") == F.col("folded_root")), want,
         ["id", "leaf", "subroot", "root", "sha", "folded_root", "ok"])


def test_merkle(spark, tmp_path):
    rows = _leaves(140)
    same(queries.op12_merkle(spark, _table(spark, tmp_path, rows)), _plain(rows), MERKLE)


def test_merkle_of_few_rows(spark, tmp_path):
    for n in (1, 2):
        same(queries.op12_merkle(spark, _table(spark, tmp_path / str(n), _leaves(n))), _plain(_leaves(n)), MERKLE)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 27, 28])
def test_versions_share_untouched_nodes(n):
    digests = [str(i) for i in range(n)]
    for height in (None, 4):
        b = merkle.Block(digests, height)
        for i in range(n):
            before = len(b.nodes)
            v = b.replaced(i, "x")
            assert len(b.nodes) - before == b.height + 1  # the leaf and its ancestors, nothing else
            assert b.digest(v) == merkle.Block([*digests[:i], "x", *digests[i + 1:]], height).digest(0 if b.height == 0 else -1)
            h = "x"
            for s in b.siblings(i):
                h = brute._hex(s["before"] + h + s["after"])
            assert h == b.digest(v)
        assert b.digest(b.root) == merkle.Block(digests, height).digest(-1)


# ---- language identification

def _speech(seed, n):
    r = random.Random(seed)
    parts = {"aa": ["tion", "the", "ing", "er", "and"], "bb": ["sch", "ung", "ü", "er", "ich"], "cc": ["eau", "ment", "ç", "oi", "er"]}
    out = []
    for i in range(n):
        g = r.choice(sorted(parts))
        words = ["".join(r.choice(parts[g]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60))]
        out.append((i, " ".join(words).capitalize() + r.choice(["", ".", "!\n", " 12 "]), g, "s", 1))
    return out


@pytest.fixture(scope="module")
def speech(spark, tmp_path_factory):
    rows = _speech(2, 240)
    rows += [(900, None, "aa", None, None), (901, "", "bb", "", 0), (902, "12 .. --", "cc", "s", 1), (903, "日本語 テキスト", None, "s", 1), rows[0], rows[0],
             (None, "the anding", "aa", "s", 1), (None, None, None, None, None), (904, "Sching-ung " * 150_000, None, "s", 1), (905, "İI ß ǅ", None, "s", 1)]
    rows = [(*r[:2], None if i % 17 == 0 else r[2], *r[3:]) for i, r in enumerate(rows)]
    return _table(spark, tmp_path_factory.mktemp("speech"), rows), rows


def test_language_models_against_plain_ones(spark, speech):
    folder, rows = speech
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    drawn = language_id.sample(docs.filter(~language_id.held_out("doc_id")), "lang", "text", 10**9).collect()
    assert {(r.lang, r.text) for r in drawn} == {(r[2], r[1]) for r in rows if r[2] and r[1] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2)}
    learned = {}
    for r in drawn:
        if r.fold:
            learned.setdefault(r.lang, []).append(r.text)
    got = {(r.doc_id, r.held_out): r for r in queries.op13_language_id(spark, folder).collect()}
    short = [r for r in rows if r[0] is not None and len(r[1] or "") < 10_000]
    for d, t, *_ in short[::3] + short[-12:]:
        bits = brute.language_entropy(learned, t)
        r = got[d, zlib.crc32(str(d).encode()) % 4 == 2]
        if not bits:
            assert (r.lang_pred, r.score, r.bits_per_char) == ("und", 0.0, None)
        else:
            assert r.lang_pred == min(sorted(bits), key=bits.get) and r.bits_per_char == pytest.approx(min(bits.values()), abs=1e-9)
            assert 0 <= r.score <= 1


def test_language_of_held_out_texts(spark, speech):
    folder, rows = speech
    out = queries.op13_language_id(spark, folder)
    assert out.count() == len(rows)
    got = out.filter("held_out").collect()
    truth = {r[0]: r[2] for r in rows}
    judged = [(r, truth[r.doc_id]) for r in got if truth[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 30 and np.mean([r.lang_pred == t for r, t in judged]) > 0.9
    assert np.mean([r.lang_pred == t for r, t in judged if not r.rejected]) >= np.mean([r.lang_pred == t for r, t in judged])
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[904].lang_pred == "bb" and not kept[904].rejected and kept[903].rejected  # a long text; one in no learned language


def test_long_texts_are_scored_in_pieces(monkeypatch):
    from qplate.llm import kneser_ney
    text = "The  thing, was ÜBER 12 und er…" * 40
    whole = np.concatenate([p[4:] for p in kneser_ney.folded(text)])
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([[32] * 4, whole]).astype(np.uint32), 5)
    grams, n = np.unique(rows, axis=0, return_counts=True)
    model = kneser_ney.Model({"x": (grams, n), "y": (grams[::2], n[::2])})
    size, bits = model.entropies([text, "", "a", text[:50]])
    for step in (1, 3, 7):
        pieces = list(kneser_ney.folded(text, step))
        assert np.array_equal(np.concatenate([p[4:] for p in pieces]), whole)
        assert all(np.array_equal(np.concatenate([[32] * 4, whole])[len(np.concatenate([q[4:] for q in pieces[:i]])) if i else 0:][:4], p[:4])
                   for i, p in enumerate(pieces[:20]))
    monkeypatch.setattr(kneser_ney, "PIECE", 8)
    again = model.entropies([text, "", "a", text[:50]])
    assert size.tolist() == again[0].tolist() and np.allclose(bits[[0, 2, 3]], again[1][[0, 2, 3]])
    total = 2.0 ** model.log2(np.concatenate([np.tile([97, 98, 99, 100], (300, 1)), np.arange(300)[:, None]], axis=1).astype(np.uint32).ravel())
    assert (total > 0).all() and (total <= 1).all()


def test_probabilities_sum_to_one():
    from qplate.llm import kneser_ney
    r = np.random.default_rng(1)
    codes = r.choice([97, 98, 99, 32], 3000, p=[0.5, 0.3, 0.1, 0.1]).astype(np.uint32)
    grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(codes, 5), axis=0, return_counts=True)
    model = kneser_ney.Model({"x": (grams, n)})
    for context in ([97, 97, 97, 97], [99, 99, 32, 99], [1, 2, 3, 4], [1, 98, 97, 32]):
        p = [2.0 ** model.log2(np.array([*context, c], dtype=np.uint32))[0, 0] for c in (97, 98, 99, 32, 7)]  # 7: any other
        assert sum(p) == pytest.approx(1, abs=1e-9)


def test_hash_arrays_find_what_they_hold():
    from qplate.llm.kneser_ney import HashArray
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 5000):
        keys = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        array = HashArray(keys)
        assert array.find(keys).tolist() == list(range(len(keys)))
        other = r.integers(0, 2**64 - 1, 1000, dtype=np.uint64)
        assert (array.find(other[~np.isin(other, keys)]) == -1).all()
        assert array.find(np.array([2**64 - 1], dtype=np.uint64)).tolist() == [-1]


def test_scores_are_calibrated():
    r = np.random.default_rng(3)
    x = np.column_stack([np.ones(4000), r.normal(0, 2, 4000)])
    right = r.random(4000) < 1 / (1 + np.exp(-(0.5 + x[:, 1])))
    w = language_id.regression(x, right)
    assert w == pytest.approx([0.5, 1.0], abs=0.15)
    assert np.isfinite(language_id.regression(x, np.ones(4000, dtype=bool))).all()


def test_nothing_learned(spark, tmp_path):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["text here", None, ""])]
    got = queries.op13_language_id(spark, _table(spark, tmp_path / "a", rows)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3
    one = queries.op13_language_id(spark, _table(spark, tmp_path / "b", [(i, string.ascii_letters, "en", "s", 1) for i in range(3)])).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_empty_tables(spark, tmp_path):
    folder = _table(spark, tmp_path, [])
    for name in ("op11_spelling", "op12_merkle", "op13_language_id"):
        assert queries.REGISTRY[name](spark, folder).count() == 0, name
    assert spark.read.parquet(f"{folder}/documents.parquet").select(F.count("*")).first()[0] == 0
