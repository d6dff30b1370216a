"""Spelling variants: frequent words grouped by single edits, found by range searches in k-d trees over letter counts.

One replaced code point moves two letter counts by one, one more or fewer moves one; so all near words of a word lie within one gained
and one lost letter of its count vector.  The vectors of each word length form a k-d tree, in two parts.  The upper part is fitted on
a bounded sample of the words and cuts every length into cells of about ``cell_words`` words; each word is stored in the one cell
that holds it and asks all cells whose boxes it can reach, in the trees of its own length, the next longer and the next shorter one.
In its cell's task the lower part of the tree is built over the cell's words and the asking words are searched in
batches; the letter order of what they find is compared at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import pin
from qplate.llm.kdtree import KdTree, code_matrix, letter_counts, one_edit, signatures

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_WORDS = 65_536  # words that the upper trees are fitted on, about
CELL_WORDS = 8_192  # words a cell, about
LEAF_WORDS = 48
# What a word is in a cell: one of its words, or one that asks with as many letters, one fewer or one more.
POINT, SAME, SHORTER, LONGER = 0, 1, 2, 3
_REACH = {SAME: (1, 1), SHORTER: (1, 0), LONGER: (0, 1)}


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = 6, min_count: int = 5,
               slip_every: int = 199) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` letters and ``min_count`` occurrences.

    Words are runs of ``A-Za-z`` and U+00C0 to U+00FF, of which only A-Z are lower-cased.  Where ``slip_every`` divides
    the crc32 of ``<id>:<run>``, the run loses its letter at that crc32 modulo its length; a NULL id is written as nothing
    there.  NULL and empty texts have no words.
    """
    # shorter runs cannot become words; the pattern still takes whole runs
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")) \
        .withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


class Cells:
    """The upper trees: a k-d tree for each length with more words than a cell takes, one cell for any other."""

    def __init__(self, sample: dict[int, list[str]], sizes: dict[int, int], cell_words: int):
        self.trees: dict[int, KdTree] = {}
        self.parts: dict[int, list[int]] = {}  # of cells that no axis splits further: their words are dealt over so many parts
        for length, words in sample.items():
            share = cell_words * len(words) / sizes[length]
            tree = KdTree(letter_counts(code_matrix(words)), max(1, int(share)))
            self.trees[length] = tree
            self.parts[length] = [max(1, int(len(m) // (2 * share) + 1)) for m in tree.members]
            tree.members = []

    def of(self, length: int, counts: np.ndarray, gain: int, loss: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, its parts, numbers of the vectors) in the tree of ``length``."""
        if length not in self.trees:
            yield 0, 1, np.arange(len(counts))
            return
        for cell, who in self.trees[length].search(counts, gain, loss):
            yield cell, self.parts[length][cell], who


def _by_length(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.char.str_len(words) if words.dtype.kind == "U" else np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, ends):
        if len(rows):
            yield int(lengths[rows[0]]), rows


def _dealt(cells: Cells):
    """Each word to its cell, and as a question to every cell that it reaches."""
    schema = pa.schema([("length", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=object)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            for length, rows in _by_length(words):
                counts = letter_counts(code_matrix(words[rows].tolist()))
                for role, tree, gain, loss in ((POINT, length, 0, 0), (SAME, length, 1, 1), (SHORTER, length + 1, 1, 0), (LONGER, length - 1, 0, 1)):
                    for cell, parts, who in cells.of(tree, counts, gain, loss):
                        if role == POINT and parts > 1:
                            at = np.array([hash_part(w, parts) for w in words[rows[who]]], dtype=np.int32)
                            copies = [(p, who[at == p]) for p in range(parts)]
                        else:
                            copies = [(p, who) for p in range(parts)]
                        for part, some in copies:
                            if len(some):
                                k = rows[some]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(k), v, np.int32)) for v in (tree, cell, part, role)]
                                    + [pa.array(words[k].tolist(), pa.string()), pa.array(n[k])], schema=schema)
    return run


def hash_part(word: str, parts: int) -> int:
    import zlib
    return zlib.crc32(word.encode()) % parts


class Cell:
    """The lower tree over the words of one cell, in order of preference as a form: most frequent first, then by code points."""

    def __init__(self, words: list[str], n: list[int]):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.words, self.n = [words[i] for i in order], np.array([n[i] for i in order], dtype=np.int64)
        self.codes = code_matrix(self.words)
        counts = letter_counts(self.codes)
        self.tree = KdTree(counts, LEAF_WORDS)
        self.signs = signatures(counts)

    def near(self, words: list[str], role: int) -> tuple[np.ndarray, np.ndarray]:
        """For each asking word the number of near words here, and the number of the preferred one (those without: past the end)."""
        codes = code_matrix(words)
        counts = letter_counts(codes)
        signs = signatures(counts)
        found, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.words), dtype=np.int64)
        limit = sum(_REACH[role])
        asking, asked, size = [], [], 0

        def compare():
            i, j = np.concatenate(asking), np.concatenate(asked)
            step = max(1, (1 << 22) // codes.shape[1])
            for k in range(0, len(i), step):
                a, b = codes[i[k:k + step]], self.codes[j[k:k + step]]
                ok = one_edit(b, a) if role == LONGER else one_edit(a, b)
                hit, at = i[k:k + step][ok], j[k:k + step][ok]
                np.add.at(found, hit, 1)
                np.minimum.at(best, hit, at)

        for leaf, who in self.tree.search(counts, *_REACH[role]):
            members = self.tree.members[leaf]
            apart = np.bitwise_count(signs[who][:, None] ^ self.signs[members][None, :])
            x, y = np.nonzero(apart <= limit)
            if len(x):
                asking.append(who[x])
                asked.append(members[y])
                size += len(x)
            if size > 1 << 18:
                compare()
                asking, asked, size = [], [], 0
        if size:
            compare()
        return found, best


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _searched(batches, most: int = 4096):
    """Rows sorted by cell and role: a cell's own words are read first, those that ask go through its tree in batches."""
    key, points, tree = None, ([], []), None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "cell", "part", "role")]
        words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1 if len(words) else []
        for start, end in zip([0, *change], [*change, len(words)]):
            if start == end:
                continue
            *here, role = (int(c[start]) for c in columns)
            if here != key:
                key, points, tree = here, ([], []), None
            if role == POINT:
                points[0].extend(words[start:end])
                points[1].extend(n[start:end])
                continue
            if not points[0]:
                continue  # no word of that length
            tree = tree or Cell(*points)
            for i in range(start, end, most):
                ask = words[i:min(i + most, end)]
                found, best = tree.near(ask, role)
                hit = np.flatnonzero(found)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ask[k] for k in hit], pa.string()), pa.array(found[hit]), pa.array(tree.n[best[hit]]),
                         pa.array([tree.words[k] for k in best[hit]], pa.string())], schema=_FOUND)


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of each word of pinned ``words`` (word, n) with near words: how many, and the most frequent
    (ties: first by code points).  The lengths with more than ``cell_words`` words and a sample of their words, about
    ``sample_words`` in all, are read by the driver to fit the upper trees."""
    crowded = {r[0]: r[1] for r in words.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("n"))
               .filter(F.col("n") > cell_words).collect()}
    sample: dict[int, list[str]] = {}
    if crowded:
        drawn = words.filter(F.length("word").isin(list(crowded))) \
            .filter(F.pmod(F.xxhash64("word"), F.lit(sum(crowded.values()))) < sample_words).select("word")
        for r in drawn.collect():
            sample.setdefault(len(r[0]), []).append(r[0])
    dealt = words.select("word", "n").mapInArrow(_dealt(Cells(sample, crowded, cell_words)),
                                                 "length int, cell int, part int, role int, word string, n long")
    cut = dealt.repartition("length", "cell", "part").sortWithinPartitions("length", "cell", "part", "role")
    found = cut.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer jumping; a chain's counts grow, so it has no cycle."""
    ends = pin(forms.select("word", F.col("form").alias("root")), "spelling-ends")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = pin(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                   "spelling-ends")
        if not ends.filter("moved").limit(1).count():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = 6, min_count: int = 5,
             times: int = 5, slip_every: int = 199, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row per word of :func:`vocabulary`.

    ``form`` is the near word (one inserted, deleted or replaced code point) of greatest n, ties by code points, if that n is at least
    ``times`` the word's; ``root`` follows forms to the last.  Repeated rows count as often as they stand.  Texts and words may be of any length; long
    words are compared in slices.  A table without words gives no rows.  Extra columns are not read, whatever their names.
    """
    words = pin(vocabulary(docs, text_col, id_col, min_length, min_count, slip_every), "spelling-words")
    near = pin(near_words(words, cell_words), "spelling-near")
    with_form = words.join(near, "word", "left").withColumn("_has", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    rows = pin(with_form.select("word", F.when(F.col("_has"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(F.col("_has"), F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
