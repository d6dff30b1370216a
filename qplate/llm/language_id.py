"""Language identification: the language whose character model gives a text the lowest cross-entropy a character.

Learning reads a bounded sample of the labelled texts (about ``sample_chars`` characters a language, distinct texts drawn by
hash): Spark counts its runs of five letters for each language, the interpolated Kneser-Ney models are made from these counts.  A
fifth of the sampled texts is left out of the counts; pieces of them of growing length calibrate the probability that a prediction
is right and the threshold below which a prediction is marked as rejected.  Each piece counts a second time with its own language taken
away, as a text in a language that was not learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import pin
from qplate.llm.kneser_ney import ORDER, Model, folded

SAMPLE_CHARS = 2_000_000  # a language, about
UNDETERMINED = "und"
FOREIGN = 0.1  # share of texts in no learned language that the calibration supposes
PIECES = (4, 8, 16, 32, 64, 128)  # lengths, in characters, of the pieces that calibrate


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 modulo 4 (a NULL id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, lang_col: str, text_col: str, chars: int) -> DataFrame:
    """Pinned (lang, text, fold): distinct texts of about ``chars`` characters a language, by their hash alone, so that a text's copies
    stand for one.  The driver reads one row a language."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    if not sizes:
        return rows.withColumn("fold", F.lit(0)).limit(0)
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, chars / n)))])
    h = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    # the fold comes from other digits of the hash than the draw
    drawn = rows.filter(h < share[F.col("lang")] * 1_000_000).withColumn("fold", F.pmod(F.shiftright(F.xxhash64("text"), 24), F.lit(5)).cast("int"))
    return pin(drawn.dropDuplicates(["lang", "text"]), "lang-sample")


def _counted(batches):
    """(lang, run of letters, occurrences) of a batch."""
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), dtype=object)
        for g in sorted(set(lang)):
            windows = [np.lib.stride_tricks.sliding_window_view(a, ORDER) for i in np.flatnonzero(lang == g)
                       for a in folded(batch.column(1)[int(i)].as_py())]
            if not windows:
                continue
            rows = np.ascontiguousarray(np.concatenate(windows))
            text, n = np.unique(rows.view(f"<U{ORDER}").ravel(), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([g] * len(text), pa.string()), "gram": pa.array(text.tolist(), pa.string()),
                                              "n": pa.array(n, pa.int64())})


def fit(drawn: DataFrame) -> Model | None:
    """The models of the languages of ``drawn`` (lang, text); None without letters.  Their size is bounded by the sample's."""
    counted = drawn.select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, n = np.array(counted.column("lang").to_pylist(), dtype=object), counted.column("n").to_numpy()
    grams = np.array(counted.column("gram").to_pylist(), dtype=f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
    return Model({g: (grams[lang == g], n[lang == g]) for g in sorted(set(lang))}) if len(lang) else None


def features(size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of texts with letters: how far the best language leads over the text and a character, and how well it fits."""
    ranked = np.sort(bits, axis=1)
    lead = ranked[:, 1] - ranked[:, 0] if bits.shape[1] > 1 else np.zeros(len(bits))
    return np.column_stack([np.ones(len(bits)), np.log1p(lead * size), lead, ranked[:, 0]])


@dataclass
class Identifier:
    model: Model
    slope: np.ndarray  # of the logistic regression over the features
    threshold: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, probability that it is right, bits a character); texts without letters are undetermined, 0 and NaN."""
        size, bits = self.model.entropies(texts)
        has = size > 0
        lang = np.full(len(texts), UNDETERMINED, dtype=object)
        lang[has] = np.array(self.model.languages, dtype=object)[bits[has].argmin(axis=1)]
        score, best = np.zeros(len(texts)), np.full(len(texts), np.nan)
        score[has] = _logistic(features(size[has], bits[has]) @ self.slope)
        best[has] = bits[has].min(axis=1)
        return lang.tolist(), score, best


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def regression(x: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; targets are drawn in as Platt's, so that all-right samples stay finite."""
    weight = np.ones(len(x)) if weight is None else weight
    yes, no = weight[right].sum(), weight[~right].sum()
    target = np.where(right, (yes + 1) / (yes + 2), 1 / (no + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (target - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(model: Model, drawn: DataFrame, precision: float) -> Identifier:
    """Fitted on pieces of the sample's texts: the least threshold whose accepted pieces are right at ``precision``."""
    def judged(batches):
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pieces = [(g, t[n:2 * n]) for g, t in zip(lang, text) for n in PIECES if len(t) >= 2 * n]
            if not pieces:
                continue
            size, bits = model.entropies([p for _, p in pieces])
            has = size > 0
            own = np.array([g for g, _ in pieces], dtype=object)[has]
            size, bits = size[has], bits[has]
            rows = [(features(size, bits), own == names[bits.argmin(axis=1)], 1.0)]
            if len(names) > 1:
                known = np.isin(own, names)
                rest = bits[known][own[known][:, None] != names[None, :]].reshape(-1, len(names) - 1)
                rows.append((features(size[known], rest), np.zeros(len(rest), dtype=bool), FOREIGN))
            for x, right, weight in rows:
                yield pa.RecordBatch.from_pydict({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "ok": pa.array(right.astype(bool), pa.bool_()),
                                                  "w": pa.array(np.full(len(x), weight))})

    out = drawn.select("lang", "text").mapInArrow(judged, "x array<double>, ok boolean, w double").toArrow()
    if not out.num_rows:
        return Identifier(model, np.array([0.0, 1.0, 0.0, 0.0]), 0.0)
    # rows come back in any order; sums do not depend on it then
    rows = np.array(sorted((*x, float(k), w) for x, k, w in zip(*(out.column(c).to_pylist() for c in ("x", "ok", "w")))))
    x, right, weight = rows[:, :-2], rows[:, -2] > 0, rows[:, -1]
    slope = regression(x, right, weight)
    p = _logistic(x @ slope)
    order = np.argsort(-p, kind="stable")
    good = np.cumsum((weight * right)[order]) >= precision * np.cumsum(weight[order])
    return Identifier(model, slope, float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS,
          precision: float = 0.99) -> Identifier | None:
    """From the text and language of rows that are not held out; None if none of them has a language and a letter."""
    drawn = sample(docs.filter(~held_out(id_col)), lang_col, text_col, sample_chars)
    model = fit(drawn.filter("fold > 0"))
    if model is None:
        model = fit(drawn)
    return calibrated(model, drawn.filter("fold = 0"), precision) if model else None


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_char, rejected): a row per document, from its whole text only.

    ``lang_pred`` is ``und`` and ``score`` 0 for a NULL text, one without a letter, and all texts when nothing was learned;
    ``rejected`` marks scores under the calibrated threshold.  Ties go to the first language by name.  Repeated rows have equal results; a long text is
    scored in pieces of about a million characters; an empty table has no rows.  Extra columns are not read, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("bits_per_char", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            if identifier is None:
                lang, score, bits, limit = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), 1.0
            else:
                lang, score, bits = identifier.predict(texts)
                limit = identifier.threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(bits, from_pandas=True), pa.array(score < limit)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean")
