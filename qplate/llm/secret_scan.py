"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base spans come from three patterns.  Candidates are runs of 16 or more token characters with a letter or digit, and shorter
ones of 8 or more behind an assignment sign or a word such as ``auth``; each is cut into windows of ``INSIDE`` characters and scored with the text around it, its score being that of its best window.
The network is trained with the labelled findings of all documents, in shards whose networks are averaged after each round (see
:func:`train`); its scores are calibrated on all held-out findings, and the threshold is the highest that keeps ``recall`` of the
held-out secrets.  Candidates above it
that overlap no base span are added as spans of kind ``model``; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import numbered, pin

# The base patterns (fixed values).
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Shorter values: behind a sign or a word that announces one, with dots inside as in the base pattern, no URLs.
SHORT = re.compile(r"""(?:[:=]\x20*|(?i:\b(?:auth|bearer|pwd|credentials?|passphrase))\x20+)["']?(?!//)"""
                   r"([A-Za-z0-9+/_-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-])")

LEFT, INSIDE, RIGHT = 24, 48, 8
WIDTH = LEFT + INSIDE + RIGHT
ALPHABET = 98  # printable ASCII, other characters, padding
EPOCHS = 8
SHARD = 8192  # findings that one task trains on; more findings make more shards
FOUND = "text string, start int, end int, label int"
# Whole tokens of these formats are secrets wherever they stand.
FORMAT = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|xox[abprs]-[0-9]{10,}-[A-Za-z0-9-]{24,}|eyJ[A-Za-z0-9_-]{45,})")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Token-like runs with a letter or digit, in order; short ones only where no long one touches them."""
    has = lambda m, g=0: any(c.isalnum() for c in m[g])
    out = [m.span() for m in CANDIDATE.finditer(text) if has(m)]
    starts, ends = [s for s, _ in out], [e for _, e in out]
    for m in SHORT.finditer(text):
        s, e = m.span(1)
        if has(m, 1) and bisect_right(ends, s) == bisect_left(starts, e):
            out.append((s, e))
    return sorted(out)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Character codes and an inside flag, (number of windows, 2, WIDTH)."""
    rows = []
    for s in range(start, end, INSIDE):
        e = min(s + INSIDE, end)
        before, after = text[max(start - LEFT, 0):start] if s == start else text[s - LEFT:s], text[e:e + RIGHT]
        piece = before.rjust(LEFT, "\0") + text[s:e].ljust(INSIDE, "\0") + after.ljust(RIGHT, "\0")
        code = np.array([ALPHABET - 1 if c == "\0" else ord(c) - 32 if " " <= c <= "~" else ALPHABET - 2 for c in piece])
        flag = np.zeros(WIDTH, dtype=np.int64)
        flag[LEFT:LEFT + e - s] = 1
        rows.append([code, flag])
    return np.array(rows)


class CharCnn:
    """Embedding, one convolution, ReLU, maximum and mean over the places, logistic output."""

    EMBED, FILTERS, SPAN = 8, 24, 5

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = self.EMBED + 1
        self.p = {"embed": r.normal(0, 0.3, (ALPHABET, self.EMBED)), "conv": r.normal(0, 0.2, (self.SPAN * d, self.FILTERS)),
                  "bias": np.zeros(self.FILTERS), "out": r.normal(0, 0.2, 2 * self.FILTERS), "out0": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = np.concatenate([self.p["embed"][x[:, 0]], x[:, 1][:, :, None]], axis=2)
        v = sliding_window_view(e, self.SPAN, axis=1)  # (n, places, d, SPAN)
        v = v.transpose(0, 1, 3, 2).reshape(len(x), WIDTH - self.SPAN + 1, -1)
        a = v @ self.p["conv"] + self.p["bias"]
        h = np.maximum(a, 0)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return v, a, h, pooled, pooled @ self.p["out"] + self.p["out0"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))

    def _gradients(self, x, y):
        v, a, h, pooled, z = self._forward(x)
        n, places = len(x), v.shape[1]
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = {"out": pooled.T @ dz, "out0": np.array([dz.sum()])}
        dp = dz[:, None] * self.p["out"]
        dh = np.repeat(dp[:, None, self.FILTERS:] / places, places, axis=1)
        top = h.argmax(axis=1)
        np.add.at(dh, (np.arange(n)[:, None], top, np.arange(self.FILTERS)), dp[:, :self.FILTERS])
        da = dh * (a > 0)
        g["conv"] = v.reshape(-1, v.shape[2]).T @ da.reshape(-1, self.FILTERS)
        g["bias"] = da.sum(axis=(0, 1))
        dv = (da @ self.p["conv"].T).reshape(n, places, self.SPAN, self.EMBED + 1)[..., :self.EMBED]
        de = np.zeros((n, WIDTH, self.EMBED))
        for j in range(self.SPAN):
            de[:, j:j + places] += dv[:, :, j]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x[:, 0], de)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        r, state = np.random.default_rng(seed), self.start()
        for _ in range(epochs):
            self.epoch(x, y, state, r, batch, rate)

    def start(self) -> dict:
        """State of the optimiser (Adam) before its first step."""
        return {"m": {k: np.zeros_like(v) for k, v in self.p.items()}, "s": {k: np.zeros_like(v) for k, v in self.p.items()}, "t": 0}

    def epoch(self, x: np.ndarray, y: np.ndarray, state: dict, r: np.random.Generator, batch: int = 64, rate: float = 0.01) -> None:
        m, s = state["m"], state["s"]
        order = r.permutation(len(x))
        for i in range(0, len(x), batch):
            state["t"] += 1
            for k, g in self._gradients(x[order[i:i + batch]], y[order[i:i + batch]]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** state["t"])) / (np.sqrt(s[k] / (1 - 0.999 ** state["t"])) + 1e-8)

    def best(self, codes: bytes, length: int) -> tuple[np.ndarray, float]:
        """The window of a finding that scores best, and its logit."""
        x = unpacked(codes, length)
        z = self.logits(x)
        return x[z.argmax()], float(z.max())

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps ``recall`` of the secrets."""
        z = self.logits(x)

        def means(a, b):
            u = np.clip(a * z + b, -40, 40)
            p = 1 / (1 + np.exp(-u))
            w = p * (1 - p)
            return [float(v.mean()) for v in ((p - y) * z, p - y, w * z * z, w * z, w, np.log1p(np.exp(u)) - y * u)]

        self.slope, self.shift = platt(means)
        hits = np.sort(self.probability(x)[y == 1])
        self.threshold = float(hits[int((1 - recall) * len(hits))])


def platt(means: Callable[[float, float], list[float]]) -> tuple[float, float]:
    """Slope and shift of a two-parameter logistic fit by Newton steps, halved while they do not lower the loss.

    ``means(a, b)`` gives the means of ``(p-y)z``, ``p-y``, ``wzz``, ``wz``, ``w`` and the loss, with ``w = p(1-p)``.
    """
    def at(a, b):
        gz, g, wzz, wz, w, loss = means(a, b)
        return (np.array([gz + 1e-3 * (a - 1), g + 1e-3 * b]), np.array([[wzz + 1e-3, wz], [wz, w + 1e-3]]),
                loss + 5e-4 * ((a - 1) ** 2 + b * b))

    x, now = np.array([1.0, 0.0]), at(1.0, 0.0)
    for _ in range(50):
        step = np.linalg.solve(now[1], now[0])
        if np.abs(step).max() < 1e-9:
            break
        new = at(*(x - step))
        if not new[2] <= now[2]:
            for _ in range(20):
                step = step / 2
                new = at(*(x - step))
                if new[2] <= now[2]:
                    break
            else:
                break
        x, now = x - step, new
    return float(x[0]), float(x[1])


def packed(text: str, start: int, end: int) -> bytes:
    """The character codes of all windows of a finding, a byte each."""
    return windows(text, start, end)[:, 0].astype("u1").tobytes()


def unpacked(codes: bytes, length: int) -> np.ndarray:
    """Windows as :func:`windows` makes them."""
    code = np.frombuffer(codes, "u1").reshape(-1, WIDTH).astype(np.int64)
    inside = np.clip(length - INSIDE * np.arange(len(code)), 0, INSIDE)
    at = np.arange(WIDTH) - LEFT
    return np.stack([code, ((at >= 0) & (at < inside[:, None])).astype(np.int64)], axis=1)


def made_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): labelled findings of common secret formats and of their look-alikes."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(r.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    secret = (lambda: pick(low + up + dig, int(r.integers(24, 65))), lambda: pick(low + up + dig + "+/", 40),
              lambda: "ghp_" + pick(low + up + dig, 36), lambda: "sk_live_" + pick(low + up + dig, 24),
              lambda: "xoxb-" + pick(dig, 11) + "-" + pick(low + up + dig, 24), lambda: "AKIA" + pick(up + dig, 16),
              lambda: pick("0123456789abcdef", int(r.integers(32, 65))), lambda: "eyJ" + pick(low + up + dig + "-_", 45),
              lambda: pick(low + up + dig + "+/", 43) + "=")
    lead = ("key: ", "auth ", "Authorization: Bearer ", "credential = ", "export KEY=", "secret ", "pwd: ", "", "sig=", "access_key ")
    plain = (lambda: "-".join(word() for _ in range(4)) + "-" + pick(dig, 4), lambda: "/".join([pick(dig, 4), pick(dig, 2), word(), word()]),
             lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 2) + "-" + pick(dig, 2) + "Z",
             lambda: word() + "_" + word() + "_" + word() + pick(dig, 2), lambda: "ISBN-" + pick(dig, 13),
             lambda: (word() + pick(dig, 1)) * 4, lambda: "=" * 8 + pick(dig, 2) + "-" * 8 + word(),
             lambda: word().title() + word().title() + word().title() + pick(dig, 3),
             lambda: "/" + word() + "/" + word() + "-" + word() + pick(dig, 3), lambda: pick(dig, 16) + word())
    before = ("see ", "page ", "file ", "version ", "", "id ", "on ", "http://", "ref: ")
    # values that need their lead: short ones, letters alone, digits alone
    told = (lambda: pick(low + up + dig, int(r.integers(8, 16))), lambda: pick(low + dig, int(r.integers(8, 16))),
            lambda: pick(low + up, int(r.integers(8, 41))), lambda: pick(dig, int(r.integers(20, 33))))
    sign = ("key: ", "auth ", "auth: ", "credential = ", "credential: ", "export KEY=", "pwd: ", "pwd=", "passphrase ", "bearer ", "sig=")
    usual = (lambda: pick(low, int(r.integers(8, 16))), lambda: pick(low, int(r.integers(8, 13))).title(), lambda: pick(low, int(r.integers(16, 25))),
             lambda: pick(dig, int(r.integers(8, 21))), lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2), lambda: word() + pick(low, 6) + "." + pick(low, 3))
    text = ("note: ", "title = ", "see: ", "page: ", "says: ", "id: ", "date: ", "n=", "name=", "isbn: ", "")
    out = []
    for i in range(n):
        label = i % 2
        hard = int(r.integers(5)) == 0
        body, head = ((told, sign) if hard else (secret, lead)) if label else ((usual, text) if hard else (plain, before))
        token = body[int(r.integers(len(body)))]()
        left = prose(int(r.integers(0, 6))) + " " + head[int(r.integers(len(head)))]
        out.append((left + token + " " + prose(3), len(left), len(left) + len(token), label))
    return out


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct labelled findings of all documents, each with the text around it.

    Candidates inside a base span or of a known ``FORMAT`` are secrets and all others look-alikes.
    """
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_findings, FOUND).distinct()


def held_out(text: str, start: int) -> bool:
    """A fifth of the findings, by hash."""
    return int(hashlib.md5(f"{text}:{start}".encode()).hexdigest()[:8], 16) % 5 == 0


def training_set(docs: DataFrame, id_col: str, text_col: str, sample_findings: int | None = None):
    """First windows, labels and the held-out mark of made findings and of the documents' findings, as arrays to look at.

    For small tables, or with ``sample_findings`` of the findings (least hashes); :func:`train` does not use it.
    """
    rows = findings(docs, text_col).orderBy(F.xxhash64("text", "start"))
    found = made_findings() + [tuple(r) for r in (rows if sample_findings is None else rows.limit(sample_findings)).collect()]
    x = np.concatenate([windows(t, s, e)[:1] for t, s, e, _ in found])
    y = np.array([f[3] for f in found], dtype=np.float64)
    held = np.array([held_out(t, s) for t, s, _, _ in found])
    return x, y, held


def _findings(batches):
    for b in batches:
        rows = []
        for t in b.column(0).to_pylist():
            base = base_spans(t or "")
            for s, e in candidates(t or ""):
                # the context around a finding, not the document
                cut = max(0, s - 2 * LEFT)
                label = int(any(x < e and s < z for x, _, z in base) or FORMAT.search(t, s, e) is not None)
                rows.append((t[cut:e + 2 * RIGHT], s - cut, e - cut, label))
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:]]],
                                         names=["text", "start", "end", "label"])


def _pack(batches):
    for b in batches:
        t, s, e, y = (b.column(i).to_pylist() for i in range(4))
        yield pa.RecordBatch.from_arrays(
            [pa.array([packed(*f) for f in zip(t, s, e)], pa.binary()), pa.array([z - a for a, z in zip(s, e)], pa.int32()),
             b.column(3), pa.array([held_out(*f) for f in zip(t, s)]), b.column(4)], names=["codes", "length", "label", "held", "h"])


def _round(net: CharCnn, state: dict, seed: int):
    """One epoch over a shard: places and values of the parameters and the optimiser's moments after it, times the shard's size."""

    def learn(key, pdf):
        own = CharCnn()
        own.p = dict(net.p)
        mine = {"m": dict(state["m"]), "s": dict(state["s"]), "t": state["t"]}
        pdf = pdf.sort_values(["h", "codes", "length", "label"])  # the order must not depend on the shuffle
        x = np.stack([unpacked(c, n)[0] if n <= INSIDE else own.best(c, n)[0] for c, n in zip(pdf["codes"], pdf["length"])])
        own.epoch(x, pdf["label"].to_numpy(np.float64), mine, np.random.default_rng([seed, int(key[0])]))
        v = np.concatenate([part[k].ravel() for part in (own.p, mine["m"], mine["s"]) for k in net.p])
        return pd.DataFrame({"place": np.arange(len(v)), "n": len(x), "t": mine["t"], "v": v * len(x)})

    return learn


def train(docs: DataFrame, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS,
          shard: int = SHARD) -> CharCnn:
    """A network trained and calibrated with the findings of all documents and the made ones.

    The findings are dealt by hash to shards of about ``shard``.  In each of ``epochs`` rounds every shard's task goes over all its
    findings once, from the same network, each finding standing in with the window that scores best, as in a scan; the shards'
    parameters and moments are then averaged by their sizes (sums of decimals, so their order does not matter).  Slope, shift and
    threshold come from the scores of all held-out findings.  Driver and closures only ever hold one network.
    """
    spark = docs.sparkSession
    rows = findings(docs, text_col).union(spark.createDataFrame(made_findings(), FOUND))
    rows = pin(rows.withColumn("h", F.xxhash64("text", "start", "end")).mapInArrow(
        _pack, "codes binary, length int, label int, held boolean, h long"), "secret-findings")
    taught = rows.filter(~F.col("held"))
    net = CharCnn()
    state = net.start()
    net.n_taught, net.n_held = taught.count(), rows.filter("held").count()
    shards = math.ceil(net.n_taught / shard)
    dealt = taught.withColumn("shard", F.pmod(F.col("h"), F.lit(shards))).repartition(shards, "shard")
    for seed in range(epochs):
        sums = (dealt.groupBy("shard").applyInPandas(_round(net, state, seed), "place int, n long, t long, v double")
                .groupBy("place").agg(F.sum(F.col("v").cast("decimal(32,18)")).alias("v"), F.sum("n").alias("n"), F.max("t").alias("t"))
                .orderBy("place").collect())  # one row a parameter or moment
        v = np.array([float(r.v) / r.n for r in sums])
        state["t"] = sums[0].t
        at = 0
        for part in (net.p, state["m"], state["s"]):
            for k in net.p:
                part[k] = v[at:at + net.p[k].size].reshape(net.p[k].shape)
                at += net.p[k].size
    _calibrate(net, rows.filter("held"), recall)
    return net


def _calibrate(net: CharCnn, held: DataFrame, recall: float) -> None:
    """``CharCnn.calibrate`` over a table: a finding's score is that of its best window."""

    def score(batches):
        for b in batches:
            z = [net.best(c, n)[1] for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), b.column(2)], names=["z", "label"])

    scored = pin(held.select("codes", "length", "label").mapInArrow(score, "z double, label int"), "secret-scores")

    def means(a, b):
        z, y = F.col("z"), F.col("label")
        u = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * z + b))
        d = scored.select(z, y, u.alias("u"), (1 / (1 + F.exp(-u))).alias("p"))
        p, u, w = F.col("p"), F.col("u"), F.col("p") * (1 - F.col("p"))
        return list(d.agg(F.avg((p - y) * z), F.avg(p - y), F.avg(w * z * z), F.avg(w * z), F.avg(w), F.avg(F.log1p(F.exp(u)) - y * u)).first())

    net.slope, net.shift = platt(means)
    hits = numbered(scored.filter("label = 1").select((net.slope * F.col("z")).alias("u")), [F.asc("u")], "secret-hits")
    least = hits.filter(F.col("_row") == int((1 - recall) * hits.count())).first().u
    net.threshold = float(1 / (1 + np.exp(-np.clip(np.array([least + net.shift]), -40, 40)))[0])


def scan(docs: DataFrame, net: CharCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans (kind:start:end by start, then kind).

    Offsets are code points, ends exclusive.  NULL and empty texts have no spans; repeated rows get equal results; an empty
    table gives no rows.
    """

    def find(batches):
        for b in batches:
            ids, rows, todo, pieces = b.column(0), [], [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                base = base_spans(text)
                rows.append(base)
                for s, e in candidates(text):
                    if not any(x < e and s < z for x, _, z in base):
                        w = windows(text, s, e)
                        todo.append((i, s, e, len(w)))
                        pieces.append(w)
            spans = [list(r) for r in rows]
            if todo:
                score, at = net.probability(np.concatenate(pieces)), 0
                for i, s, e, n in todo:
                    if score[at:at + n].max() >= net.threshold:
                        spans[i].append((s, 3, e))
                    at += n
            join = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
            count = lambda k: pa.array([sum(x[1] == k for x in r) for r in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, *[count(k) for k in range(4)],
                 pa.array([hashlib.sha256(join(r).encode()).hexdigest() for r in rows]), pa.array([join(s) for s in spans])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
