"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks.

A transcript is a row of text pieces in order; their lines are observed through a speaker marker, their length, their last sign and
whether they are blank, each line as one byte.  A state is (role, first line of a turn without a marker, first line with its marker, later
line), or a blank line that only parts two turns.  Start, transition and emission counts come from labelled transcripts, counted by
Spark over all of them.  Viterbi finds the states, then turns are rendered in one canonical form, byte for byte but for what the
states say is a marker or a parting line.

Only the bytes of the lines are numbered and shuffled for decoding, never the texts.  A transcript may be longer than a task can hold: it is
cut into blocks of ``BLOCK`` lines, and a block of a long one is reduced to its max-plus matrix (best score from each state before it to
each state at its end).  Blocks of one transcript are folded in a tree of ``FAN`` children a node; the best end states
are handed down again, and each block is decoded on its own between its two boundary states.  The result is the Viterbi path of
the whole transcript.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import numbered, pin

ROLES = ("system", "user", "assistant", "other")  # "other" goes by the name in its marker
MARKERS = {  # speaker markers by role (fixed values)
    "system": ("system", "instructions"),
    "user": ("user", "human", "q", "question", "customer"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent"),
}
FIRST, MARKED, LATER = range(3)
SEPARATOR = 3 * len(ROLES)  # state of a blank line between turns
STATES = SEPARATOR + 1
BLOCK, FAN = 512, 128
NEVER = -1e9
_NAME = r"[A-Za-z][A-Za-z0-9_-]{0,23}"
# A marker ends with a colon, bar, angle or closing bracket, or a hyphen between spaces, and takes one space behind it along.
_MARK = re.compile(rf"(?:#+ |> )?(?:\[({_NAME})\]:?|<({_NAME})>:?|\(({_NAME})\):?|\*\*({_NAME}):?\*\*:?|({_NAME}) ?[:|>]|({_NAME}) -(?= )) ?")
_KIND = {w: 1 + r for r, v in enumerate(MARKERS.values()) for w in v}
LENGTHS, ENDS = 8, 4
KINDS = 1 + len(ROLES)
CODES = 1 + KINDS * LENGTHS * ENDS  # 0 is a blank line


def marker(line: str) -> tuple[int, int, str]:
    """(0 or 1 + role of the line's marker, where the text behind it begins, the marker's name)."""
    m = _MARK.match(line)
    if not m:
        return 0, 0, ""
    name = next(g for g in m.groups() if g).lower()
    return _KIND.get(name, KINDS - 1), m.end(), name


def observed(line: str) -> int:
    """The byte of a line."""
    if not line.strip():
        return 0
    kind, at, _ = marker(line)
    rest = line[at:].rstrip()
    end = rest[-1:]
    last = 1 if end == "?" else 2 if end in (".", "!") and end else 3 if end in (",", ":", ";") and end else 0
    return 1 + (kind * LENGTHS + min(len(rest) // 40, LENGTHS - 1)) * ENDS + last


class Model:
    """Log probabilities; moves and emissions rule out a later line without its turn's first line, a marked line without a marker
    of its role, and a parting line that is not blank or does not stand before a turn."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, smooth: float = 0.5) -> "Model":
        """``emit``: (state, code); the features of a line are independent given its state."""
        role, part = np.arange(STATES) // 3, np.arange(STATES) % 3
        opens = (part != LATER) & (np.arange(STATES) < SEPARATOR)
        same = (role[:, None] == role[None, :]) & (np.arange(STATES) < SEPARATOR)[:, None]
        legal = opens[None, :] | (same & (part == LATER)[None, :] & (np.arange(STATES) < SEPARATOR)[None, :])
        legal[:, SEPARATOR] = True
        with np.errstate(divide="ignore"):
            norm = lambda c: np.log(c / c.sum(axis=-1, keepdims=True))
            m = np.maximum(norm(np.where(legal, move + smooth, 0)), NEVER)
            first = np.maximum(norm(np.where(opens | (np.arange(STATES) == SEPARATOR), start + smooth, 0)), NEVER)
            blank = emit[:, :1] + smooth
            seen = emit[:, 1:].reshape(STATES, KINDS, LENGTHS, ENDS)
            any_line = seen.sum(axis=(1, 2, 3))[:, None] + smooth
            p_blank, p_line = np.log(blank / (blank + any_line)), np.log(any_line / (blank + any_line))
            parts = norm(seen.sum(axis=(2, 3)) + smooth)[:, :, None, None] + norm(seen.sum(axis=(1, 3)) + smooth)[:, None, :, None] \
                + norm(seen.sum(axis=(1, 2)) + smooth)[:, None, None, :]
        table = np.concatenate([p_blank, p_line + parts.reshape(STATES, -1)], axis=1)
        kind = np.concatenate([[-1], np.repeat(np.arange(KINDS), LENGTHS * ENDS)])
        for s in range(SEPARATOR):
            if s % 3 == MARKED:
                table[s, kind != 1 + s // 3] = NEVER
        table[SEPARATOR, 1:] = NEVER
        return cls(first, m, table)

    def matrix(self, codes: np.ndarray, first: bool) -> np.ndarray:
        """best[s, t]: from state s before the lines to state t of the last one (a first block ignores s)."""
        rows = self.emit[:, codes].T
        m = (np.tile(self.start, (STATES, 1)) if first else self.move) + rows[0]
        for row in rows[1:]:
            m = (m[:, :, None] + self.move[None]).max(axis=1) + row
        return m

    def paths(self, codes: list[np.ndarray], before: list[int], last: list[int]) -> list[np.ndarray]:
        """The best states of each run of lines given the state before it (-1: it begins a transcript) and that of its last
        line (-1: the best).  Runs of about equal length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(codes)
        order = sorted((i for i in range(len(codes)) if len(codes[i])), key=lambda i: len(codes[i]))
        for k in range(0, len(order), 128):
            some = order[k:k + 128]
            n = np.array([len(codes[i]) for i in some])
            grid = np.zeros((len(some), n[-1]), dtype=np.int64)
            for row, i in zip(grid, some):
                row[:len(codes[i])] = codes[i]
            best = np.stack([self.start if before[i] < 0 else self.move[before[i]] for i in some]) + self.emit[:, grid[:, 0]].T
            back = np.zeros((n[-1], len(some), STATES), dtype=np.uint8)
            for t in range(1, n[-1]):
                steps = best[:, :, None] + self.move[None]
                back[t] = steps.argmax(axis=1)
                best = np.where((t < n)[:, None], steps.max(axis=1) + self.emit[:, grid[:, t]].T, best)
            state = np.array([best[j].argmax() if last[i] < 0 else last[i] for j, i in enumerate(some)])
            path = np.zeros_like(grid)
            for t in range(n[-1] - 1, -1, -1):
                live = t < n
                path[live, t] = state[live]
                state = np.where(live, back[t][np.arange(len(some)), state], state)
            for j, i in enumerate(some):
                out[i] = path[j, :n[j]].astype(np.uint8)
        return out


def pieces(transcripts: DataFrame, id_col: str = "conv_id", order_col: str = "ord", text_col: str = "text", truth_col: str | None = None) -> DataFrame:
    """Pinned (pid, conv, ord, z, codes, truth): the pieces with their lines' bytes and their text, deflated (``z``).

    This is the only pass over the texts before they are rendered.  A NULL text is a piece without lines; ``truth_col``: the
    states of its lines where they are known.
    """
    def run(batches):
        for b in batches:
            text = b.column(2).to_pylist()
            codes = [b"" if t is None else bytes(map(observed, t.split("\n"))) for t in text]
            z = [None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in text]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary()), pa.array(codes, pa.binary()), b.column(3)],
                                             names=["conv", "ord", "z", "codes", "truth"])

    truth = F.col(truth_col) if truth_col else F.lit(None).cast("binary")
    src = transcripts.select(F.col(id_col).cast("string").alias("conv"), F.col(order_col).cast("long").alias("ord"),
                             F.col(text_col).cast("string").alias("text"), truth.alias("truth"))
    rows = src.mapInArrow(run, "conv string, ord long, z binary, codes binary, truth binary")
    return pin(rows.withColumn("pid", F.monotonically_increasing_id()), "pieces")


def blocks(placed: DataFrame) -> DataFrame:
    """Pinned (conv, block, n_blocks, parts): the bytes of up to ``BLOCK`` lines of a transcript, as parts (i, pid, codes, truth) of pieces.

    Pieces of a transcript ascend by order, those of equal order by their bytes; a NULL id is a transcript of its own.
    """
    narrow = placed.select("conv", "ord", "pid", "codes", "truth").filter(F.length("codes") > 0)
    rows = numbered(narrow, [F.asc("conv"), F.asc("ord"), F.asc("codes"), F.asc("pid")], "lines", weight=F.length("codes"))
    ends = pin(rows.groupBy("conv").agg(F.min("_before").alias("n0"), F.max(F.col("_before") + F.length("codes")).alias("n1"))
               .withColumnRenamed("conv", "_c"), "transcripts")
    rows = rows.join(ends, F.col("conv").eqNullSafe(F.col("_c"))).withColumn("i0", F.col("_before") - F.col("n0"))
    last = F.floor((F.col("i0") + F.length("codes") - 1) / BLOCK)
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("i0") / BLOCK), last)))
    # a piece's part in a block: from the block's or the piece's first line on
    start = F.greatest(F.col("block") * BLOCK - F.col("i0"), F.lit(0)).cast("int")
    size = (F.least(F.col("i0") + F.length("codes"), (F.col("block") + 1) * BLOCK) - F.col("i0")).cast("int") - start
    part = F.struct((F.col("i0") + start).alias("i"), "pid", F.substr("codes", start + 1, size).alias("codes"),
                    F.substr("truth", start + 1, size).alias("truth"))
    blocks_of = (F.floor((F.col("n1") - F.col("n0") - 1) / BLOCK) + 1).alias("n_blocks")
    return pin(cut.select("conv", "block", blocks_of, part.alias("part")).groupBy("conv", "block", "n_blocks")
               .agg(F.array_sort(F.collect_list("part")).alias("parts")), "blocks")  # at most BLOCK parts


def fit(blocked: DataFrame) -> Model:
    """Counts over all blocks whose lines' states are known; a block's first line counts as a start only in a first block."""
    def counted(batches):
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CODES))
        for b in batches:
            for block, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if any(p["truth"] is None for p in parts):
                    continue
                s = np.frombuffer(b"".join(p["truth"] for p in parts), np.uint8)
                np.add.at(emit, (s, np.frombuffer(b"".join(p["codes"] for p in parts), np.uint8)), 1)
                np.add.at(move, (s[:-1], s[1:]), 1)
                if block == 0:
                    start[s[0]] += 1
        flat = np.concatenate([start, move.ravel(), emit.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    sums = blocked.select("block", "parts").mapInArrow(counted, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES + STATES * STATES + STATES * CODES)  # at most as many rows
    for r in sums:
        flat[r["at"]] = r["n"]
    start, move, emit = np.split(flat, [STATES, STATES + STATES * STATES])
    return Model.from_counts(start, move.reshape(STATES, STATES), emit.reshape(STATES, CODES))


def _codes(parts: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(p["codes"] for p in parts), np.uint8)


def _boundaries(long: DataFrame, model: Model) -> DataFrame:
    """(conv, node, before, last): the states around each block of the transcripts with several blocks."""
    cols, edge = "conv string, node long, n_nodes long, best array<double>", "conv string, node long, before long, last long"

    def reduced(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "conv": pa.array([r["conv"] for r in rows], pa.string()), "node": pa.array([r["block"] for r in rows], pa.int64()),
                "n_nodes": pa.array([r["n_blocks"] for r in rows], pa.int64()),
                "best": pa.array([model.matrix(_codes(r["parts"]), r["block"] == 0).ravel().tolist() for r in rows], pa.list_(pa.float64()))})

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("node")
        m = _matrix(p["best"].iloc[0])
        for x in p["best"].iloc[1:]:
            m = (m[:, :, None] + _matrix(x)[None]).max(axis=1)
        return pd.DataFrame({"conv": [p["conv"].iloc[0]], "node": [p["node"].iloc[0] // FAN],
                             "n_nodes": [-(-p["n_nodes"].iloc[0] // FAN)], "best": [m.ravel()]})

    def top(pdf: pd.DataFrame) -> pd.DataFrame:  # one node a transcript: the best last state
        return pd.DataFrame({"conv": pdf["conv"], "node": pdf["node"], "before": -1, "last": [int(_matrix(x)[0].argmax()) for x in pdf["best"]]})

    def hand_down(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("node")
        ms = [_matrix(x) for x in p["best"]]
        best, back = ms[0][max(int(p["p_before"].iloc[0]), 0)], []
        for m in ms[1:]:
            steps = best[:, None] + m
            back.append(steps.argmax(axis=0))
            best = steps.max(axis=0)
        ends = [int(p["p_last"].iloc[0])]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pd.DataFrame({"conv": p["conv"].tolist(), "node": p["node"].tolist(), "before": [int(p["p_before"].iloc[0]), *ends[:-1]], "last": ends})

    levels = [pin(long.mapInArrow(reduced, cols), "matrices")]
    while levels[-1].filter("n_nodes > 1").limit(1).count():
        parent = F.expr(f"node div {FAN}").alias("parent")
        levels.append(pin(levels[-1].groupBy("conv", parent).applyInPandas(fold, cols), "fold"))
    known = pin(levels[-1].mapInPandas(lambda it: (top(p) for p in it), edge), "edges")
    for level in reversed(levels[:-1]):
        up = known.select(F.col("conv").alias("_c"), F.col("node").alias("parent"), F.col("before").alias("p_before"), F.col("last").alias("p_last"))
        rows = level.withColumn("_p", F.expr(f"node div {FAN}"))
        rows = rows.join(up, rows["conv"].eqNullSafe(up["_c"]) & (rows["_p"] == up["parent"])).drop("_c", "_p")
        known = pin(rows.groupBy("conv", "parent").applyInPandas(hand_down, edge), "edges")
    return known


def _matrix(flat) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(STATES, STATES)


def decode(blocked: DataFrame, model: Model) -> DataFrame:
    """(pid, i, states, opens, closes): the Viterbi path of each transcript, by parts of its pieces.

    ``i`` is the transcript's line that a part begins with; ``opens`` and ``closes`` say that it holds its first or last line.
    """
    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            found = model.paths([_codes(r["parts"]) for r in rows], [-1 if r["before"] is None else r["before"] for r in rows],
                                [-1 if r["last"] is None else r["last"] for r in rows])
            out = []
            for r, states in zip(rows, found):
                at = 0
                for k, p in enumerate(r["parts"]):
                    n = len(p["codes"])
                    out.append((p["pid"], p["i"], states[at:at + n].tobytes(), p["i"] == 0, r["block"] == r["n_blocks"] - 1 and k == len(r["parts"]) - 1))
                    at += n
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["pid", "i", "states", "opens", "closes"])

    short = blocked.filter("n_blocks = 1").withColumns({"before": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})
    long = blocked.filter("n_blocks > 1")
    if long.limit(1).count():
        edges = _boundaries(long, model).select(F.col("conv").alias("_c"), F.col("node").alias("_b"), "before", "last")
        long = long.join(edges, long["conv"].eqNullSafe(edges["_c"]) & (long["block"] == edges["_b"])).drop("_c", "_b")
        short = short.unionByName(long)
    return short.select("block", "n_blocks", "parts", "before", "last").mapInArrow(run, "pid long, i long, states binary, opens boolean, closes boolean")


def rendered(text: str, states: bytes, opens: bool, closes: bool) -> str:
    """The lines of a piece in canonical form: ``<|role|>``, the turn's lines, ``<|end|>``.

    A marked line loses its marker, a parting line goes, any other is kept byte for byte; lines that look like one of these heads
    get a backslash in front (:func:`turns` takes it off).
    """
    out, spoken = [], not opens
    for line, s in zip(text.split("\n"), states):
        if s == SEPARATOR:
            continue
        role, part = divmod(s, 3)
        if part != LATER:
            _, at, name = marker(line)
            out.append(("<|end|>\n" if spoken else "") + f"<|{name if part == MARKED and role == len(ROLES) - 1 else ROLES[role]}|>\n")
            spoken = True
            line = line[at:] if part == MARKED else line
        out.append(("\\" if line.lstrip("\\").startswith("<|") else "") + line + "\n")
    return "".join(out) + ("<|end|>\n" if closes and spoken else "")


def turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered transcript."""
    out: list[tuple[str, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        if line.startswith("<|") and not inside:
            out.append((line[2:-2], []))
            inside = True
        elif line == "<|end|>":
            inside = False
        elif inside:
            out[-1][1].append(line[1:] if line.startswith("\\") and line.lstrip("\\").startswith("<|") else line)
    return [(r, "\n".join(x)) for r, x in out]


def format_chats(placed: DataFrame, blocked: DataFrame, model: Model) -> DataFrame:
    """(conv, ord, n_lines, n_turns, states, rendered) of each piece; a transcript is its pieces' ``rendered`` joined in order.

    ``n_turns``: turns that begin in the piece.  A NULL text has no lines and renders as nothing; a blank text is one blank line.  Texts of any
    length are rendered whole, by their piece; repeated rows are pieces of their own; an empty table has no rows.
    """
    path = decode(blocked, model).groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("i", "states"))).alias("s"), F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"))

    def run(batches):
        for b in batches:
            text = [None if z is None else zlib.decompress(z).decode("utf-8", "surrogatepass") for z in b.column(2).to_pylist()]
            states = [b"".join(x["states"] for x in s or []) for s in b.column(3).to_pylist()]
            out = ["" if t is None else rendered(t, s, o, c) for t, s, o, c in zip(text, states, b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in states], pa.int64()),
                 pa.array([sum(x % 3 != LATER and x != SEPARATOR for x in s) for s in states], pa.int64()),
                 pa.array([list(s) for s in states], pa.list_(pa.int32())), pa.array(out, pa.string())],
                names=["conv", "ord", "n_lines", "n_turns", "states", "rendered"])

    rows = placed.select("pid", "conv", "ord", "z").join(path, "pid", "left")
    return rows.select("conv", "ord", "z", "s", "opens", "closes").mapInArrow(
        run, "conv string, ord long, n_lines long, n_turns long, states array<int>, rendered string")
