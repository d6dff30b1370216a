"""Interpolated Kneser-Ney models over characters, one for each language, stored in sorted hash arrays that all languages share."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

ORDER = 5
SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd
PIECE = 1 << 20  # characters worked on at once


@functools.cache
def _fold_table() -> np.ndarray:
    """Code point to that of its lower-case letter, to a space where it is no letter (none lies beyond U+3FFFF)."""
    table = np.full(0x110000, SPACE, dtype=np.uint32)
    for cp in range(0x40000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def folded(text: str, size: int = PIECE) -> Iterator[np.ndarray]:
    """The letters of a text, lower-cased, a space behind each word, in pieces that begin with the ``ORDER`` - 1 codes before
    them (spaces before the first); nothing for a text without letters."""
    before = np.full(ORDER - 1, SPACE, dtype=np.uint32)
    table = _fold_table()
    for i in range(0, len(text), size):
        piece = text[i:i + size] + (" " if i + size >= len(text) else "")
        a = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        letter = a != SPACE
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= before[-1] != SPACE
        a = a[keep]
        if len(a):
            a = np.concatenate([before, a])
            yield a
            before = a[1 - ORDER:]


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` codes (of each row's, for a matrix of rows of ``n``); equal hashes stand for equal runs."""
    h = np.zeros((len(codes) if codes.ndim == 2 else len(codes) - n + 1,), dtype=np.uint64)
    for k in range(n):
        part = codes[:, k] if codes.ndim == 2 else codes[k:len(codes) - n + 1 + k]
        h = (h + part) * _MIX
    h ^= h >> np.uint64(29)
    return h * _MIX


class HashArray:
    """Sorted hashes with an index on their upper bits, so that a search is a few steps from its first entry."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.bits = max(4, min(22, int(len(keys)).bit_length() + 1))
        self.first = np.searchsorted(keys, np.arange((1 << self.bits), dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.steps = int(np.diff(np.append(self.first, len(keys))).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is absent."""
        at, keys = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64), self.keys
        for _ in range(self.steps):
            more = keys[at] < h
            if not more.any():
                break
            at += more
        at[(keys[at] != h) | (at == len(keys) - 1)] = -1
        return at


def _discount(n: np.ndarray) -> float:
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _language(grams: np.ndarray, n: np.ndarray, letters: int) -> tuple[list, list]:
    """Of one language, for each order from 1: (hashes, log2 probability of the last code) and (context hashes, log2 of
    the weight of the next lower order).  ``grams``: rows of ``ORDER`` codes, occurring ``n`` times."""
    levels = [(grams, n)]
    while len(levels) < ORDER:  # below the highest order a gram counts by the different codes before it
        rows = levels[0][0][:, 1:]
        _, at, times = np.unique(hashes(rows, rows.shape[1]), return_index=True, return_counts=True)
        levels.insert(0, (rows[at], times))
    probabilities, weights, lower = [], [], None
    for k, (rows, n) in enumerate(levels, 1):
        d = _discount(n)
        contexts, which = np.unique(hashes(rows[:, :-1], k - 1), return_inverse=True)
        total, types = np.bincount(which, weights=n), np.bincount(which)
        weight = d * types / total
        if lower is None:
            below = np.full(len(rows), 1 / letters)
        else:
            below = lower[1][np.searchsorted(lower[0], hashes(rows[:, 1:], k - 1))]
        p = np.maximum(n - d, 0) / total[which] + weight[which] * below
        h = hashes(rows, k)
        order = np.argsort(h)
        lower = (h[order], p[order])
        probabilities.append((h[order], np.log2(p[order]), rows[order]))
        weights.append((contexts, np.log2(weight)))
    return probabilities, weights


class Model:
    """``languages``, and for each order the grams and contexts of all of them with a column of values for each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: language -> (rows of ``ORDER`` codes, occurrences)."""
        self.languages = sorted(counts)
        letters = len(np.unique(np.concatenate([rows[:, -1] for rows, _ in counts.values()]))) + 1  # and one for any other
        fitted = [_language(*counts[g], letters) for g in self.languages]
        self.unknown = -np.log2(letters)
        self.grams: list[HashArray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[HashArray] = []
        self.weights: list[np.ndarray] = []
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([f[1][k - 1][0] for f in fitted]))
            weights = np.zeros((len(keys), len(fitted)))  # an unseen context leaves all to the lower order
            for g, f in enumerate(fitted):
                weights[np.searchsorted(keys, f[1][k - 1][0]), g] = f[1][k - 1][1]
            self.contexts.append(HashArray(keys))
            self.weights.append(weights)
            keys, at = np.unique(np.concatenate([f[0][k - 1][0] for f in fitted]), return_index=True)
            rows = np.concatenate([f[0][k - 1][2] for f in fitted])[at]
            logs = weights[self.contexts[-1].find(hashes(rows[:, :-1], k - 1))]
            logs = logs + (self.unknown if k == 1 else self.logs[-1][self.grams[-1].find(hashes(rows[:, 1:], k - 1))])
            for g, f in enumerate(fitted):
                logs[np.searchsorted(keys, f[0][k - 1][0]), g] = f[0][k - 1][1]
            self.grams.append(HashArray(keys))
            self.logs.append(logs)

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """Of each code behind the first ``ORDER`` - 1: log2 probability in each language."""
        n = len(codes) - ORDER + 1
        out = np.zeros((n, len(self.languages)))
        todo = np.arange(n)
        for k in range(ORDER, 0, -1):
            h = hashes(codes, ORDER) if k == ORDER else hashes(codes[(todo + ORDER - k)[:, None] + np.arange(k)], k)
            at = self.grams[k - 1].find(h)
            hit = at >= 0
            if k == ORDER:
                out[hit] = self.logs[k - 1][at[hit]]
            else:
                out[todo[hit]] += self.logs[k - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            context = self.contexts[k - 1].find(hashes(codes[(todo + ORDER - k)[:, None] + np.arange(k - 1)], k - 1))
            out[todo[context >= 0]] += self.weights[k - 1][context[context >= 0]]
        out[todo] += self.unknown
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of each text, bits a code in each language; NaN for a text without letters)."""
        size, total = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), len(self.languages)))
        run: list[tuple[int, np.ndarray]] = []

        def score():
            codes = np.concatenate([a for _, a in run])
            logs = self.log2(codes)
            ends = np.cumsum([len(a) for _, a in run])
            starts = ends - [len(a) for _, a in run]
            # windows that run from one text into the next stand between an end and the next start
            edges = np.column_stack([starts, ends - ORDER + 1]).ravel()
            sums = np.add.reduceat(np.concatenate([logs, np.zeros((ORDER, logs.shape[1]))]), edges, axis=0)[::2]
            who = [i for i, _ in run]
            np.add.at(total, who, sums)
            np.add.at(size, who, ends - starts - ORDER + 1)

        held = 0
        for i, text in enumerate(texts):
            for piece in folded(text):
                run.append((i, piece))
                held += len(piece)
                if held > PIECE // 4:
                    score()
                    run, held = [], 0
        if run:
            score()
        with np.errstate(invalid="ignore"):
            return size, -total / size[:, None]
