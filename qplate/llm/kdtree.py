"""K-d trees over letter-count vectors, searched for all vectors within one gained and one lost letter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIMENSIONS = 26 + 64  # a-z, U+00C0 to U+00FF
_DIMENSION = np.zeros(256, dtype=np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[0xC0:0x100] = 26 + np.arange(64)


def code_matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Occurrences of each letter, at most 255 (a count cut there still moves by at most one an edit)."""
    out = np.empty((len(codes), DIMENSIONS), dtype=np.uint8)
    step = max(1, (1 << 20) // max(codes.shape[1], 1))
    for i in range(0, len(codes), step):
        part = _DIMENSION[codes[i:i + step]]
        at = part + (np.arange(len(part)) * DIMENSIONS)[:, None]
        n = np.bincount(at.ravel(), minlength=len(part) * DIMENSIONS)
        out[i:i + step] = np.minimum(n, 255).reshape(len(part), DIMENSIONS)
    return out


class KdTree:
    """Splits by the median of the axis of greatest variance until a node holds ``leaf_size`` vectors or none can be split.

    ``axis`` is -1 for leaves, which are numbered from 0; the low child holds the vectors with ``vector[axis] <= cut``.
    """

    def __init__(self, vectors: np.ndarray, leaf_size: int):
        self.axis: list[int] = []
        self.cut: list[int] = []
        self.child: list[tuple[int, int]] = []
        self.members: list[np.ndarray] = []
        self._grow(vectors, np.arange(len(vectors)), leaf_size)

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, leaf_size: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0)
        self.child.append((len(self.members), -1))
        part = vectors[rows]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) > leaf_size else np.zeros(1)
        if not spread.any():
            self.members.append(rows)
            return node
        axis = int(np.argmax(part.var(axis=0, dtype=np.float32)))
        column = part[:, axis]
        cut = int(np.median(column))
        if cut >= column.max():
            cut = int(column.max()) - 1
        low = column <= cut
        self.axis[node], self.cut[node] = axis, cut
        self.child[node] = (self._grow(vectors, rows[low], leaf_size), self._grow(vectors, rows[~low], leaf_size))
        return node

    def search(self, vectors: np.ndarray, gain: int, loss: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the query vectors) for each leaf whose box some queries reach by at most ``gain`` letters
        more and ``loss`` letters fewer; the way to a box is counted once an axis."""
        every = np.arange(len(vectors))
        stack = [(0, every, np.zeros(len(vectors), np.int16), np.zeros(len(vectors), np.int16), {})]
        while stack:
            node, who, more, fewer, paid = stack.pop()
            axis = self.axis[node]
            if axis < 0:
                yield self.child[node][0], who
                continue
            x, cut = vectors[who, axis].astype(np.int16), self.cut[node]
            before_more, before_fewer = paid.get(axis, (0, 0))
            need_more, need_fewer = np.maximum(before_more, cut + 1 - x), np.maximum(before_fewer, x - cut)
            for child, side_more, side_fewer in ((self.child[node][0], before_more, need_fewer), (self.child[node][1], need_more, before_fewer)):
                m, f = more + side_more - before_more, fewer + side_fewer - before_fewer
                ok = (m <= gain) & (f <= loss)
                if ok.any():
                    kept = {a: (_at(p, ok), _at(q, ok)) for a, (p, q) in {**paid, axis: (side_more, side_fewer)}.items()}
                    stack.append((child, who[ok], m[ok], f[ok], kept))


def _at(x, ok: np.ndarray):
    return x[ok] if isinstance(x, np.ndarray) else x


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits a vector; a letter more or fewer flips one bit, so the bits that differ bound the L1 distance from below."""
    out = np.zeros(len(counts), dtype=np.uint64)
    for d in range(DIMENSIONS):
        column = counts[:, d]
        for k in range(int(column.max(initial=0))):
            # the k-th occurrence of a letter has a bit of its own for the first ones, shared ones follow
            bit = (d * 2 + k) % 64 if d < 26 else (52 + d + k) % 64
            out ^= np.where(column > k, np.uint64(1) << np.uint64(bit), np.uint64(0))
    return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the words differ by one replaced code point (equal lengths) or by one more in ``long``; rows of code points."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n
