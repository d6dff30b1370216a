"""Simple-8b coding of unsigned integers into 64-bit words, vectorised over blocks.

A word has a 4-bit selector in its low bits and 60 data bits: selector ``s >= 1``
holds ``COUNTS[s]`` values of ``WIDTHS[s]`` bits, low bits first.  Selector 0 is an escape:
the next word holds one value of 60 to 64 bits as it is.  Values are cut into
blocks of ``BLOCK``; words never cross blocks, and the word offset of each block
lets a reader decode any range of blocks on its own.
"""

from __future__ import annotations

import numpy as np

# Counts and widths of the selectors (fixed values of the format).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    if len(v) and int(v.max()) < 1 << 53:  # exact as doubles
        return np.maximum(np.frexp(v.astype(np.float64))[1], 1).astype(np.uint8)
    n = np.ones(len(v), dtype=np.uint8)
    v = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = v >= (np.uint64(1) << np.uint64(step))
        n[big] += np.uint8(step)
        v[big] >>= np.uint64(step)
    return n


def _widest_prefixes(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position the selector whose word takes the most values from there within the block."""
    n = len(bits)
    best = np.zeros(n, dtype=np.uint8)
    top = bits.copy()  # max over the next `span` values
    span = 1
    for s in range(len(COUNTS) - 1, 0, -1):
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        while span < c:
            step = min(span, c - span)
            if step < n:
                grown = top.copy()
                grown[:n - step] = np.maximum(top[:n - step], top[step:])
                top = grown
            span += step
        ok = (top <= w) & (left >= c)
        best[ok] = s
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of ``values`` (any unsigned integers)."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    left = np.repeat(ends, ends - starts) - np.arange(n)
    sel = _widest_prefixes(bit_lengths(v), left)
    step = COUNTS[sel]
    # all blocks walk their chain of words in step
    at, live, starts_word = starts.copy(), np.arange(len(starts)), np.zeros(n, dtype=bool)
    while len(live):
        here = at[live]
        starts_word[here] = True
        at[live] = here + step[here]
        live = live[at[live] < ends[live]]
    pos = np.flatnonzero(starts_word)
    chosen = sel[pos]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in np.unique(chosen):
        m = chosen == s
        p, q = pos[m], place[m]
        if s == 0:
            words[q + 1] = v[p]
            continue
        w = np.full(len(p), s, dtype=np.uint64)
        for j in range(int(COUNTS[s])):
            w |= v[p + j] << np.uint64(4 + j * int(WIDTHS[s]))
        words[q] = w
    first = np.searchsorted(pos, starts)
    return words, place[first]


def decode(words: np.ndarray) -> np.ndarray:
    """The values of ``words`` (one or several whole blocks)."""
    w = np.ascontiguousarray(words, dtype=np.uint64)
    sel = (w & np.uint64(15)).astype(np.int64)
    raw = _after_escape(sel)
    count = np.where(raw, 0, COUNTS[np.where(raw, 0, sel)])
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for s in np.unique(sel[~raw]):
        m = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[place[m]] = w[m + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[place[m] + j] = (w[m] >> np.uint64(4 + j * int(WIDTHS[s]))) & mask
    return out


def _after_escape(sel: np.ndarray) -> np.ndarray:
    """True where a word is the raw value behind an escape (its low bits are no selector)."""
    raw = np.zeros(len(sel), dtype=bool)
    zero = np.flatnonzero(sel == 0)
    at = -1
    for i in zero:  # escapes are rare: values of 60 bits or more
        if i != at:
            at = i + 1
            raw[at] = True
    return raw
