"""Names of byte spans: position-independent 64-bit fingerprints from prefix sums, vectorised."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20  # bytes worked on at once, so that a long text needs no more memory than a short one
_CACHE: dict[int, tuple] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _family(k: int, n: int):
    """Byte table, powers of an odd base and of its inverse, n + 1 of each."""
    have = _CACHE.get(k)
    if have is None or len(have[1]) <= n:
        size = max(n + 1, CHUNK + 4096)
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        base = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[k]
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _CACHE[k] = (table, np.cumprod(up), np.cumprod(down))
    return have


def prefixes(buf: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): the span [s, e) is named by (P[e] - P[s]) * D[s]."""
    table, up, down = _family(family, len(buf))
    p = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(table[buf] * up[:len(buf)], out=p[1:])
    return p, down


def names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """The name of each span; spans are far shorter than CHUNK."""
    out = np.zeros(len(starts), dtype=np.uint64)
    longest = int((ends - starts).max()) if len(starts) else 0
    part = starts // CHUNK
    for c in np.unique(part):
        m = part == c
        base = int(c) * CHUNK
        p, down = prefixes(buf[base:base + CHUNK + longest], family)
        s, e = starts[m] - base, ends[m] - base
        out[m] = mix((p[e] - p[s]) * down[s])
    return out


def anchors(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions: every ``length``-byte string of ``buf`` chooses its gram of least hash.

    The choice depends on the string alone, so equal strings choose at equal places.  Returns (position,
    least and greatest distance from the start of a choosing string, 64-bit name of the gram), one
    row per position.
    """
    n, w = len(buf), length - gram + 1
    pos, lo, hi, name = [], [], [], []
    for base in range(0, max(n - length + 1, 0), CHUNK):
        part = buf[base:base + CHUNK + length - 1]
        p, down = prefixes(part)
        h = mix((p[gram:] - p[:-gram]) * down[:len(part) - gram + 1])
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // w)
        grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:len(key)] = key
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        at = (np.minimum(behind[:windows], ahead[w - 1:w - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        a = at[first]
        a, l, g, x = a + base, a - last, a - first, h[a]
        if pos and pos[-1][-1] == a[0]:  # a position chosen on both sides of a chunk border
            lo[-1][-1] = l[0]
            a, l, g, x = a[1:], l[1:], g[1:], x[1:]
        if len(a):
            pos.append(a), lo.append(l), hi.append(g), name.append(x)
    if not pos:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return np.concatenate(pos), np.concatenate(lo), np.concatenate(hi), np.concatenate(name)
