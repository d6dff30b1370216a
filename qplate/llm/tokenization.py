"""Token ids of whole texts by a public tokenizer file, with a cache of word pieces in each worker.

Two kinds of tokenizer files split a text at a single space between two
non-space characters before any merge is made (byte-level BPE: the space opens
the next piece; word-end BPE: it is dropped).  For those, the ids of a text are
the ids of its space-separated chunks in order, and the ids of a chunk those of
its pieces.  Both repeat far more often than texts: the chunks of a run of
texts are made distinct by Arrow and split into pieces once (those of letters
alone are one piece as they are), a worker keeps the ids
of the pieces it has met, and the library only encodes new ones.  Texts with other white
space next to a space, and other kinds of tokenizer files, are encoded whole.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pre-tokenizer patterns of the two kinds over the characters of _PLAIN (fixed values: they must split as the files do).
_L, _N = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
_SEEN = rf"{_L}{_N}!-/:-@\[-`{{-~"
_PLAIN = re.compile(rf"[ \n\t{_SEEN}]*")
_TIDY = rf"^[{_SEEN}](?:[ \n\t{_SEEN}]*[{_SEEN}])?$"  # plain, with no white space at its ends (a pattern for Arrow)
_WORD = rf"^[{_L}]+$"  # letters alone: one piece in both kinds
_END = "\0"  # stands behind every chunk when many are split in one call; no chunk of _PLAIN holds it
_PIECES = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \n\t\0{_L}{_N}]+|[ \n\t]+(?![^ \n\t\0])|[ \n\t]+|\0"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ \n\t\0{_L}{_N}]+|\0"),
}
_ID = attrgetter("id")
_STATE: dict[tuple[str, int], "ChunkEncoder"] = {}


class ChunkEncoder:
    """A cache of at most ``cache_entries`` pieces before a run of texts; of a full one the third met first stays, which holds nearly all
    frequent pieces.  Pieces of more than ``longest`` characters are never kept, so that a worker holds about 250 bytes an entry at
    most, whatever the texts are.
    """

    def __init__(self, path: str, cache_entries: int = 900_000, longest: int = 64):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = [t.content for t in added]  # texts that hold such a string are encoded whole
        self.longest = longest
        self.kind = None if any(t.normalized for t in added) else _kind(json.loads(self.tokenizer.to_str()))
        self.cache_entries = cache_entries
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # characters of _PLAIN as the model has them; what is split never holds others
        self.alphabet = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(1, 256)) if _PLAIN.fullmatch(c)})
        self._begin()

    def _begin(self) -> None:
        self.pieces: dict[str, int] = {_END: 0}  # place of a piece in starts and counts
        self.ids, self.starts, self.counts = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """All but the pieces met first; a piece's place is its turn in the cache."""
        n = max(1, self.cache_entries // 3)
        self.pieces = dict(islice(self.pieces.items(), n))
        self.ids = self.ids[:self.starts[n]].copy()
        self.starts, self.counts = self.starts[:n].copy(), self.counts[:n].copy()

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        got = list(map(self.model.tokenize, _END.join(new).translate(self.alphabet).split(_END)))
        counts = np.fromiter(map(len, got), np.int64, len(got))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(map(_ID, chain.from_iterable(got)), "<u4", counts.sum())])
        self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new))))

    def _plain(self, words: list[str], chunks: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings of letters and then of other plain strings, each behind ``space``, end to end, and the place behind each one's."""
        lower = self.kind == "word"  # a word-end file lower-cases first, and its pieces have no space
        met, inside = ([w.lower() for w in words] if lower else [space + w for w in words] if space else words), None
        if chunks:
            joined = space + (_END + space).join(chunks) + _END
            coded = pa.array(_PIECES[self.kind].findall(joined.lower() if lower else joined), pa.large_string()).dictionary_encode()
            met, inside = met + _strings(coded.dictionary), coded.indices.to_numpy()
        at = np.fromiter(map(self.pieces.get, met, repeat(-1)), np.int64, len(met))
        unmet = np.flatnonzero(at < 0)
        new = [met[i] for i in unmet.tolist()]
        fresh = list(dict.fromkeys(new))
        long = [p for p in fresh if len(p) > self.longest]
        self._learn([p for p in fresh if len(p) <= self.longest] if long else fresh)
        n, n_ids = len(self.pieces), len(self.ids)
        self._learn(long)
        at[unmet] = np.fromiter(map(self.pieces.__getitem__, new), np.int64, len(new))
        if inside is not None:
            at = np.concatenate([at[:len(words)], at[len(words):][inside]])
        counts = self.counts[at]
        ids = _gather(self.ids, self.starts[at], counts)
        if long:
            for p in long:
                del self.pieces[p]
            self.ids, self.starts, self.counts = self.ids[:n_ids], self.starts[:n], self.counts[:n]
        ends = at == 0
        ends[:len(words)] = True
        return ids, np.cumsum(counts)[ends]

    def _chunks(self, chunks: list[str], word: np.ndarray, other: list[int], space: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of strings without a space, each behind ``space``; first place and number of each one's ids.
        The strings where ``word`` holds are letters alone, those at ``other`` are not plain.
        """
        fit = ~word
        fit[other] = False
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(fit)])
        plain = [chunks[i] for i in order.tolist()]
        n = int(word.sum())
        ids, ends = self._plain(plain[:n], plain[n:], space)
        starts, counts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        counts[order] = np.diff(ends, prepend=0)
        starts[order] = ends - counts[order]
        if other:
            got = [e.ids for e in self.tokenizer.encode_batch([space + chunks[i] for i in other], add_special_tokens=False)]
            counts[other] = [len(g) for g in got]
            starts[other] = len(ids) + np.cumsum(counts[other]) - counts[other]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(got), "<u4")])
        return ids, starts, counts

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.kind is None:
            return self._whole(texts)
        if len(self.pieces) > self.cache_entries:
            self._forget()
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if "  " in t or " \n" in t or "\n " in t or any(a in t for a in self.added)]
        apart = set(whole)
        at = [i for i, t in enumerate(texts) if t and i not in apart]
        if at:
            parts = pc.split_pattern(pa.array([texts[i] for i in at], pa.large_string()), " ")
            first = parts.offsets.to_numpy().astype(np.int64)
            coded = parts.values.dictionary_encode()
            chunks, code = _strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            word = pc.match_substring_regex(coded.dictionary, _WORD).to_numpy(zero_copy_only=False)
            mixed = np.flatnonzero(~word)
            tidy = pc.match_substring_regex(coded.dictionary.take(pa.array(mixed)), _TIDY).to_numpy(zero_copy_only=False)
            rest = mixed[~tidy].tolist()
            # white space beside a space: a chunk that starts or ends with it, away from that end of the text
            blank = np.zeros(len(chunks), bool)
            blank[rest] = [c[:1].isspace() or c[-1:].isspace() for c in map(chunks.__getitem__, rest)]
            beside = np.zeros(len(at), bool)
            for k in np.flatnonzero(blank[code]).tolist():
                i, c = int(np.searchsorted(first, k, "right")) - 1, chunks[code[k]]
                beside[i] |= k > first[i] and c[0].isspace() or k < first[i + 1] - 1 and c[-1].isspace()
            other = [i for i in rest if not _PLAIN.fullmatch(chunks[i])]
            ids, starts, counts = self._chunks(chunks, word, other, " ")
            opening = code[first[:-1]]  # a text's first chunk has no space before it
            heads, place = np.unique(opening, return_inverse=True)
            code[first[:-1]] = len(chunks) + place
            opening = [chunks[c] for c in heads.tolist()]
            head_ids, head_starts, head_counts = self._chunks(opening, word[heads], [i for i, c in enumerate(opening) if not _PLAIN.fullmatch(c)], "")
            head_starts += len(ids)
            ids, starts, counts = (np.concatenate(p) for p in ((ids, head_ids), (starts, head_starts), (counts, head_counts)))
            counts = counts[code]
            data = memoryview(_gather(ids, starts[code], counts).tobytes())
            ends = (4 * np.concatenate([[0], np.cumsum(counts)])[first]).tolist()
            for i, b, e, left in zip(at, ends, ends[1:], beside.tolist()):
                if left:
                    whole.append(i)
                else:
                    out[i] = bytes(data[b:e])
        for i in whole:
            out[i] = self._whole([texts[i]])[0]
        return out


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``starts``, end to end."""
    ends = np.cumsum(counts)
    return ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def _kind(spec: dict) -> str | None:
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
            and spec.get("normalizer") is None:
        return "byte"
    steps = pre.get("pretokenizers", [])
    if [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") \
            and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space", True) \
            and steps[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        return "word"
    return None


def encoder(path: str, cache_entries: int = 900_000) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file and size of cache (kept between tasks)."""
    key = path, cache_entries
    if key not in _STATE:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _STATE[key] = ChunkEncoder(path, cache_entries)
    return _STATE[key]


def in_slices(texts, limit: int = 1 << 22):
    """(first index, texts) runs of about ``limit`` characters, so that a batch of long texts stays small."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size >= limit:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run
