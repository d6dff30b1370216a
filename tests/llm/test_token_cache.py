"""Ids of whole texts are those of the library, and a worker keeps word pieces only."""

import random

import numpy as np
import public_tokenizers
import pytest

from qplate.llm.tokenization import ChunkEncoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "  ", "a", " a", "a ", " a ", "a  b", "\n", "a\n", "\na", "a\nb c\n\nd", "a \nb", "a\n b", "a\t b", "it's we'll 's 't I'M", "don't\ncan't",
       "x1y22z333 4,5..6", "\0", "a\0b c", "a\x1c b", "a b\x1c", "é È ü×÷ ÿß ÀÖ", "a  b", "a b c", "ça é ﬁ", "a\u00a0b", "a \u00a0b", "a\u3000 b", "a\u2003b \u2003c", "a\x85 b", "\u2028 x", "日本 語 x", "İi ſ K", "🙂 a🙂b",
       "<|endoftext|>", "a <|endoftext|> b", "<|startoftext|>x y", " a b", "a b ", "z" * 200 + " " + "z" * 200, "q" * 70 + " b " + "7" * 90]


def _library(enc, texts):
    return [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("entries", [5, 100_000])
def test_ids_are_those_of_the_library(file, entries):
    enc, rng = ChunkEncoder(public_tokenizers.path(file), cache_entries=entries), random.Random(7)
    bits = [*ODD, "The", "quick", "Brown,", "(fox)", "a-b", "x_y", "é", "1234", "'re", "\n\n", "\t", "end.\nNext", "\r"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    for texts in (ODD, made, made[::-1], ODD + made[:50], [], [""]):
        assert enc.encode(texts) == _library(enc, texts)


@pytest.mark.parametrize("file", FILES)
def test_new_chunks_of_known_pieces_leave_nothing_behind(file):
    """Chunks are nearly as many as texts; only their pieces are kept, each of which is merged once."""
    enc = ChunkEncoder(public_tokenizers.path(file))
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    texts = [" ".join(f"{a}-{b}.{c}/{d}{e}" for e in "+!") for a in words for b in words for c in words for d in words]
    whole = enc.encode(texts)
    held = sum(len(v) for v in vars(enc).values() if isinstance(v, dict) and all(isinstance(k, str) for k in v))
    assert held < 100 and whole[:50] == _library(enc, texts[:50])
    before = len(enc.ids)
    assert enc.encode(texts) == whole and len(enc.ids) == before


def test_long_pieces_are_not_kept():
    enc = ChunkEncoder(public_tokenizers.path(FILES[0]), longest=8)
    texts = ["abcdefghijkl ab", "ab abcdefghijkl abcdefghijkl"]
    for _ in range(2):
        assert enc.encode(texts) == _library(enc, texts)
        assert all(len(p) <= 8 for p in enc.pieces) and len(enc.counts) == len(enc.starts) == len(enc.pieces)


@pytest.mark.parametrize("file", FILES)
def test_a_full_cache_keeps_the_pieces_met_first(file):
    """A small cache does not cost the frequent pieces, and its size stays bounded while texts go on bringing new ones."""
    enc = ChunkEncoder(public_tokenizers.path(file), cache_entries=60)
    common = "the quick brown fox"
    enc.encode([f"{common} {common}"])
    kept = set(enc.pieces)
    for i in range(40):
        texts = ["".join(chr(97 + (i * 7 + j * k) % 26) for k in range(9)) + f" {common}" * (j % 2) for j in range(1, 30)]
        assert enc.encode(texts) == _library(enc, texts)
        assert kept <= set(enc.pieces) and len(enc.pieces) <= 60 + 2 * 29
        assert len(enc.counts) == len(enc.starts) == len(enc.pieces) and len(enc.ids) == enc.counts.sum()
        assert list(enc.pieces.values()) == list(range(len(enc.pieces)))
    texts = ["".join(chr(97 + (i * j) % 26) for i in range(11)) for j in range(1, 50)]
    enc.encode(texts)
    enc.encode(texts[:1])  # none of the common pieces is in these runs
    assert kept <= set(enc.pieces)


def test_packing_holds_a_small_cache(monkeypatch):
    """Two workers stand beside an executor's heap: a packing worker keeps far fewer pieces than it meets, and encodes short runs."""
    import pyarrow as pa

    from qplate.llm import packing

    class Rows:  # hands packing's function of batches to the test
        def select(self, *cols):
            return self

        def mapInArrow(self, cut, schema):
            self.cut = cut
            raise InterruptedError

    runs = []

    class Watched(ChunkEncoder):
        def encode(self, texts):
            out = super().encode(texts)
            runs.append((sum(map(len, texts)), len(self.pieces)))
            return out

    made = {}
    monkeypatch.setattr(packing, "encoder", lambda path, *a: made.setdefault(path, Watched(path, *a)))
    monkeypatch.setattr(packing, "F", type("F", (), {n: staticmethod(lambda *a: Rows()) for n in ("col", "xxhash64")}))
    Rows.cast = Rows.alias = lambda self, *a: self
    docs = Rows()
    with pytest.raises(InterruptedError):
        packing.pack(docs, public_tokenizers.path(FILES[1]), end_id=1)

    def word(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(5))

    texts = [" ".join(word(i) for i in range(a, a + 1000)) for a in range(0, 600_000, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts), pa.array([0] * 600)], names=["doc_id", "text", "th"])
    rows = sum(b.num_rows for b in docs.cut([batch]))
    assert rows > 600 and max(n for n, _ in runs) < 1_100_000
    assert max(n for _, n in runs) < 500_000


@pytest.mark.parametrize("file", FILES)
def test_chunks_of_letters_are_not_split_again(file, monkeypatch):
    """A chunk of letters alone is one piece as it stands; only the others go through the pattern of pieces."""
    from qplate.llm import tokenization

    enc, seen = ChunkEncoder(public_tokenizers.path(file)), []

    class Watched:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            seen.append(text)
            return self.pattern.findall(text)

    monkeypatch.setattr(tokenization, "_PIECES", {k: Watched(p) for k, p in tokenization._PIECES.items()})
    texts = ["Der der DER Öl öl", "the Quick é brown fox, don't", "a" * 100 + " " + "B" * 100 + " b", "ÿ×ÿ a÷b x1", "ª µ āb", ""]
    for _ in range(2):
        assert enc.encode(texts) == _library(enc, texts)
        assert enc.encode(texts[:1]) == _library(enc, texts[:1])
    split = "".join(seen).lower()
    assert "fox," in split and "don't" in split and "x1" in split
    assert not any(w in split for w in ("der", "öl", "quick", "brown", "aaa", "bbb"))
