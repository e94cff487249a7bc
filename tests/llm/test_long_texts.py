"""Texts of any length, and packing that no size switches off."""

import tracemalloc
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm import samples
from tidemark.llm import bpe, packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_tiles_give_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(bpe, "TILE", 64)
    rng = samples.random.Random(2)
    alphabet = ["word", " it's", " a", ".", ", ", "  ", "\n", "é", "日本", "。", "_", "'", "<|endoftext|>", "1", "!?", "\t ", "ß", "я"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)] + [t or "" for t in samples.texts()]
    coder = bpe.SegmentEncoder(BYTE_BPE)
    assert sum(len(list(coder.tiles(t))) for t in texts) > 5 * len(texts)
    ids, numbers = coder.encode(texts)
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert numbers.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_long_text_takes_little_more_than_its_ids():
    text = " ".join(samples.WORDS) + ". "
    text = text * ((20 << 20) // len(text))
    coder = bpe.SegmentEncoder(BYTE_BPE)
    coder.encode([text[:1000]])
    tracemalloc.start()
    ids, numbers = coder.encode([text])
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert numbers[0] == len(ids) > 1 << 21


def test_the_cache_is_bound_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED", 40_000)
    coder = bpe.SegmentEncoder(BYTE_BPE)
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(200))
        assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert 0 < coder.held <= 40_000 and len(coder.known) < 400 and coder.n == len(coder.known)


def test_other_tokenizers_are_not_cut():
    coder = bpe.SegmentEncoder(BYTE_BPE)
    coder.cuttable = False
    texts = ["a b. c", "", "  x"]
    ids, numbers = coder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in coder.tokenizer.encode(t, add_special_tokens=False).ids] and numbers.sum() == len(ids)


@pytest.mark.parametrize("sizes", [[5], [3, 3, 3], [9] * 40, [7, 7, 7, 9], list(range(1, 60)), [16, 32, 1]])
@pytest.mark.parametrize("held", [20, 1 << 22])
def test_every_size_is_packed_by_sum_of_squares(sizes, held, monkeypatch):
    placed = []
    place = packing.SumOfSquares.place
    monkeypatch.setattr(packing.SumOfSquares, "place", lambda self, n: placed.append(n) or place(self, n))
    seen, windows = defaultdict(list), defaultdict(list)
    for key, start, piece, n, sequence, offset in packing.pack_stream(((i, np.arange(n, dtype=np.uint32)) for i, n in enumerate(sizes)), 16, held):
        assert n == sizes[key] and piece.tolist() == list(range(start, start + len(piece)))
        seen[key] += piece.tolist()
        windows[sequence].append((offset, len(piece)))
    assert placed == [n % 16 for n in sizes if n % 16]
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(sizes))
    filled = []
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        filled.append(at)
    assert max(filled) <= 16
    assert len(filled) == -(-sum(sizes) // 16)
