"""Word shingles of many texts at once, as sorted arrays of 64-bit fingerprints."""

from __future__ import annotations

import numpy as np

N = 5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_random = np.random.default_rng(11)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = _random.integers(0, 1 << 63, N + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, one text behind the other, and the number of words of each text.  A-Z count as a-z."""
    folded = [t.encode().translate(_FOLD) if t else b"" for t in texts]
    raw = np.frombuffer(b" ".join(folded) + b" ", dtype=np.uint8)
    inside = raw != 0x20
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = end - start
    before = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(before, size)
    weight = _PLACES[place & 4095] + (place >> 12).astype(np.uint64) * _WORDS[N]
    hashes = mix(np.add.reduceat(_BYTES[raw[inside]] * weight, before))
    lengths = np.array([len(f) + 1 for f in folded], dtype=np.int64)
    owner = np.searchsorted(np.cumsum(lengths), start, "right")
    return hashes, np.bincount(owner, minlength=len(texts))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; a text of fewer words has its whole sequence as one, a text without words none."""
    hashes, counts = word_hashes(texts)
    runs = np.zeros(max(0, len(hashes) - N + 1), dtype=np.uint64)
    for j in range(N):
        runs += hashes[j:j + len(runs)] * _WORDS[j]
    runs = mix(runs)
    out, end = [], 0
    for n in counts.tolist():
        begin, end = end, end + n
        if n >= N:
            out.append(np.unique(runs[begin:end - N + 1]))
        elif n:
            out.append(mix((hashes[begin:end] * _WORDS[:n] + _WORDS[N + 1]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
