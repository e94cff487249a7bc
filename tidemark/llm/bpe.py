"""Byte-level BPE of whole texts: each distinct stretch between spaces is encoded once by the tokenizers library, then reused.

A single space behind a visible character always begins a new pre-token of the byte-level pattern, so a text may be cut before every
such space; likewise before a mark (but an apostrophe) behind an ASCII letter or digit, and on both sides of a single line feed between visible
characters.  Texts with a space inside a longer run of white space, or with the
string of a special token, are encoded whole.  A text of any length is first cut into tiles at such places, so that the arrays of one tile
are all that is held beside the ids; only a stretch without any is taken as long as it is.  Files of tokenizers with another pattern are used as they are, text by text.  Stretches are found and compared as bytes: equal
hashes only suggest equal stretches, the bytes decide.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: A space in a run of white space where cutting before it could change a pre-token.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: Longer stretches are not cached; their texts are encoded whole.
_LONGEST = 512
#: Bytes of cached stretches, their ids and what Python holds for each.
_CACHED, _ENTRY = 48 << 20, 160
_JOINED = 2_000
#: Bytes of texts, or of a tile of a long one, that are encoded at once.
TILE = 1 << 20
#: Before such a place a new pre-token begins, whatever lies around.
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])|(?<=[A-Za-z0-9À-ÖØ-öø-ÿА-я一-龥])(?=[.,;:!?。，、；：！？])")

#: Bytes by kind: ASCII letters and digits, ASCII marks but the apostrophe, ASCII visible, and what a visible character may start with.
_WORD, _MARK, _SEEN, _LEADS = (np.zeros(256, dtype=bool) for _ in range(4))
_WORD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_SEEN[0x21:0x7F] = True
_MARK[:] = _SEEN & ~_WORD
_MARK[0x27] = False
_LEADS[:] = _SEEN
_LEADS[0xC3] = True

_WEIGHTS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(8).integers(0, 1 << 63, _LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOADED: dict[str, "SegmentEncoder"] = {}


def encoder(path: str) -> "SegmentEncoder":
    """The encoder of a tokenizer file, one for each worker."""
    if path not in _LOADED:
        _LOADED[path] = SegmentEncoder(path)
    return _LOADED[path]


class SegmentEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        pattern = parts.get("pre_tokenizer") or {}
        #: Whether texts may be cut as described above.
        self.cuttable = parts.get("normalizer") is None and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(words.values()) + 1, dtype=bool)
        self.opens[[i for word, i in words.items() if word.startswith("Ġ")]] = True
        self.known: dict[bytes, int] = {}
        self.begin = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.n = self.used = self.held = 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray) -> int:
        if self.n == len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * self.n), np.resize(self.count, 2 * self.n)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.begin[self.n], self.count[self.n] = self.used, len(ids)
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def _encode_new(self, new: list[bytes]) -> list[np.ndarray]:
        """Ids of each stretch.  Plain ones are joined and told apart by the tokens that begin with a space."""
        out: list[np.ndarray | None] = [None] * len(new)
        texts = [s.decode() for s in new]
        plain = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and not t[1].isspace() and not t[-1].isspace()]
        groups = [plain[k:k + _JOINED] for k in range(0, len(plain), _JOINED)]
        for group, ids in zip(groups, self.plain(["".join(texts[i] for i in group) for group in groups])):
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(group) and cuts[0] == 0:
                for i, piece in zip(group, np.split(ids, cuts[1:])):
                    out[i] = piece
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.plain([texts[i] for i in rest])):
            out[i] = ids
        return out

    def tiles(self, text: str):
        """The text in pieces of about ``TILE`` bytes, cut where a new pre-token begins."""
        begin, step = 0, TILE // 4
        while len(text) - begin > step and (found := _CUT.search(text, begin + step)):
            # a special token has no place to cut within: it would have to hold a mark behind a letter
            yield text[begin:found.start()]
            begin = found.start()
        yield text[begin:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and the number of each text."""
        numbers = np.zeros(len(texts), dtype=np.int64)
        if not self.cuttable or any(_CUT.search(x) for x in self.special):
            found = self.plain(texts)
            numbers[:] = [len(ids) for ids in found]
            return np.concatenate([np.zeros(0, np.uint32), *found]), numbers
        out, group, owners, size = [np.zeros(0, np.uint32)], [], [], 0
        for i, text in enumerate(texts):
            for piece in self.tiles(text):
                if group and size + 4 * len(piece) > TILE:
                    out.append(self._add(group, owners, numbers))
                    group, owners, size = [], [], 0
                group.append(piece)
                owners.append(i)
                size += len(piece) if piece.isascii() else 4 * len(piece)
        if group:
            out.append(self._add(group, owners, numbers))
        return np.concatenate(out), numbers

    def _add(self, group: list[str], owners: list[int], numbers: np.ndarray) -> np.ndarray:
        ids, counts = self._encode(group)
        np.add.at(numbers, owners, counts)
        return ids

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws = [t.encode() for t in texts]
        raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        firsts = np.cumsum(sizes) - sizes
        whole = np.array([_RUN.search(t) is not None or any(x in t for x in self.special) for t in texts], dtype=bool)
        opens = raw == 0x20
        if len(raw) > 2:
            opens[1:] |= _MARK[raw[1:]] & _WORD[raw[:-1]]
            line = (raw[1:-1] == 0x0A) & _SEEN[raw[:-2]] & _LEADS[raw[2:]]
            opens[1:-1] |= line
            opens[2:] |= line
        opens[firsts[sizes > 0]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(raw)))
        owner = np.searchsorted(firsts + sizes, start, "right")
        whole[owner[size > _LONGEST]] = True
        fine = ~whole[owner]
        start, size, owner = start[fine], size[fine], owner[fine]
        ids, counts = self._segments(raw, start, size)
        numbers = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        if not whole.any():
            return ids, numbers
        ends = np.cumsum(numbers)
        odd = np.flatnonzero(whole)
        pieces = [ids[ends[i] - numbers[i]:ends[i]] for i in range(len(texts))]
        for i, found in zip(odd, self.plain([texts[i] for i in odd])):
            pieces[i], numbers[i] = found, len(found)
        return np.concatenate(pieces), numbers

    def _segments(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        before = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(before, size)
        data = raw[np.repeat(start, size) + inside]
        hashes = np.add.reduceat(_WEIGHTS[data] * _PLACES[inside], before)
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        same = size[first][group] == size
        twin = np.repeat(before[first][group] , size) + inside
        equal = data[np.minimum(twin, len(data) - 1)] == data
        same &= np.logical_and.reduceat(equal, before)
        if not same.all():  # unlike stretches of one hash: each of them for itself
            odd = np.flatnonzero(~same)
            group = group.copy()
            group[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        content = data.tobytes()
        distinct = [content[b:b + n] for b, n in zip(before[first].tolist(), size[first].tolist())]
        known, mark = self.known, (self.n, self.used)
        at = np.fromiter((known.get(s, -1) for s in distinct), dtype=np.int64, count=len(distinct))
        lacking = np.flatnonzero(at < 0).tolist()
        new = self._encode_new([distinct[i] for i in lacking])
        more = sum(_ENTRY + len(distinct[i]) + 4 * len(ids) for i, ids in zip(lacking, new))
        keep = self.held + more <= _CACHED
        self.held += more * keep
        for i, ids in zip(lacking, new):
            at[i] = self._store(ids)
            if keep:
                known[distinct[i]] = int(at[i])
        slot = at[group]
        counts = self.count[slot]
        ends = np.cumsum(counts)
        where = np.repeat(self.begin[slot] - ends + counts, counts) + np.arange(ends[-1])
        found = self.ids[where]
        if not keep:
            self.n, self.used = mark
        return found, counts
