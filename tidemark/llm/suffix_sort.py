"""External suffix sorting by induction, with common-prefix values, for texts larger than memory.

The queue of suffix tuples is a file of slots in buckets by first character: an entry's key is (character, rank of the suffix behind
it), and as suffixes are taken in rising order, each bucket is served first in, first out.  A scan takes the longest run of entries into
which none of the run itself still falls, so that whole runs are handled at once; only the run and the bucket ends are in memory.
Each entry carries the length of its common prefix with the entry before it in its bucket: one more than the smallest value between the
two entries that induced them.  Suffixes at local minima (LMS) are sorted by the same scans over the string of their names, recursively,
until that string fits into memory.

Common prefixes are cut off at ``CAP``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Common prefixes are counted up to here.
CAP = 400
#: Arrays with more entries lie in files of the task's temporary folder.
IN_MEMORY = 1 << 24
#: A string of names up to this length is ranked in memory and ends the recursion.
DIRECT = 1 << 22
#: Entries of one run at most.
RUN = 1 << 18


class Store:
    """Arrays in memory or, if large, mapped from unnamed files, which end with the store."""

    def array(self, n: int, kind, fill=0) -> np.ndarray:
        if n <= IN_MEMORY:
            return np.full(n, fill, dtype=kind)
        handle, path = tempfile.mkstemp(prefix="suffix-")
        os.close(handle)
        out = np.memmap(path, dtype=kind, mode="w+", shape=(n,))
        os.unlink(path)
        if fill:
            out[:] = fill
        return out


def _pieces(n: int):
    return ((at, min(at + RUN, n)) for at in range(0, n, RUN))


def _types(text: np.ndarray, store: Store) -> np.ndarray:
    """True where a suffix is smaller than the one behind it."""
    n = len(text)
    small = store.array(n, bool)
    small[n - 1] = True
    after = True
    for begin, end in reversed(list(_pieces(n - 1))):
        a, b = text[begin:end].astype(np.int64), text[begin + 1:end + 1].astype(np.int64)
        step = np.sign(b - a)[::-1]
        known = np.maximum.accumulate(np.where(step != 0, np.arange(len(step)), -1))
        out = np.where(known >= 0, step[np.maximum(known, 0)] > 0, after)
        after = bool(out[-1])
        small[begin:end] = out[::-1]
    return small


def _runs(text: np.ndarray, store: Store) -> np.ndarray:
    """Length of the run of one character that starts at each place, up to CAP."""
    n = len(text)
    out = store.array(n, np.uint16)
    out[n - 1] = 1
    carry = 1
    for begin, end in reversed(list(_pieces(n - 1))):
        same = (text[begin:end] == text[begin + 1:end + 1])[::-1]
        at = np.arange(len(same))
        broken = np.maximum.accumulate(np.where(~same, at, -1))
        length = np.where(broken >= 0, at - broken + 1, at + 1 + carry)
        carry = min(CAP, int(length[-1]))
        out[begin:end] = np.minimum(length, CAP)[::-1]
    return out


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of ``values[low..high]`` for each pair, both included."""
    table, size = [values], 1
    longest = int((high - low).max()) + 1
    while 2 * size <= longest:
        last = table[-1]
        table.append(np.minimum(last[:-size], last[size:]))
        size *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=values.dtype)
    for k in range(len(table)):
        mine = np.flatnonzero(level == k)
        if mine.size:
            out[mine] = np.minimum(table[k][low[mine]], table[k][high[mine] - (1 << k) + 1])
    return out


def _scan(text, small, slots, lcp, ends, seams, runs, forward: bool) -> None:
    """Induce the larger suffixes (forward) or the smaller ones (backward) from the entries in ``slots``.

    ``ends``: first slot of each bucket (forward), or the slot behind it (backward); moves with the bucket.  ``seams``: first slot of the
    smaller suffixes of each bucket.  ``lcp`` may be None.
    """
    n, origin = len(slots), ends.copy()
    sign = 1 if forward else -1
    since = np.full(len(ends), CAP, dtype=np.uint16)
    done, width = 0, 1024
    while done < n:
        size = min(width, n - done)
        if forward:
            begin, block = done, np.array(slots[done:done + size])
        else:
            begin, block = n - done - size, np.array(slots[n - done - size:n - done])[::-1]
        before = block - 1
        fine = block > 0
        mine = np.flatnonzero(fine)
        mine = mine[small[before[mine]] != forward]
        char = text[before[mine]].astype(np.int64)
        # in scan order, the place where the next entry of that bucket goes
        place = ends[char] if forward else n - ends[char]
        first = np.full(size, 2 * n + 2, dtype=np.int64)
        first[mine] = place
        reach = np.minimum.accumulate(first) < done + np.arange(size) + 1
        m = int(np.argmax(reach)) if reach.any() else size
        keep = np.searchsorted(mine, m)
        mine, char = mine[:keep], char[:keep]
        if lcp is not None:
            low, high = (done, done + m) if forward else (n - done - m + 1, n - done + 1)
            crossed = np.flatnonzero((seams >= low) & (seams < high))
            for c in crossed.tolist():
                seam = int(seams[c])
                left = int(ends[c]) - 1 if forward else seam - 1
                if seam < n and left >= int(origin[c] if forward else 0) and slots[seam] >= 0 and slots[left] >= 0 and text[slots[left]] == c == text[slots[seam]]:
                    lcp[seam] = min(runs[slots[left]], runs[slots[seam]])
            steps = np.array(lcp[done:done + m]) if forward else np.array(lcp[n - done - m + 1:n - done + 1])[::-1]
            if forward:
                steps[block[:m] < 0] = CAP
        if keep:
            order = np.argsort(char, kind="stable")
            by, source = char[order], mine[order]
            opens = np.append(True, by[1:] != by[:-1])
            at = np.flatnonzero(opens)
            counts = np.diff(np.append(at, keep))
            rank = np.arange(keep) - np.repeat(at, counts)
            target = ends[by] + sign * rank - (0 if forward else 1)
            slots[target] = before[source]
            chars = by[at]
            if lcp is not None:
                value = np.zeros(keep, dtype=np.uint16)
                inner = np.flatnonzero(~opens)
                if inner.size:
                    value[inner] = np.minimum(CAP, _least(steps, source[inner - 1] + 1, source[inner]) + 1)
                heads = np.minimum.accumulate(steps)
                used = ends[chars] != origin[chars]
                value[at] = np.where(used, np.minimum(CAP, np.minimum(since[chars], heads[source[at]]) + 1), 0)
                lcp[target if forward else target + 1] = value
                tails = np.append(np.minimum.accumulate(steps[::-1])[::-1], np.uint16(CAP))
                since = np.minimum(since, heads[m - 1])
                since[chars] = tails[source[np.append(at[1:], keep) - 1] + 1]
            ends[chars] += sign * counts
        elif lcp is not None and m:
            since = np.minimum(since, steps.min())
        done += m
        width = int(min(RUN, max(256, 2 * m)))


def _places(counts: np.ndarray, small_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First slot of each bucket, the slot behind it, and the first slot of its smaller suffixes."""
    behind = np.cumsum(counts)
    return behind - counts, behind, behind - small_counts


def _fill(slots: np.ndarray, text: np.ndarray, minima: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Put sorted LMS suffixes at the ends of their buckets; gives the slot of each."""
    char = text[minima].astype(np.int64)
    counts = np.bincount(char, minlength=len(behind))
    order = np.argsort(char, kind="stable")
    first = np.cumsum(counts) - counts
    where = np.empty(len(minima), dtype=np.int64)
    where[order] = (behind - counts)[char[order]] + np.arange(len(minima)) - first[char[order]]
    slots[where] = minima
    return where


def _names(text: np.ndarray, minima: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, given their sorted order."""
    n = len(text)
    follow = np.searchsorted(minima, ordered)
    length = np.append(np.diff(minima), 0)[follow] + 1
    a, b = ordered[:-1], ordered[1:]
    alive = np.flatnonzero(length[:-1] == length[1:])
    unlike = length[:-1] != length[1:]
    depth = 0
    while alive.size:
        x, y = a[alive] + depth, b[alive] + depth
        same = text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]
        unlike[alive[~same]] = True
        alive = alive[same]
        depth += 1
        alive = alive[depth < length[alive]]
    rank = np.append(0, np.cumsum(unlike))
    names = np.empty(len(minima), dtype=np.int64)
    names[follow] = rank
    return names, int(rank[-1]) + 1


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of suffixes pair by pair, up to CAP; the text ends with its smallest character."""
    out = np.full(len(a), CAP, dtype=np.uint16)
    n, alive, depth = len(text), np.arange(len(a)), 0
    while alive.size and depth < CAP:
        x, y = a[alive] + depth, b[alive] + depth
        inside = (x < n) & (y < n)
        same = inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        out[alive[~same]] = depth
        alive = alive[same]
        depth += 1
    return out


def _ranked(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string that fits into memory, by ranks of prefixes of doubled length."""
    n, depth = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[:max(0, n - depth)] = rank[depth:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1:
            return order
        depth *= 2


def sort_suffixes(text: np.ndarray, letters: int, store: Store, with_lcp: bool = True):
    """Suffix array of ``text``, which ends with a 0 found nowhere else, and common prefixes of neighbours (or None)."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(2, np.uint16)
    small = _types(text, store)
    counts = np.bincount(text, minlength=letters)
    small_counts = np.bincount(text[small], minlength=letters)
    starts, behind, seams = _places(counts, small_counts)
    minima = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    slots = store.array(n, np.int64, -1)
    _fill(slots, text, minima, behind)
    _scan(text, small, slots, None, starts.copy(), seams, None, True)
    _clear(slots, seams, behind)
    _scan(text, small, slots, None, behind.copy(), seams, None, False)
    is_minimum = store.array(n, bool)
    is_minimum[minima] = True
    ordered = np.concatenate([part[is_minimum[part]] for part in (np.array(slots[a:b]) for a, b in _pieces(n))])
    names, distinct = _names(text, minima, ordered)
    if distinct < len(minima):
        ordered = minima[_ranked(names) if len(names) <= DIRECT else np.array(sort_suffixes(names, distinct, store, False)[0])]
    slots[:] = -1
    where = _fill(slots, text, ordered, behind)
    lcp = runs = None
    if with_lcp:
        lcp, runs = store.array(n + 1, np.uint16), _runs(text, store)
        pair = np.flatnonzero(text[ordered[1:]] == text[ordered[:-1]])
        lcp[where[pair + 1]] = _common(text, ordered[pair], ordered[pair + 1])
    minimum_seams = np.full(letters, n + 1, dtype=np.int64)
    minimum_counts = np.bincount(text[ordered].astype(np.int64), minlength=letters)
    minimum_seams[minimum_counts > 0] = (behind - minimum_counts)[minimum_counts > 0]
    _scan(text, small, slots, lcp, starts.copy(), minimum_seams, runs, True)
    _clear(slots, seams, behind)
    if with_lcp:
        for seam, end in zip(seams.tolist(), behind.tolist()):
            lcp[seam:end] = 0
    both = np.where((small_counts > 0) & (small_counts < counts), seams, n + 1)
    _scan(text, small, slots, lcp, behind.copy(), both, runs, False)
    return slots, lcp


def _clear(slots: np.ndarray, seams: np.ndarray, behind: np.ndarray) -> None:
    """Empty the smaller suffixes' part of each bucket but for the end of the text."""
    if len(seams) <= 4096:
        for seam, end in zip(seams[1:].tolist(), behind[1:].tolist()):
            slots[seam:end] = -1
        return
    for begin, end in _pieces(len(slots)):
        at = np.arange(begin, end)
        bucket = np.searchsorted(behind, at, "right")
        part = slots[begin:end]
        part[(at >= seams[bucket]) & (bucket > 0)] = -1
