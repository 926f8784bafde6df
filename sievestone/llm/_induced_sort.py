"""External induced suffix sorting.

Suffixes are sorted by induction from the leftmost-S suffixes (LMS), which are sorted
by the same means among themselves. The queue of a bucket receives its suffixes in
their final order, so a priority queue over (symbol, order of arrival) is one first-in
first-out queue for each symbol; queues hold whole arrays of suffixes, and beyond a
memory limit they keep them in a file of the task's own, removed when the sort ends.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Queues:
    """A queue of arrays for each symbol, in memory up to `limit` bytes, then on disk."""

    def __init__(self, symbols: int, limit: int) -> None:
        self.held: list[list] = [[] for _ in range(symbols)]
        self.free = limit
        self.file = None

    def push(self, symbol: int, items: np.ndarray) -> None:
        if not len(items):
            return
        if items.nbytes <= self.free:
            self.free -= items.nbytes
            self.held[symbol].append(items)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="sort-")
        at = self.file.seek(0, 2)
        self.file.write(items.tobytes())
        self.held[symbol].append((at, len(items), items.dtype))

    def pop(self, symbol: int) -> np.ndarray:
        out = []
        for x in self.held[symbol]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(x[1] * x[2].itemsize), x[2])
            else:
                self.free += x.nbytes
            out.append(x)
        self.held[symbol] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _send(queues: Queues, items: np.ndarray, symbols: np.ndarray) -> None:
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    cut = np.flatnonzero(np.diff(symbols)) + 1
    for part, at in zip(np.split(items, cut), np.concatenate([[0], cut]), strict=True):
        if len(part):
            queues.push(int(symbols[at]), part)


def _induce(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int, limit: int) -> np.ndarray:
    """The order of all suffixes from the LMS suffixes in order (seeds)."""
    first = np.searchsorted(t[seeds], np.arange(symbols + 1))
    rising, sorted_l = Queues(symbols, limit), Queues(symbols, limit)
    rising.push(int(t[-1]), np.array([len(t) - 1], np.int32))
    present = np.flatnonzero(np.bincount(t, minlength=symbols))
    for c in present:
        batch = rising.pop(c)
        while len(batch):
            sorted_l.push(c, batch)
            j = batch[batch > 0] - 1
            j = j[~is_s[j]]
            ch = t[j]
            same = ch == c
            _send(rising, j[~same], ch[~same])
            batch = j[same]
        j = seeds[first[c] : first[c + 1]]
        j = j[j > 0] - 1
        j = j[~is_s[j]]
        _send(rising, j, t[j])
    rising.close()
    falling = Queues(symbols, limit)
    out, at = np.empty(len(t), np.int32), len(t)
    for c in present[::-1]:
        batch = falling.pop(c)
        while len(batch):
            out[at - len(batch) : at] = batch[::-1]
            at -= len(batch)
            j = batch[batch > 0] - 1
            j = j[is_s[j]]
            ch = t[j]
            same = ch == c
            _send(falling, j[~same], ch[~same])
            batch = j[same]
        large = sorted_l.pop(c)
        out[at - len(large) : at] = large
        at -= len(large)
        j = large[::-1]
        j = j[j > 0] - 1
        j = j[is_s[j]]
        _send(falling, j, t[j])
    falling.close()
    sorted_l.close()
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _names(t: np.ndarray, lms: np.ndarray, by_order: np.ndarray) -> np.ndarray:
    """A name for each LMS substring (up to the next LMS position, included), equal for
    equal substrings and in their order. by_order: lms in the order of substrings."""
    ends = np.append(lms[1:] + 1, len(t))
    size = ends - lms
    whole = np.empty(len(lms), np.uint64)
    for i in range(0, len(lms), 1 << 15):
        n = size[i : i + (1 << 15)]
        first = np.cumsum(n) - n
        place = np.arange(n.sum(), dtype=np.int64) - np.repeat(first, n)
        term = _mix((t[place + np.repeat(lms[i : i + (1 << 15)], n)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64))
        whole[i : i + (1 << 15)] = np.add.reduceat(term, first)
    rank = np.searchsorted(lms, by_order)
    new = np.ones(len(lms), bool)
    new[1:] = (whole[rank[1:]] != whole[rank[:-1]]) | (size[rank[1:]] != size[rank[:-1]])
    names = np.empty(len(lms), np.int64)
    names[rank] = np.cumsum(new) - 1
    return names


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of names, of those alike in their first `depth` names any."""
    rank, n, h = names, len(names), 1
    order = np.argsort(rank, kind="stable")
    while h < depth and rank.max() < n - 1:
        key = (rank << 32) | np.concatenate([rank[h:] + 1, np.zeros(min(h, n), np.int64)])
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        h *= 2
    return order


def suffix_order(t: np.ndarray, depth: int, limit: int = 256 << 20, level: int = 0) -> np.ndarray:
    """Starts of all suffixes of t (small non-negative integers) in order. Suffixes alike
    in their first `depth` symbols may come in any order among themselves.

    limit: bytes of queues kept in memory. The names of the LMS substrings make a string
    of at most half the length. It is sorted by induction again while its alphabet
    is small (as in repetitive text), else by doubling, at most log(depth) rounds."""
    n = len(t)
    if n >= 2**31:
        raise ValueError("a text to sort must be shorter than 2 GB")
    if n < 2:
        return np.arange(n, dtype=np.int32)
    t = t.astype(np.int64) if level else t
    less = np.append(t[:-1] < t[1:], False)
    differs = np.append(t[:-1] != t[1:], True)
    next_diff = np.minimum.accumulate(np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]
    is_s = less[next_diff]
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    symbols = int(t.max()) + 1
    if not len(lms):
        return _induce(t, is_s, lms, symbols, limit)
    del less, differs, next_diff
    by_order = _induce(t, is_s, lms[np.argsort(t[lms], kind="stable")], symbols, limit)
    by_order = by_order[is_lms[by_order]]
    names = _names(t, lms, by_order)
    if names.max() == len(lms) - 1:
        order = np.searchsorted(lms, by_order)
    elif names.max() < 1024 and level < 8:
        order = suffix_order(names, -(-depth // 2) + 1, limit, level + 1)
    else:
        order = _by_doubling(names, -(-depth // 2) + 1)
    return _induce(t, is_s, lms[order], symbols, limit)
