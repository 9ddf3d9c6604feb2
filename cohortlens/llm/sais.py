"""Suffix arrays by induced sorting, in array passes.

Suffixes are classified as S or L; the leftmost-S substrings are sorted by
one round of induction and named; unless all names differ, the string of
names is sorted recursively; a second round of induction gives the suffix
array. An induction scans the array in order and moves each predecessor to
its bucket. It runs here in blocks: the longest run of entries none of which
is moved into the run itself is handled at once, so every block sees what
the scan one by one would see.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S: smaller than the following suffix. The last symbol is the unique smallest."""
    n = len(t)
    ends = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))  # last place of each run
    up = np.ones(len(ends), bool)
    up[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(up, np.diff(np.concatenate([[-1], ends]))) if n else np.zeros(0, bool)


def _order(c: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers."""
    if c.dtype == np.uint16 or c.dtype == np.uint8:
        return np.argsort(c, kind="stable")
    width = np.uint64(max(1, int(len(c)).bit_length()))
    key = np.sort((c.astype(np.uint64) << width) | np.arange(len(c), dtype=np.uint64))
    return (key & np.uint64((1 << int(width)) - 1)).astype(np.int64)


def _sweep(t: np.ndarray, sa: np.ndarray, moves: np.ndarray, head: np.ndarray) -> None:
    """Scan ``sa`` in order; where moves[x - 1] for an entry x, put x - 1 at the head of its bucket."""
    n, p, size = len(sa), 0, 1024
    while p < n:
        q = min(p + size, n)
        block = sa[p:q]
        prev = block - 1
        at = np.flatnonzero((block > 0) & moves[prev])
        if not len(at):
            p, size = q, min(size * 2, 1 << 17)
            continue
        prev = prev[at]
        c = t[prev]
        order = _order(c)
        sorted_c = c[order]
        fresh = np.concatenate([[True], sorted_c[1:] != sorted_c[:-1]])
        starts = np.flatnonzero(fresh)
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(at)]])))
        to = head[c] + rank
        lowest = np.minimum.accumulate(to)
        end, took = q, len(at)
        while took and lowest[took - 1] < end:
            end = int(lowest[took - 1])
            took = int(np.searchsorted(at, end - p))
        if took == len(at):
            np.add.at(head, sorted_c[starts], np.diff(np.concatenate([starts, [len(at)]])))
        else:
            prev, to = prev[:took], to[:took]
            np.add.at(head, c[:took], 1)
        sa[to] = prev
        size = min(size * 2, 1 << 17) if end == q else max(2 * (end - p), 64)
        p = end


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array induced from ``seeds`` (leftmost-S places, in their order)."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    c = t[seeds]
    order = _order(c)  # stable: seeds of a bucket keep their order, at the bucket's end
    k = np.bincount(c, minlength=len(bounds) - 1)
    last = np.cumsum(k)
    sa[np.arange(len(seeds)) - last[c[order]] + bounds[1:][c[order]]] = seeds[order]
    head = bounds[:-1].copy()
    _sweep(t, sa, ~s_type, head)
    filled = sa >= 0
    filled[filled] = s_type[sa[filled]]
    sa[filled] = -1
    sa[0] = n - 1
    back = sa[::-1]
    tail = n - bounds[1:]
    # The last symbol's own bucket is filled already.
    tail[t[n - 1]] = n
    moves = s_type.copy()
    moves[n - 1] = False
    _sweep(t, back, moves, tail)
    return sa


def suffix_array(t: np.ndarray, symbols: int | None = None) -> np.ndarray:
    """Suffix array of ``t``, non-negative integers whose last is 0 and the only 0."""
    n = len(t)
    if n <= 1:
        return np.zeros(n, np.int64)
    symbols = symbols or int(t.max()) + 1
    t = t.astype(np.uint16) if symbols <= 1 << 16 else t.astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
    s_type = _types(t)
    lms = np.flatnonzero(s_type & np.concatenate([[False], ~s_type[:-1]]))
    if len(lms) == 1:
        return _induce(t, s_type, lms, bounds)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(t, s_type, lms, bounds)
    got = sa[is_lms[sa]]
    # Names: an LMS substring reaches to the next LMS place.
    place = np.zeros(n, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.concatenate([lms, [n - 1]])) + 1
    size = length[place[got]]
    same = np.zeros(len(got), bool)
    cand = np.flatnonzero((size[1:] == size[:-1]) & (t[got[1:]] == t[got[:-1]])) + 1
    for a in range(0, len(cand), 1 << 16):
        k = cand[a:a + (1 << 16)]
        m = size[k]
        off = np.cumsum(m) - m
        step = np.arange(int(m.sum())) - np.repeat(off, m)
        x, y = np.repeat(got[k], m) + step, np.repeat(got[k - 1], m) + step
        same[k] = np.logical_and.reduceat(t[x] == t[y], off)
    same[got == n - 1] = False
    name = np.cumsum(~same) - 1
    if name[-1] + 1 == len(lms):
        seeds = got
    else:
        reduced = np.empty(len(lms), np.int64)
        reduced[place[got]] = name
        seeds = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return _induce(t, s_type, seeds, bounds)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, first: np.ndarray, cap: int, separator: int) -> np.ndarray:
    """Common prefix with the preceding suffix of the array, by text place, up to ``cap``.

    A prefix ends at a separator. Texts begin at ``first`` and are walked side by
    side: from one place to the next the value falls by one at most.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    i, stop = first[:-1].copy(), first[1:]
    live = i < stop
    i, stop = i[live], stop[live]
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = phi[i]
        a = t[np.minimum(i + h, n - 1)]
        go = (j >= 0) & (h < cap) & (a != separator) & (a == t[np.minimum(np.maximum(j, 0) + h, n - 1)]) & (np.maximum(i, j) + h < n)
        out[i] = h
        step = ~go
        h = np.where(go, h + 1, np.maximum(h - 1, 0))
        i = i + step
        live = i < stop
        if not live.all():
            i, stop, h = i[live], stop[live], h[live]
    return out
