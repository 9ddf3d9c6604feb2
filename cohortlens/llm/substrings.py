"""Substring dedup over words with FM-indexes.

Words that lie in a window of 20 which also starts earlier in the corpus are
removed. Windows are brought together by content (see ``anchors``); each
shard of pieces gets a compressed FM-index, through which all its pieces are
streamed from right to left. Backward search over the wavelet matrix keeps
the interval of the longest match, up to a window; an interval that has
reached the window's length is reported, and the first occurrence in it
tells whether the window starts earlier.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from cohortlens.llm import text as X
from cohortlens.llm.anchors import identified, repeated_windows, with_runs
from cohortlens.llm.fmindex import FMIndex
from cohortlens.llm.sais import permuted_lcp, suffix_array

WINDOW = 20
#: Words in one index.
SHARD = 1 << 19


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and each document's first word."""
    starts, ends, first = X.words(data, offsets, X.SPACE)
    words = X.word_array(data, starts, ends).dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    table = np.fromiter((h(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return table[words.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64), first


def matching_statistics(index: FMIndex, t: np.ndarray, first: np.ndarray, lcp: np.ndarray, cap: int) -> np.ndarray:
    """For each text place where a match of ``cap`` symbols begins, the start of its interval; else -1.

    The texts are walked side by side from their ends. A match of full length
    drops its last symbol before it grows on the left: its interval widens to the
    neighbours that share one symbol less.
    """
    n = len(t)
    begin = np.flatnonzero(np.concatenate([lcp[:1] < 0, lcp[1:] < cap - 1]) | (np.arange(n) == 0))
    group = np.cumsum(np.bincount(begin, minlength=n)) - 1
    edge = np.concatenate([begin, [n]])
    found = np.full(n, -1, np.int64)
    lens = np.diff(first) - 1  # without the separator
    order = np.argsort(-lens, kind="stable")
    end, lens = first[:-1][order] + lens[order], lens[order]
    lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), n, np.int64), np.zeros(len(order), np.int64)
    for step in range(int(lens[0]) if len(lens) else 0):
        live = int(np.searchsorted(-lens, -step))  # texts longer than this many symbols
        i = end[:live] - 1 - step
        full = size[:live] == cap
        a, b = lo[:live], hi[:live]
        a, b = np.where(full, edge[group[a]], a), np.where(full, edge[group[np.maximum(b - 1, 0)] + 1], b)
        a, b = index.extend(t[i], a, b)
        # A text of the index always matches itself, so an interval is never empty.
        lo[:live], hi[:live] = a, b
        size[:live] = np.minimum(size[:live] + 1, cap)
        done = size[:live] == cap
        found[i[done]] = a[done]
    return found


def earlier_windows(tokens: np.ndarray, first: np.ndarray, d: np.ndarray, h: np.ndarray, start: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks the tokens where a window begins that also starts earlier in another piece."""
    words, ids = np.unique(tokens, return_inverse=True)
    k = np.arange(len(first) - 1)
    t = np.ones(len(tokens) + len(k) + 1, np.int64)  # 1 ends a piece, 0 the text
    at = np.arange(len(tokens)) + np.repeat(k, np.diff(first))
    t[at], t[-1] = ids.ravel() + 2, 0
    edges = first + np.arange(len(first))
    sa = suffix_array(t, len(words) + 2)
    lcp = permuted_lcp(t, sa, edges, window, 1)[sa]
    index = FMIndex(t, sa, len(words) + 2)
    place = matching_statistics(index, t, edges, lcp, window)
    rows = np.lexsort((h, d))
    new = np.concatenate([[False], (d[rows][1:] != d[rows][:-1]) | (h[rows][1:] != h[rows][:-1])])
    doc = np.empty(len(d), np.int64)
    doc[rows] = np.cumsum(new)
    piece = np.repeat(k, np.diff(edges))
    key = np.full(len(t), np.iinfo(np.int64).max)
    inside = np.flatnonzero(place >= 0)
    key[inside] = (doc[piece[inside]] << 40) | (start[piece[inside]] + inside - edges[piece[inside]])
    begin = np.flatnonzero((lcp < window) | (np.arange(len(t)) == 0))
    least = np.minimum.reduceat(key[sa], begin)
    out = np.zeros(len(t), bool)
    out[inside] = least[np.searchsorted(begin, place[inside], "right") - 1] < key[inside]
    return out[at]


_LEVELS = [6, 13, 17, 19, 20]


def substring_dedup(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Remove words covered by a window of 20 words that also starts earlier.

    Earlier is a smaller doc_id (null before all) or, in one document, a smaller
    place; windows are judged on the input. One row per input row: the ``carry``
    columns (doc_id), n_words, n_removed, kept_text (kept words joined by a
    space), kept_sha256. Null and blank texts have no words. Different texts that
    share a doc_id are ordered by a hash of the text; rows alike in doc_id and
    text are equals, of which neither is earlier.
    """
    docs = identified(docs)
    runs = repeated_windows(docs, word_hashes, np.uint64, WINDOW, _LEVELS, earlier_windows, SHARD, every=False)

    def tokens_of(data, offsets):
        starts, ends, first = X.words(data, offsets, X.SPACE)
        return first, (starts, ends)

    def fn(data, offsets, first, cover, words):
        keep = np.flatnonzero(~cover)
        out, s, e = X.spaced(data, words[0][keep], words[1][keep])
        upto = np.searchsorted(keep, first)
        a = np.append(s, len(out))[upto]
        b = np.maximum(a[1:] - 1, a[:-1])
        flat = out.tobytes()
        kept = [flat[x:y] for x, y in zip(a[:-1].tolist(), b.tolist(), strict=True)]
        n = np.diff(first)
        return [n, n - np.diff(upto), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]

    fields = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_text", "string"), ("kept_sha256", "string")]
    return with_runs(docs, runs, fields, fn, WINDOW, tokens_of, carry or ["doc_id"])
