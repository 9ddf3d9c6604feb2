"""Byte-level BPE with a transducer lexicon of the corpus's frequent words.

A first pass counts the words of all documents; the most frequent ones are
merged once and compiled into a minimal automaton (see ``lexicon``), shipped as
a file and mapped into memory by the tasks. Encoding cuts texts at places where
no word can span, looks each different word of a slice up in the automaton and
merges the unseen ones exactly, all at once: every round merges in each word
its pair of lowest rank, until no pair has one. Very long words are merged one by one, their pairs in a heap.
"""

from __future__ import annotations

import heapq
import json
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.lexicon import Lexicon, build
from cohortlens.llm.scratch import keep, write_shared

#: Words in the lexicon.
WORDS = 1 << 15
#: Text that is encoded at once.
SLICE_BYTES = 2 << 20
#: Longer words are merged, not kept in the lexicon.
LONGEST = 48
#: Longer words are merged one by one with a heap, not all at once in rounds.
LONG = 64

_WS = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
_ASCII_SPACE = np.array([9 <= b <= 13 or b == 32 or 0x1C <= b <= 0x1F for b in range(256)])
#: First bytes of characters that may be white space beyond ASCII.
_WIDE = np.array([b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = bytes(symbols[c] for c in t)
        for t, i in added.items():
            tokens[i] = t.encode()
        self.special = sorted(((t.encode(), i) for t, i in added.items()), key=lambda x: -len(x[0]))
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.cumsum([0] + [len(t) for t in tokens])
        self.of_byte = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made[order]
        self._pairs: dict[int, tuple[int, int]] | None = None

    def merge(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words, concatenated, and the number of each. Work is in proportion to the bytes (times their logarithm, for a long word)."""
        long = np.flatnonzero(lens > LONG)
        if not len(long):
            return self._merge_rounds(data, starts, lens)
        short = np.flatnonzero(lens <= LONG)
        ids, n = self._merge_rounds(data, starts[short], lens[short])
        each = [self._merge_long(data[a:a + m]) for a, m in zip(starts[long].tolist(), lens[long].tolist(), strict=True)]
        size = np.zeros(len(lens), np.int64)
        size[short], size[long] = n, [len(e) for e in each]
        first = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int64)
        out[X.ragged(first[short], n)] = ids
        out[X.ragged(first[long], size[long])] = np.concatenate(each)
        return out, size

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """One word: pairs wait in a heap by rank and place, symbols are a linked list."""
        if self._pairs is None:
            self._pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        pairs, first = self._pairs, self.of_byte[data]
        n = len(first)
        pair = (first[:-1] << 32) | first[1:]
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        place = np.flatnonzero(self.key[at] == pair)
        heap = ((self.rank[at[place]] << 32) | place).tolist()
        heapq.heapify(heap)
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            got = pairs.get(ids[i] << 32 | ids[j])
            if got is None or got[0] != top >> 32:
                continue  # one of the two has merged since
            ids[i], ids[j] = got[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (more := pairs.get(got[1] << 32 | ids[k])) is not None:
                    push(heap, more[0] << 32 | i)
            if (h := before[i]) >= 0 and (more := pairs.get(ids[h] << 32 | got[1])) is not None:
                push(heap, more[0] << 32 | h)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def _merge_rounds(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of LONG bytes at most, all at once: every round merges in each word its pair of lowest rank."""
        ids = self.of_byte[data[X.ragged(starts, lens)]]
        word = np.repeat(np.arange(len(starts)), lens)
        none = np.iinfo(np.int64).max
        out_ids, out_word = [], []
        while len(ids):
            pair = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            ok = (self.key[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(ok, self.rank[at], none), none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == none
            if over.any():
                out_ids.append(ids[over])
                out_word.append(word[over])
                stay = ~over
                ids, word, rank, least = ids[stay], word[stay], rank[stay], least[stay]
                at = np.append(at, 0)[stay]
                if not len(ids):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == least
            # Of places in a row (one symbol repeated) every other one merges, from the left.
            place = np.flatnonzero(hit)
            begin = np.concatenate([[True], (np.diff(place) != 1) | (word[place[1:]] != word[place[:-1]])])
            nth = np.arange(len(place)) - np.repeat(np.flatnonzero(begin), np.diff(np.append(np.flatnonzero(begin), len(place))))
            place = place[nth % 2 == 0]
            ids[place] = self.made[at[place]]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            ids, word = ids[stay], word[stay]
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(starts))


def cuts(data: np.ndarray, offsets: np.ndarray, special: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, special id or -1) of chunks that can be split into words one by one.

    A chunk begins at each document, at a single space or line end between other
    characters, after such a line end, between an ASCII letter and an ASCII sign or
    digit, and around special tokens. Elsewhere the chunk goes on.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    space, wide = _ASCII_SPACE[data], _WIDE[data]
    solid_before = np.zeros(n, bool)  # the character before is surely no white space
    solid_before[1:] = ~space[:-1]
    solid_before[2:] &= ~wide[:-2]
    solid_before[3:] &= ~wide[:-3]
    solid_after = np.zeros(n, bool)
    solid_after[:-1] = ~space[1:] & ~wide[1:]
    edge = offsets[(offsets < n)]
    solid_before[edge] = False
    solid_after[offsets[offsets > 0] - 1] = False
    alone = solid_before & solid_after
    line = alone & (data == 10)
    begin = (alone & (data == 32)) | line
    begin[1:] |= line[:-1]
    letter = _LETTER[data]
    begin[1:] |= letter[:-1] & ~letter[1:] & ~space[1:] & (data[1:] < 0x80)
    begin[edge] = True
    at, size, which = _special_places(data, offsets, special)
    if len(at):
        begin[X.ragged(at, size)] = False
        begin[at] = True
        begin[(at + size)[at + size < n]] = True
    starts = np.flatnonzero(begin)
    kind = np.full(len(starts), -1)
    kind[np.searchsorted(starts, at)] = which
    return starts, np.append(starts[1:], n), kind


def _special_places(data: np.ndarray, offsets: np.ndarray, special: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of special tokens in texts: longer ones first, each from the left, none over another or over two documents."""
    flat, taken, found = data.tobytes(), np.zeros(len(data), bool), []
    for text, i in special:
        m, at, places = len(text), flat.find(text), []
        while at >= 0:
            places.append(at)
            at = flat.find(text, at + 1)
        places = np.array(places, np.int64)
        places = places[places + m <= offsets[np.minimum(np.searchsorted(offsets, places, "right"), len(offsets) - 1)]]
        # A longer token that stands over this one covers its first or its last byte.
        places = places[~taken[places] & ~taken[places + m - 1]].tolist()
        kept, end = [], -1
        for a in places:
            if a >= end:
                kept.append(a)
                end = a + m
        kept = np.array(kept, np.int64)
        taken[X.ragged(kept, np.full(len(kept), m))] = True
        found.append((kept, np.full(len(kept), m), np.full(len(kept), i)))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _words(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of different chunks: (bytes, starts, lengths, first word of each chunk)."""
    data, off = X.buffer(chunks)
    n = len(chunks)
    other = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    lens = np.diff(off)
    lead = np.zeros(n, np.int64)
    lead[lens > 0] = data[off[:-1][lens > 0]] == 32
    plain = (other[off[1:]] - other[off[:-1]] - lead == 0) | (lens <= 1)  # a space, if any, and letters
    rest = np.flatnonzero(~plain)
    sizes = np.ones(n, np.int64)
    inner = []
    flat = data.tobytes()
    for k in rest.tolist():
        got = [len(w.encode()) for w in _SPLIT.findall(flat[off[k]:off[k + 1]].decode())]
        sizes[k] = len(got)
        inner.extend(got)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(first[-1]), np.int64)
    out[first[:-1][plain]] = lens[plain]
    out[X.ragged(first[:-1][rest], sizes[rest])] = inner
    return data, np.cumsum(out) - out, out, first


def _distinct_words(chunks: pa.Array):
    """The different words of chunks, and which they are, in order."""
    data, starts, lens, first = _words(chunks)
    words = X.word_array(data, starts, starts + lens).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), first


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word binary, n) over all texts; words longer than LONGEST bytes are left out."""
    special = vocabulary.special

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, SLICE_BYTES):
                data, offsets = X.buffer(part.column("text"))
                s, e, kind = cuts(data, offsets, special)
                s, e = s[kind < 0], e[kind < 0]
                chunks = X.word_array(data, s, e).dictionary_encode()
                words, which, first = _distinct_words(chunks.dictionary)
                times = np.bincount(chunks.indices.to_numpy(), minlength=len(chunks.dictionary))
                n = np.bincount(which, np.repeat(times, np.diff(first)), len(words)).astype(np.int64)
                short = np.diff(X.buffer(words)[1]) <= LONGEST
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(short)).cast(pa.binary()), pa.array(n[short])], ["word", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = WORDS) -> np.ndarray:
    """The transducer of the most frequent words, ``size`` at most.

    Counts are put into steps of about nine per cent; all words of the highest steps that fit
    are taken, so that the driver gets one row per step and then the chosen words alone.
    """
    counts = keep(word_counts(docs, vocabulary).select("word", F.floor(F.log2("n") * 8).alias("step")))
    steps = sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    least, total = None, 0
    for r in steps:
        total += r["n"]
        if total > size:
            break
        least = r["step"]
    top = counts.where(F.col("step") >= least).select("word").collect() if least is not None else []
    words = [bytes(r["word"]) for r in top]
    lens = np.array([len(w) for w in words], np.int64)
    ids, n = vocabulary.merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens)
    ends = np.cumsum(n).tolist()
    flat = ids.tolist()
    return build(words, [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)])  # noqa: B905


def encode_slice(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, concatenated, and the number of each document's."""
    s, e, kind = cuts(data, offsets, vocabulary.special)
    chunks = X.word_array(data, s, e).dictionary_encode()
    which_chunk = chunks.indices.to_numpy()
    words, which, first = _distinct_words(chunks.dictionary)
    wdata, woff = X.buffer(words)
    number = lexicon.find(wdata, woff[:-1], np.diff(woff))
    new = np.flatnonzero(number < 0)
    ids, n = vocabulary.merge(wdata, woff[:-1][new], np.diff(woff)[new])
    flat = np.concatenate([lexicon.flat, ids, [i for _, i in vocabulary.special]]).astype(np.int64)
    at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    old = number >= 0
    at[old], size[old] = lexicon.offs[number[old]], np.diff(lexicon.offs)[number[old]]
    at[new], size[new] = len(lexicon.flat) + np.cumsum(n) - n, n
    # ids of each different chunk, then of each chunk of the text
    per_word = size[which]
    chunk_ids = flat[X.ragged(at[which], per_word)]
    total = np.concatenate([[0], np.cumsum(per_word)])
    cat, csize = total[first[:-1]], total[first[1:]] - total[first[:-1]]
    pool = np.concatenate([chunk_ids, flat[len(flat) - len(vocabulary.special):]])
    a, m = cat[which_chunk], csize[which_chunk]
    for k, (_, i) in enumerate(vocabulary.special):
        a[kind == i], m[kind == i] = len(chunk_ids) + k, 1
    upto = np.concatenate([[0], np.cumsum(m)])
    return pool[X.ragged(a, m)], np.diff(upto[np.searchsorted(s, offsets)])


def decode_slice(ids: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Each document's text; bytes that are no UTF-8 become replacement characters."""
    lens = np.diff(vocabulary.token_at)[ids]
    flat = vocabulary.token_bytes[X.ragged(vocabulary.token_at[ids], lens)].tobytes()
    upto = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(n)])].tolist()
    return [flat[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:], strict=True)]


_loaded: dict[str, Lexicon] = {}


def _lexicon(name: str) -> Lexicon:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))
    return _loaded[name]


def bpe_encode_decode(docs: DataFrame, path: str, words: int = WORDS, carry: list[str] | None = None) -> DataFrame:
    """Token ids of whole texts, and the texts decoded from them.

    One row per input row: the ``carry`` columns (doc_id), n_tokens, ids (binary:
    little-endian unsigned 32-bit integers), decoded. A null or empty text has no
    ids. Special tokens written in a text become their ids, as in the tokenizer the
    file describes. ``path`` is read on the driver.
    """
    vocabulary = Vocabulary(path)
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    spark = docs.sparkSession
    spark.sparkContext.addFile(write_shared(spark, name, compile_lexicon(docs, vocabulary, words)))
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(data, offsets):
        v = shared.value
        ids, n = encode_slice(data, offsets, v, _lexicon(name))
        raw = ids.astype("<u4")
        off = np.concatenate([[0], np.cumsum(n * 4)])
        binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw.tobytes())])
        return [n, binary.cast(pa.binary()), pa.array(decode_slice(ids, n, v), pa.string())]

    return X.map_docs(docs, [("n_tokens", "bigint"), ("ids", "binary"), ("decoded", "string")], run, carry, SLICE_BYTES)
