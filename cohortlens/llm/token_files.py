"""Token files: independent zstandard frames with a trailing seek table.

A file holds documents in ascending doc_id order. Each frame is compressed on
its own and holds whole documents: their number, ids, lengths and token ids.
After the frames come two skippable frames: a directory (per frame the first
and last document and its number of documents and tokens) and the seek table in
zstandard's seekable format (compressed size, decompressed size and checksum of
every frame), found from the end of the file. A reader of some documents opens
only the frames that may hold them, and checks each frame it opens.

Ranges of doc_id are written by one task each, to a file name of its own
attempt; the manifest, kept in the shared folder, names the files that count, so
a task that is run again leaves no trace in the result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.scratch import filesystem, keep, shared_path

#: Token ids after which a frame ends.
FRAME = 1 << 17
#: Different pieces of text that a worker remembers.
MEMORY = 800_000
# Fixed values of the zstandard formats.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_OWN = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_NULL = -(1 << 63)


def _digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents, given in order, to one file."""

    def __init__(self, out, frame: int = FRAME, level: int = 3):
        self.out, self.frame = out, frame
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.seek, self.directory = [], []
        self.docs, self.lens, self.ids, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], np.array([len(ids)]), ids)

    def extend(self, doc_ids: list, lens: np.ndarray, ids: np.ndarray) -> None:
        """Documents in a row, their token ids concatenated; a frame ends with the document that fills it."""
        upto, a = np.cumsum(lens), 0
        while a < len(doc_ids):
            before = int(upto[a - 1]) if a else 0
            b = min(len(doc_ids), int(np.searchsorted(upto, before + self.frame - self.held)) + 1)
            self.docs += doc_ids[a:b]
            self.lens.append(lens[a:b])
            self.ids.append(ids[before:int(upto[b - 1])])
            self.held += int(upto[b - 1]) - before
            if self.held >= self.frame:
                self.flush()
            a = b

    def flush(self) -> None:
        if not self.docs:
            return
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([_NULL if d is None else d for d in self.docs], "<i8")
        body = b"".join([struct.pack("<I", len(docs)), known.tobytes(), docs.tobytes(), np.concatenate(self.lens).astype("<u8").tobytes(),
                         *(np.ascontiguousarray(i, "<u4").data for i in self.ids)])
        packed = self.zstd.compress(body)
        self.out.write(packed)
        self.seek.append((len(packed), len(body), _digest(body)))
        self.directory.append((int(docs.min()), int(docs.max()), len(docs), self.held))
        self.docs, self.lens, self.ids, self.held = [], [], [], 0

    def close(self) -> None:
        self.flush()
        own = b"".join(struct.pack("<qqQQ", *d) for d in self.directory)
        self.out.write(struct.pack("<II", SKIPPABLE_OWN, len(own)) + own)
        table = b"".join(struct.pack("<III", *s) for s in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class Reader:
    """Reads all documents of a file, or those asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.seek = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        own = self._at(size - 17 - 12 * n - 32 * n, 32 * n)
        self.directory = [struct.unpack_from("<qqQQ", own, 32 * i) for i in range(n)]
        self.offset = np.concatenate([[0], np.cumsum([s[0] for s in self.seek])]).astype(np.int64).tolist()
        self.opened = 0

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> tuple[list, np.ndarray, np.ndarray]:
        """(doc_ids, lengths, token ids) of a frame, its size and checksum verified."""
        packed, size, check = self.seek[i]
        body = zstandard.ZstdDecompressor().decompress(self._at(self.offset[i], packed), max_output_size=size)
        self.opened += 1
        if len(body) != size or _digest(body) != check:
            raise ValueError(f"frame {i} is damaged")
        n = struct.unpack_from("<I", body)[0]
        known = np.frombuffer(body, np.uint8, n, 4)
        docs = np.frombuffer(body, "<i8", n, 4 + n).tolist()
        lens = np.frombuffer(body, "<u8", n, 4 + 9 * n).astype(np.int64)
        return [d if k else None for d, k in zip(docs, known, strict=True)], lens, np.frombuffer(body, "<u4", offset=4 + 17 * n)

    def frames(self) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        for i in range(len(self.seek)):
            yield self.frame(i)

    def documents(self, wanted: set) -> Iterator[tuple[int | None, np.ndarray]]:
        """The wanted documents; frames whose range holds none of them stay closed."""
        keys = np.sort([_NULL if d is None else d for d in wanted])
        for i, (lo, hi, _, _) in enumerate(self.directory):
            if np.searchsorted(keys, lo) < np.searchsorted(keys, hi, "right"):
                docs, lens, ids = self.frame(i)
                at = np.concatenate([[0], np.cumsum(lens)])
                for k, d in enumerate(docs):
                    if d in wanted:
                        yield d, ids[at[k]:at[k + 1]]


#: What a byte is to the tokenizer: 0 white space, 1 letter, 2 digit, 3 other sign, 4 part of a character beyond ASCII (or not looked into).
_KIND = np.full(256, 4, np.uint8)
_KIND[:0x80] = 3
_KIND[0x1C:0x20] = 4
_KIND[X.SPACE] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
#: First bytes of two-byte characters that are all letters, but for three.
_LETTER_LEAD = np.zeros(256, bool)
_LETTER_LEAD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ASCII folded, start and end of each piece, first piece of each document).

    Texts are cut at white space, and inside at places where the tokenizer (NFC, lower case; runs of letters, single
    digits, runs of other signs) begins a new word whatever stands around: between ASCII characters of different
    kinds, before a digit, and between a sign or digit and a letter of the Latin or Cyrillic blocks. A cut stands before a
    character that joins no earlier one, so no normalisation spans it. Not cut inside are chunks with an apostrophe
    (contractions) or a special token's beginning; the latter keep their capitals too.
    """
    starts, ends, _ = X.words(data, offsets, X.SPACE)
    if not len(starts):
        return data, starts, ends, np.zeros(len(offsets), np.int64)
    special = np.zeros(len(data), bool)
    special[:-1] = (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    marks = np.concatenate([[0], np.cumsum(special | (data == 0x27))])
    whole = marks[ends] > marks[starts]
    kind = _KIND[data]
    lead = _LETTER_LEAD[data]
    pair = np.zeros(len(data), np.uint16)
    pair[:-1] = data[:-1].astype(np.uint16) << 8 | data[1:]
    lead &= (pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)  # two signs, and the capital whose lower case is two characters
    before, here = kind[:-1], kind[1:]
    ascii_both = (before != 4) & (here != 4)
    after_letter = np.zeros(len(data) - 1, bool)
    after_letter[1:] = lead[:-2]
    cut = ascii_both & ((before != here) | (before == 2)) | (here == 2) | after_letter & (here == 3) | lead[1:] & ((before == 2) | (before == 3))
    cut &= (before != 0) & (here != 0)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[~whole]] += 1
    inside[ends[~whole]] -= 1
    cut &= np.cumsum(inside, dtype=np.int8)[1:-1] > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cuts = np.flatnonzero(cut & ~edge[1:-1]) + 1
    fold = X.LOWER[data]
    if special.any():
        marks = np.concatenate([[0], np.cumsum(special)])
        kept = marks[ends] > marks[starts]
        at = X.ragged(starts[kept], (ends - starts)[kept])
        fold[at] = data[at]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return fold, starts, ends, np.searchsorted(starts, offsets)


class ChunkEncoder:
    """Encodes texts piece by piece (see ``pieces``), remembering different pieces.

    For tokenizers that drop white space, fold case and split words as the one this is used with: no token
    spans a cut, so a text's ids are those of its pieces in a row.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        comma = self.tokenizer.encode("a,b", add_special_tokens=False).ids
        self.sign = comma[1] if len(comma) == 3 else None
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, new: list[bytes]) -> None:
        # Words of letters are encoded many in a text, parted by a sign that is one token of its own and in no such word.
        words = [c for c in new if c.isalpha()] if self.sign is not None else []
        rest = [c for c in new if not c.isalpha()] if words else new
        if words:
            texts = [(b",".join(words[a:a + 512]) + b",").decode() for a in range(0, len(words), 512)]
            flat = np.concatenate([np.array(x.ids, np.uint32) for x in self.encode(texts, add_special_tokens=False)])
            end = np.flatnonzero(flat == self.sign)
            self._remember(words, np.delete(flat, end), np.diff(end, prepend=-1) - 1)
        for a in range(0, len(rest), 20_000):
            some = rest[a:a + 20_000]
            got = [x.ids for x in self.encode([c.decode() for c in some], add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self._remember(some, np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens)

    def _remember(self, names: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        need, known = self.used + len(ids), len(self.at)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        if known + len(names) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(names), len(self.starts)), np.int64)])
        self.flat[self.used:need] = ids
        self.starts[known + 1:known + len(names) + 1] = self.used + np.cumsum(lens)
        self.at.update(zip(names, range(known, known + len(names)), strict=True))
        self.used = need

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, concatenated, and each document's number of them."""
        if len(self.at) > MEMORY:
            self.forget()
        fold, s, e, first = pieces(data, offsets)
        chunks = X.word_array(fold, s, e).dictionary_encode()
        names = chunks.dictionary.to_pylist()
        self._learn([c for c in names if c not in self.at])
        rows = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))
        which = rows[chunks.indices.to_numpy()]
        lens = self.starts[which + 1] - self.starts[which]
        ids = self.flat[X.ragged(self.starts[which], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(upto[first])


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(name: str, spec: str) -> ChunkEncoder:
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = ChunkEncoder(spec)
    return _encoders[name]


_MANIFEST = "part int, file string, frames int, docs bigint, tokens bigint"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode every text (null: empty), append ``end_id`` and write the files under ``folder``.

    ``tokenizer`` is the path, on the driver, of a tokenizer file that drops white
    space. Returns the manifest: one row per file with part (files in order of
    part hold ascending doc_ids, null before all), file, frames, docs and tokens.
    Rows that share a doc_id are all written, ordered by text. An empty table
    writes no file.
    """
    spec = open(tokenizer, encoding="utf-8").read()
    name = f"{os.path.basename(tokenizer)}:{_digest(spec.encode())}"
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encode = TaskContext.get().partitionId(), None, None
        n_docs = n_tokens = 0
        for batch in batches:
            for some in X.slices(batch):
                if writer is None:
                    encode = _encoder(name, shared.value)
                    where, at = filesystem(folder)
                    where.create_dir(at)
                    file = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                    writer = Writer(where.open_output_stream(f"{at}/{file}", compression=None))
                ids, n = encode(*X.buffer(some.column("text")))
                writer.extend(some.column("doc_id").to_pylist(), n + 1, np.insert(ids, np.cumsum(n), np.uint32(end_id)))
                n_docs += some.num_rows
                n_tokens += len(ids) + some.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([len(writer.seek)], pa.int32()), pa.array([n_docs]), pa.array([n_tokens])],
                                             ["part", "file", "frames", "docs", "tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return keep(ranged.mapInArrow(run, _MANIFEST))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers. The driver
    reads the manifest, one row per file, to add up where each file starts.
    """
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["file"], start))
        start += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = filesystem(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with where.open_input_file(f"{at}/{file}") as source:
                    for docs, lens, ids in Reader(source).frames():
                        upto = np.concatenate([[0], np.cumsum(lens)])
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + upto[:-1]), pa.array(lens), pa.array(crc, pa.int64())],
                                                         ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(upto[-1])

    listed = spark.createDataFrame(files, "file string, start bigint").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and read them back (see the two functions)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, tokenizer, end_id, folder), folder)
