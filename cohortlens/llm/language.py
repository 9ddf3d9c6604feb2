"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams (1 to 3 bytes of lower-cased words
padded with a space) of a language, by rank. A document's own most frequent
n-grams are ranked likewise; its out-of-place distance to a language sums
the rank differences, an n-gram that the profile lacks counting as the
profile's length. The language at the smallest distance is predicted.

Profiles are counted over all training texts: each task adds up its counts,
Spark adds up the tasks', and only the ranked heads reach the driver. Of more than
``MAX_LANGUAGES`` languages nothing does: their profiles are written to the shared folder in
blocks, and tasks compare each slice of documents with one block after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.scratch import filesystem, keep, shared_path

#: N-grams in a profile.
TOP = 300
#: Languages whose profiles are broadcast; those of more are stored, about as many in a block.
MAX_LANGUAGES = 2000
#: Text whose n-grams are counted at once; a slice takes some 50 times as much memory.
SLICE_BYTES = 1 << 20
#: Languages that a slice of documents is compared with at once.
AT_ONCE = 32
UNKNOWN = "und"
_NON_LETTER = np.array([b < 0x80 and not (0x61 <= b <= 0x7A) for b in range(256)])
_SALTS = 16


def held_out() -> Column:
    """True for documents that no model may learn from (a null doc_id may be learnt from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram code, count), sorted; the code holds the n-gram's bytes.

    Each letter is the middle of one trigram. The trigrams are counted, and the
    shorter n-grams follow from the few distinct ones: the middle byte, the last
    two, and the first two where a word begins.
    """
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offsets, _NON_LETTER)
    out, s, e = X.spaced(data, starts, ends)
    c = np.concatenate([[np.uint8(0x20)], out]).astype(np.uint32)  # " w1 w2 ... wn "
    at = X.ragged(s, e - s) + 1  # the letters
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.add.reduceat(np.concatenate([ends - starts, [0]]), first[:-1]) * (np.diff(first) > 0)) if len(first) > 1 else np.zeros(0, np.uint64)
    key = (doc << np.uint64(24)) | ((c[at - 1] << np.uint32(16)) | (c[at] << np.uint32(8)) | c[at + 1]).astype(np.uint64)
    key, n = _added(key, np.ones(len(key), np.int64))
    doc, code = key & ~np.uint64(0xFFFFFF), key & np.uint64(0xFFFFFF)
    head = (code >> np.uint64(16)) == 0x20
    key, n = _added(np.concatenate([key, doc | ((code >> np.uint64(8)) & np.uint64(0xFF)), doc | (code & np.uint64(0xFFFF)), (doc | (code >> np.uint64(8)))[head]]),
                    np.concatenate([n, n, n, n[head]]))
    return (key >> np.uint64(24)).astype(np.int64), (key & np.uint64(0xFFFFFF)).astype(np.int64), n


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their n."""
    if not len(key):
        return key, n
    width = int(n.max()).bit_length()
    if int(n.max()) == 1:
        key, n = np.sort(key), None
    elif int(key.max()).bit_length() + width <= 64:
        both = np.sort((key << np.uint64(width)) | n.astype(np.uint64))
        key, n = both >> np.uint64(width), (both & np.uint64((1 << width) - 1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.diff(np.concatenate([at, [len(key)]])) if n is None else np.add.reduceat(n, at)


def _ranked(doc: np.ndarray, code: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's ``top`` codes by falling count, then code: (document, code, rank)."""
    if not len(doc):
        return doc, code, n
    most, width = int(n.max()), int(n.max()).bit_length()
    if int(doc.max()).bit_length() + width <= 40:
        key = np.sort((((doc.astype(np.uint64) << np.uint64(width)) | (most - n).astype(np.uint64)) << np.uint64(24)) | code.astype(np.uint64))
        code = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        doc = (key >> np.uint64(24 + width)).astype(np.int64)
    else:
        order = np.lexsort((code, -n, doc))
        doc, code = doc[order].astype(np.int64), code[order].astype(np.int64)
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    ok = rank < top
    return doc[ok], code[ok], rank[ok]


class StoredProfiles:
    """Profiles of very many languages: the files of blocks of them."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def __len__(self) -> int:
        return len(self.paths)

    @staticmethod
    def read(path: str) -> dict[str, list[int]]:
        where, at = filesystem(path)
        t = pq.read_table(at, filesystem=where, columns=["label", "gram", "r"], partitioning=None).sort_by([("label", "ascending"), ("r", "ascending")])
        out: dict[str, list[int]] = {}
        for name, gram in zip(t["label"].to_pylist(), t["gram"].to_pylist(), strict=True):
            out.setdefault(name, []).append(gram)
        return out


def train(docs: DataFrame, label: str = "lang", top: int = TOP) -> dict[str, list[int]] | StoredProfiles:
    """Profiles {language: n-gram codes by rank} from all rows of ``docs`` with a label and a text, or, of more than
    ``MAX_LANGUAGES``, where they are stored."""
    def run(batches):
        names: dict[str, int] = {}
        key, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in X.slices(batch, SLICE_BYTES):
                lang = np.array([names.setdefault(x, len(names)) for x in part.column("label").to_pylist()], np.uint64)
                doc, code, n = _counts(*X.buffer(part.column("text")))
                k, n = _added((lang[doc] << np.uint64(24)) | code.astype(np.uint64), n)
                key, total = _added(np.concatenate([key, k]), np.concatenate([total, n]))
        by = list(names)
        yield pa.RecordBatch.from_arrays([
            pa.array([by[i] for i in (key >> np.uint64(24)).tolist()], pa.string()), pa.array((key & np.uint64(0xFFFFFF)).astype(np.int64)), pa.array(total)], ["label", "gram", "n"])

    rows = docs.select(F.col(label).cast("string").alias("label"), "text").where("label is not null and text is not null")
    counts = rows.mapInArrow(run, "label string, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = counts.withColumn("salt", F.col("gram") % _SALTS)
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("label", "salt").orderBy(*order))).where(F.col("r") <= top)
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("r") <= top)
    best = keep(best.select("label", "gram", "r"))
    rows = best.limit(MAX_LANGUAGES * top + 1).collect()
    if len(rows) > MAX_LANGUAGES * top:
        n = -(-2 * best.select("label").distinct().count() // MAX_LANGUAGES)
        path = shared_path(docs.sparkSession, "profiles")
        best.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(n))).repartition(n, "block").write.partitionBy("block").parquet(path)
        found = docs.sparkSession.read.parquet(path).select("block").distinct().sort("block").collect()
        return StoredProfiles([f"{path}/block={r[0]}" for r in found])
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["r"])):
        profiles.setdefault(r["label"], []).append(r["gram"])
    return profiles


def _distances(doc: np.ndarray, code: np.ndarray, own: np.ndarray, profiles: list[list[int]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x profiles) out-of-place distances of ranked n-grams, and each document's number of them."""
    known = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles]))
    rank = np.full((len(known) + 1, len(profiles)), -1, np.int32)
    for j, p in enumerate(profiles):
        rank[np.searchsorted(known, p), j] = np.arange(len(p))
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    at = np.where(known[at] == code, at, len(known))
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    distance, step, edge = np.zeros((len(first), len(profiles)), np.int64), 1 << 16, np.append(first, len(doc))
    a = 0
    while a < len(first):  # documents whose n-grams are about ``step``, one at least
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + step, "right")) - 1)
        rows = slice(int(edge[a]), int(edge[b]))
        r = rank[at[rows]]
        out = np.where(r < 0, np.int32(top), np.abs(r - own[rows, None].astype(np.int32)))
        distance[a:b] = np.add.reduceat(out, first[a:b] - edge[a], axis=0, dtype=np.int64)
        a = b
    return distance, np.diff(edge)


def classify(data: np.ndarray, offsets: np.ndarray, blocks, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Each document's language (``und`` without letters, or without a language to choose) and its score.

    ``blocks`` gives profiles in parts, in any order: of languages at one distance the name that sorts first is chosen."""
    n = len(offsets) - 1
    name, score = np.full(n, UNKNOWN, object), np.zeros(n)
    letters = has_letter(data, offsets)
    doc, code, own = _ranked(*_counts(data, offsets), top)
    if not len(doc):
        return name, score
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    least, best = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), "", object)
    size = np.diff(np.append(first, len(doc)))
    for profiles in blocks:
        names = sorted(profiles)
        for a in range(0, len(names), AT_ONCE):
            some = names[a:a + AT_ONCE]
            distance, _ = _distances(doc, code, own, [profiles[x] for x in some], top)
            j = distance.argmin(axis=1)
            d, x = distance[np.arange(len(j)), j], np.array(some, object)[j]
            better = (d < least) | (d == least) & (x < best)
            least, best = np.where(better, d, least), np.where(better, x, best)
    chosen = letters[doc[first]] & (least < np.iinfo(np.int64).max)
    at = doc[first][chosen]
    name[at], score[at] = best[chosen], 1 - least[chosen] / (size[chosen] * top)
    return name, score


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has a letter of any script."""
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum((X.LOWER[data] >= 0x61) & (X.LOWER[data] <= 0x7A), out=ascii_letter[1:])
    yes = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(~yes).tolist():
        yes[d] = any(c.isalpha() for c in data[offsets[d]:offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return yes


def identify(docs: DataFrame, profiles: dict[str, list[int]] | StoredProfiles, top: int = TOP, carry: list[str] | None = None) -> DataFrame:
    """Predict each row's language from its whole text.

    One row per input row: the ``carry`` columns (doc_id), lang_pred and score
    (1 - distance / largest distance). lang_pred is ``und`` and score 0 if the
    text is null or has no letter, or nothing was learnt. Ties go to the name
    that sorts first.
    """
    stored = profiles.paths if isinstance(profiles, StoredProfiles) else None
    shared = None if stored else docs.sparkSession.sparkContext.broadcast(profiles)

    def run(data, offsets):
        blocks = (StoredProfiles.read(p) for p in stored) if stored else [shared.value]
        names, score = classify(data, offsets, blocks, top)
        return [pa.array(names.tolist(), pa.string()), score]

    return X.map_docs(docs, [("lang_pred", "string"), ("score", "double")], run, carry, SLICE_BYTES)
