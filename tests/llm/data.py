"""Small frames with the awkward cases, and brute-force versions of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def spaced_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rng: random.Random, n: int, voc: int = 400) -> str:
    return " ".join(f"w{rng.randrange(voc)}é" if rng.random() < .1 else f"w{rng.randrange(voc)}" for _ in range(n))


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, periodic texts, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 70), []
    for i in range(n):
        kind = i % 12
        if kind == 0:
            t = None
        elif kind == 1:
            t = ["", "  \n", "?!", "One two"][i // 12 % 4]
        elif kind in (2, 3):
            t = rows[4][1] if len(rows) > 4 else prose(rng, 120)
        elif kind == 4:
            t = (rows[4][1] if len(rows) > 4 else prose(rng, 130)) + " End."
        elif kind in (5, 6):
            t = prose(rng, rng.randrange(60)) + "\n" + passage + "  " + prose(rng, rng.randrange(60))
        elif kind == 7:
            t = "ab cd " * rng.randrange(1, 150)
        elif kind == 8:
            t = "x" * rng.randrange(1, 1500)
        else:
            t = prose(rng, rng.choice([5, 30, 300]))
        rows.append((i + 1, t, ["en", "de", None][i % 3], "s", None))
    rows.append((n + 1, prose(rng, 9000), "en", None, 1))
    rng.shuffle(rows)
    return rows


def brute_substring(rows, window=20):
    """{doc_id: (n_words, n_removed, sha of the kept words)} for distinct doc_ids."""
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = spaced_words(t), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def brute_suffix(rows, window=400):
    count: dict[bytes, int] = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            count[b[s:s + window]] = count.get(b[s:s + window], 0) + 1
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if count[b[s:s + window]] > 1:
                gone[s:s + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def fingerprint(t, shingle=3) -> int:
    w = spaced_words(lower(t or ""))
    s = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(nodes, linked) -> dict:
    """Smallest member reachable, by union-find over all pairs."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def brute_decontaminate(rows, items, window=13):
    wins: dict[tuple, set] = {}
    for i, t in items:
        w = plain_words(t)
        m = min(window, len(w))
        for s in range(len(w) - m + 1) if m else ():
            wins.setdefault(tuple(w[s:s + m]), set()).add(i)
    lengths, out = {len(k) for k in wins}, {}
    for d, t, *_ in rows:
        w, hit, got = plain_words(t), set(), set()
        for m in lengths:
            for s in range(len(w) - m + 1):
                k = tuple(w[s:s + m])
                if k in wins:
                    got |= wins[k]
                    hit.update(range(s, s + m))
        ids = sorted(str(x) for x in got)
        out[d] = (len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w))
    return out
