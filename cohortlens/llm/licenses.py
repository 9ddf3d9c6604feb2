"""License scan: phrases, and an exact set-similarity join with license templates.

DataFrame functions only. Texts are read once: what stays of a text is its number of words and, in order, the
places of the words that stand in some phrase or template. That table is written, and all else comes from it.

Text blocks are overlapping windows of words over the whole text, however it is wrapped: each notice lies inside one,
and none is longer than two notices. A block matches a template when it holds at least ``CONTAINMENT`` of the
template's different words. The join is the prefix-filter join: words are ordered by the number of places they have in
the whole corpus, rarest first (words of no template cannot match and are left out); a match of at least a words shares one
of the first |T| - a + 1 words of the template, the block holds at least a words, and the words
left from the shared one on must suffice. Candidates that pass are compared word by word, and every one that
matches is counted.

A matching block labels its text where the words stand within one place of the notice and, with them, the words by
which the template's label differs from others (mit, nc, 4 0), as they do in the template.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.naming import fold
from cohortlens.llm.scratch import stored

CONTAINMENT = 0.8
# Phrases that license a text, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# License notices, with the labels that the method adds.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows(templates: list[tuple[str, str]], containment: float) -> list[tuple]:
    """(number, label, different words, least overlap) of each template."""
    out = []
    for i, (text, label) in enumerate(templates):
        words = list(dict.fromkeys(text.split()))
        out.append((i, label, words, max(1, math.ceil(containment * len(words) - 1e-9))))
    return out


def place_words(templates: list[tuple[str, str]], containment: float) -> list[int]:
    """Greatest words of a place of each notice, with about as many added words as may be missing; blocks start as far apart as the longest."""
    return [math.ceil(len(text.split()) * len(words) / least) for (text, _), (_, _, words, least) in zip(templates, template_rows(templates, containment))]


def separating(templates: list[tuple[str, str]], containment: float) -> list[list[str]]:
    """Regular expressions that a block (its words, each with a space on either side) must all match, for each template.

    Words of the template that its label names separate it from others; those that
    adjoin in the template must adjoin in the block, and no such word of a sibling
    (a template close enough to match the same text) may follow. So "cc by 4 0" is not
    found in "cc by nc 4 0", nor "cc by nc" in "cc by nc sa". A single such word
    must adjoin a word of the template on its side, so the German "mit" is no name.
    """
    kinds = template_rows(templates, containment)
    named = [[w for w in words if w in re.split("[^0-9a-z]+", label.lower())] for _, label, words, _ in kinds]
    out = []
    for i, _, words, least in kinds:
        siblings = [j for j, _, ws, need in kinds if j != i and len(set(ws) & set(words)) >= min(need, least)]
        others = sorted({w for j in siblings for w in named[j]} - set(words))
        stop = f"(?! (?:{'|'.join(others)}) )" if others else ""
        text, found = templates[i][0].split(), []
        k = 0
        while k < len(text):
            n = 0
            while k + n < len(text) and text[k + n] in named[i]:
                n += 1
            if n:
                run = " " + "  ".join(text[k:k + n]) + " "
                if n == 1:  # may be a plain word elsewhere ("mit"): beside a word that stands on that side in the template
                    run = "|".join([f" (?:{'|'.join(text[:k])}) {run}"] * (k > 0) + [f"{run} (?:{'|'.join(text[k + 1:])}) "] * (k + 1 < len(text)))
                found.append(f"(?:{run}){stop}")
            k += n + 1
        out.append(list(dict.fromkeys(found)))
    return out


def _table(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _indices(array: str) -> Column:
    """0 .. size - 1; none for an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def word_places(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(key, doc_id, n_words, hits): a number for each row, and its places i of words w (by their number) of the vocabulary."""
    words = F.array_remove(F.split(fold(docs["text"]), _SEPARATORS), "")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", words.alias("words"))
    number = F.create_map(*[x for i, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(i))])
    known = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
    return rows.select("key", "doc_id", F.size("words").alias("n_words"), F.transform(known, lambda h: F.struct(h["i"].alias("i"), F.element_at(number, h["w"]).alias("w"))).alias("hits"))


def _phrase_places(rows: DataFrame, phrases: list[tuple[str, str]], vocabulary: list[str]) -> DataFrame:
    """(key, doc_id, n_words, n_base, first_word, last_word, base): all places where a phrase's words stand in a row."""
    hit = lambda j, k: F.get(F.col("hits"), j + k)

    def places(phrase: str) -> Column:
        ids = [vocabulary.index(w) for w in phrase.split()]
        follows = lambda j, k: (hit(j, k)["w"] == ids[k]) & (hit(j, k)["i"] == hit(j, 0)["i"] + k)
        here = F.filter(_indices("hits"), lambda j: reduce(and_, [follows(j, k) for k in range(len(ids))]))
        return F.transform(here, lambda j: hit(j, 0)["i"])

    found = [F.struct(F.lit(label).alias("label"), places(p).alias("at")) for p, label in phrases]
    rows = rows.select("key", "doc_id", "n_words", F.array(*found).alias("found"))
    rows = rows.withColumn("at", F.flatten(F.transform("found", lambda f: f["at"])))
    labels = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda f: F.size(f["at"]) > 0), lambda f: f["label"])))
    return rows.select("key", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.size("at").cast("bigint").alias("n_base"), F.array_min("at").cast("bigint").alias("first_word"),
                       F.array_max("at").cast("bigint").alias("last_word"), labels.alias("base"))


def template_matches(rows: DataFrame, vocabulary: list[str], templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(key, block, template, label, shared, held, size): every block and template of at least that containment, once.

    ``rows`` are those of ``word_places``. ``shared`` counts the template's words in the block, ``held`` the
    most of them within one place of the notice beside the separating words (null where there is none).
    """
    spark = rows.sparkSession
    kinds, places, needs = template_rows(templates, containment), place_words(templates, containment), separating(templates, containment)
    step = max(places)
    number = {w: i for i, w in enumerate(vocabulary)}
    used = sorted({number[w] for _, _, words, _ in kinds for w in words})
    counts = rows.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # a row per word at most
    often = {r["w"]: r["n"] for r in counts}
    order = sorted(used, key=lambda w: (often.get(w, 0), vocabulary[w]))
    rank = {w: r for r, w in enumerate(order)}
    prefix = []
    for i, label, words, least in kinds:
        ranked = sorted(rank[number[w]] for w in words)
        prefix += [(r, i, label, ranked, words, least, k, needs[i], places[i]) for k, r in enumerate(ranked[:len(ranked) - least + 1])]
    small = spark.createDataFrame(prefix, "r int, template int, label string, template_ranks array<int>, template_words array<string>, least int, k int, needs array<string>, place int")
    rare = sorted({order[p[0]] for p in prefix})
    ranks_of = _table([rank.get(w, -1) for w in range(len(vocabulary))], "int")
    chunk = lambda h: F.floor(h["i"] / step).cast("int")

    # Of each chunk of ``step`` places with a word of some prefix, the first such word, with all known words of the two blocks around.
    hit = lambda j: F.get(F.col("hits"), j)
    some = rows.withColumn("at", F.filter(_indices("hits"), lambda j: hit(j)["w"].isin(rare))).where(F.size("at") > 0)
    some = some.withColumn("at", F.filter(F.col("at"), lambda j, t: (t == 0) | (chunk(hit(j)) != chunk(hit(F.get(F.col("at"), t - 1))))))
    around = F.transform("at", lambda j: F.struct(chunk(hit(j)).alias("chunk"), F.slice("hits", F.greatest(F.lit(0), j - 2 * step) + 1, F.lit(4 * step + 1)).alias("around")))
    last = F.greatest(F.lit(0), F.ceil(F.col("n_words") / step).cast("int") - 2)
    chunks = some.select("key", "n_words", last.alias("last"), F.explode(around).alias("c")).select("key", "n_words", "last", "c.*")
    # Block b is chunks b and b + 1; the second brings it only where the first has no such word.
    here = F.array(F.col("chunk"), F.when(~F.exists("around", lambda h: (chunk(h) == F.col("chunk") - 1) & h["w"].isin(rare)), F.col("chunk") - 1))
    blocks = chunks.select("key", "n_words", "last", "around", F.explode(F.filter(here, lambda b: (b >= 0) & (b <= F.col("last")))).alias("block"))
    inside = F.filter("around", lambda h: (h["i"] >= F.col("block") * step) & (h["i"] < (F.col("block") + 2) * step))
    ranks = F.array_sort(F.array_distinct(F.filter(F.transform(inside, lambda h: F.get(ranks_of, h["w"])), lambda r: r >= 0)))
    blocks = blocks.withColumn("ranks", ranks)
    tokens = blocks.select("*", F.posexplode("ranks").alias("j", "r"))
    pairs = (tokens.join(F.broadcast(small), "r").where(F.size("ranks") >= F.col("least"))
             .where(1 + F.least(F.size("template_ranks") - F.col("k") - 1, F.size("ranks") - F.col("j") - 1) + F.least("k", "j") >= F.col("least")))
    pairs = pairs.withColumn("common", F.array_intersect("ranks", "template_ranks"))
    # A pair is kept at the first word it shares, so it comes once.
    near = pairs.where((F.size("common") >= F.col("least")) & (F.array_min("common") == F.col("r")))
    names = _table(vocabulary, "string")
    end = F.least(F.col("n_words"), (F.col("block") + 2) * step + 1)
    known = F.map_from_entries(F.transform(F.filter("around", lambda h: (h["i"] >= F.col("block") * step) & (h["i"] < end)), lambda h: F.struct(h["i"], h["w"])))
    near = near.withColumn("known", known)
    text = F.transform(F.sequence(F.col("block") * step, end - 1), lambda i: F.coalesce(F.get(names, F.try_element_at("known", i)), F.lit("?")))
    near = near.withColumn("text", text)
    window = lambda i, n: F.slice("text", i + 1, F.col("place") + n)
    norm = lambda i: F.concat(F.lit(" "), F.array_join(window(i, 1), "  "), F.lit(" "))
    starts = F.sequence(F.lit(0), F.when(F.col("block") == F.col("last"), F.size("text") - 1).otherwise(F.lit(step - 1)))
    held = F.transform(starts, lambda i: F.when(F.forall("needs", lambda x: F.rlike(norm(i), x)), F.size(F.array_intersect(window(i, 0), "template_words"))))
    held = F.array_max(F.filter(held, lambda h: h >= F.col("least")))
    return near.select("key", "block", "template", "label", F.size("common").alias("shared"), held.alias("held"), F.size("template_ranks").alias("size"))


def license_scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
                 containment: float = CONTAINMENT) -> DataFrame:
    """Licenses of every text.

    One row per input row: doc_id, n_words, n_base (places of all phrases), first_word and
    last_word (their least and greatest start, null without any), base_labels,
    labels (with those of matching templates), both distinct, sorted and joined by
    commas, score: 1 with a phrase, else the best containment of a labelling place,
    else 0, and n_matches: the pairs of a block and a template that meet the containment, labelling or not. A null text is empty.
    Rows that repeat a doc_id, or have none, keep their own labels. Work is in proportion to a text's length, whatever it
    repeats. ``templates`` and ``phrases`` are parameters of a few hundred words, which bounds what is collected and broadcast.
    """
    vocabulary = sorted({w for text, _ in [*phrases, *templates] for w in text.split()})
    rows = stored(word_places(docs, vocabulary), "license-words")
    base = _phrase_places(rows, phrases, vocabulary)
    good = F.col("held").isNotNull()
    matched = template_matches(rows, vocabulary, templates, containment).groupBy("key").agg(
        F.count("*").alias("n_matches"), F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max(F.when(good, F.col("held") / F.col("size"))).alias("best"))
    none = F.array().cast("array<string>")
    return base.join(matched, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_matches", F.lit(0).cast("bigint")).alias("n_matches"))
