"""Frequent itemsets and association rules (survey J1-J6).

Level-wise Apriori over bit masks:

* item counts are filtered by the support in Spark; only frequent items reach
  the driver, sorted by name: the i-th is bit i;
* a basket is the mask of its frequent items, a long, or an array of longs
  beyond 63 items; equal masks collapse to one row with a weight, which is
  written once, so no later level reads the baskets again;
* candidates of level k are joined from the frequent sets of level k - 1
  on the driver (a level's frequent sets number at most the sum of what
  baskets of the support can hold; they are the result itself) and counted by one
  aggregate: a row keeps the candidates it covers, and their weights are summed before the shuffle.

Rules enumerate every split of each frequent itemset into a non-empty
antecedent and consequent (bit masks 1 .. 2^k - 2), with support,
confidence, lift and leverage computed the way the reference library does:
``confidence = s(A u C) / s(A)``, ``lift = confidence / s(C)``.

A ``Lattice`` keeps the itemsets of the lowest support of interest and all their splits as
tables; rules at any higher support, any confidence and any lift are a filter
on them, pushed down to the files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import match_regex
from cohortlens.session import scratch_path

#: Bits of one long; more items take several.
_BITS = 63
#: Candidates counted by one job; a level with more takes several.
_CANDIDATES = 4_096


# J1
def to_baskets(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """0/1 (or boolean) item columns -> ``(key, items)`` with a sorted array
    of the names of the columns that are set; NULL counts as not set."""
    flags = [F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), F.lit(c)) for c in cols]
    items = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return df.select(F.col(key), F.array_sort(items).alias("items"))


def baskets_long(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Long form ``(key, item)``: one row per set item."""
    return to_baskets(df, key, cols).select(key, F.explode("items").alias("item"))


# J2
_ITEMSETS = "itemset array<string>, size int, count long, support double"


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: computed once, and not lost with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mask(items: str, names: Sequence[str]) -> Column:
    """The mask of an array of items: bit i of word i div 63 is set where names[i] is in it."""
    def word(some: Sequence[str]) -> Column:
        # One lookup of every item of the basket, not one of every name.
        bit = F.create_map(*[x for i, n in enumerate(some) for x in (F.lit(n), F.lit(1 << i).cast("long"))])
        return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.coalesce(F.try_element_at(bit, x), F.lit(0).cast("long"))))

    words = [word(names[a:a + _BITS]) for a in range(0, len(names), _BITS)]
    return words[0] if len(words) == 1 else F.array(*words)


def _count(patterns: DataFrame, candidates: Sequence[tuple[int, ...]], wide: bool) -> dict[tuple[int, ...], int]:
    """Weight of the patterns that hold each candidate (a tuple of bit numbers)."""
    out: dict[tuple[int, ...], int] = {}
    for a in range(0, len(candidates), _CANDIDATES):
        some = candidates[a:a + _CANDIDATES]
        if wide:
            asked = F.array(*[F.array(*[F.lit(i) for i in c]) for c in some])
            held = F.transform(asked, lambda c: F.forall(c, lambda i: F.getbit(F.element_at("mask", F.floor(i / _BITS).cast("int") + 1), (i % _BITS).cast("int")) == 1))
        else:
            asked = F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for c in some])
            held = F.transform(asked, lambda c: F.col("mask").bitwiseAND(c) == c)
        hits = F.filter(F.transform(held, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
        rows = patterns.select("w", F.explode(hits).alias("at")).groupBy("at").agg(F.sum("w").alias("count")).collect()
        out.update({some[r["at"]]: r["count"] for r in rows})
    return out


def _join_level(prev: Sequence[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets one item larger whose every subset one item smaller is in ``prev`` (sorted tuples)."""
    known, by_head = set(prev), {}
    for c in sorted(prev):
        by_head.setdefault(c[:-1], []).append(c[-1])
    found = (head + pair for head, tails in by_head.items() for pair in combinations(tails, 2))
    return [c for c in found if all(s in known for s in combinations(c, len(c) - 1))]


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.10, max_len: int | None = 4,
                      items_col: str = "items", n_items_bound: int | None = None) -> DataFrame:
    """All itemsets with ``count / n >= min_support`` and at most ``max_len``
    items. ``baskets`` holds one array of items per basket; ``n`` counts
    every basket, empty ones included; a null item or array adds nothing.
    Returns (itemset, size, count, support), itemsets sorted by name."""
    spark = baskets.sparkSession
    items = F.filter(F.array_distinct(F.col(items_col)), lambda x: x.isNotNull()).alias("items")
    # Baskets collapse before anything else, on their nodes first.
    rows = _written(baskets.select(F.array_sort(F.coalesce(items, F.array().cast("array<string>"))).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("w")), "baskets")
    n = rows.agg(F.sum("w").alias("n")).first()["n"]
    if not n:
        return spark.createDataFrame([], _ITEMSETS)
    enough = F.col("count") / F.lit(float(n)) >= F.lit(min_support)
    single = rows.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("count")).where(enough)
    tallies = sorted((r["item"], r["count"]) for r in single.collect())
    names = [i for i, _ in tallies]
    if n_items_bound is not None and len(names) > n_items_bound:
        raise ValueError("more frequent items than item columns")
    found: dict[tuple[int, ...], int] = {(i,): c for i, (_, c) in enumerate(tallies)}
    level, k, top = list(found), 2, len(names) if max_len is None else min(max_len, len(names))
    if top >= 2:
        patterns = _written(rows.select(_mask("items", names).alias("mask"), "w").groupBy("mask").agg(F.sum("w").alias("w")), "masks")
    while k <= top:
        candidates = _join_level(level)
        if not candidates:
            break
        counts = _count(patterns, candidates, len(names) > _BITS)
        level = [c for c in candidates if counts.get(c, 0) / float(n) >= min_support]
        found.update((c, counts[c]) for c in level)
        k += 1
    out = spark.createDataFrame([([names[i] for i in c], len(c), count) for c, count in found.items()], "itemset array<string>, size int, count long")
    return out.withColumn("support", F.col("count") / F.lit(float(n)))


# J3
_METRICS = ("support", "confidence", "lift", "leverage")


def association_rules(itemsets: DataFrame, metric: str = "lift", min_threshold: float | None = 1.05) -> DataFrame:
    """Every rule A -> C with A, C non-empty, disjoint, A u C frequent; those with ``metric`` of
    ``min_threshold`` or more, all without a threshold.

    Columns: antecedents, consequents (sorted arrays), antecedent_support,
    consequent_support, support, confidence, lift, leverage. Subset
    supports exist by downward closure, so both lookups are inner joins.
    """
    if metric not in _METRICS:
        raise ValueError(f"metric must be one of {_METRICS}")
    sets = itemsets.select("itemset", "size", "support")
    big = sets.where(F.col("size") >= 2)
    masks = big.select("itemset", "support",
                        F.explode(F.expr("sequence(1, shiftleft(1, size) - 2)")).alias("mask"))
    # Bit i of the mask puts the i-th item (0-based) in the antecedent.
    splits = masks.select(F.expr("filter(itemset, (x, i) -> shiftright(mask, i) % 2 = 1)").alias("antecedents"),
                          F.expr("filter(itemset, (x, i) -> shiftright(mask, i) % 2 = 0)").alias("consequents"),
                          "support")
    lookup_a = sets.select(F.col("itemset").alias("antecedents"), F.col("support").alias("antecedent_support"))
    lookup_c = sets.select(F.col("itemset").alias("consequents"), F.col("support").alias("consequent_support"))
    # Small or large, the itemsets' measured size decides how they are joined.
    rules = splits.join(lookup_a, "antecedents").join(lookup_c, "consequents")
    conf = F.col("support") / F.col("antecedent_support")
    rules = rules.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support",
                         conf.alias("confidence"))
    rules = rules.withColumn("lift", F.col("confidence") / F.col("consequent_support")).withColumn(
        "leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
    return rules if min_threshold is None else rules.where(F.col(metric) >= F.lit(min_threshold))


class Lattice:
    """Frequent itemsets and the rules among them, mined once and stored.

    ``mine`` writes the itemsets of ``floor`` support and every rule, with all its metrics, under ``path``.
    Whatever is asked for at that support or a higher one is read from the files: a rule's support is its
    itemset's, and by downward closure its two sides are at least as frequent."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        made = spark.read.parquet(f"{path}/settings").first()
        self.floor, self.max_len = made["floor"], made["max_len"]

    @classmethod
    def mine(cls, baskets: DataFrame, path: str, floor: float = 0.05, max_len: int | None = 4, n_items_bound: int | None = None) -> Lattice:
        spark = baskets.sparkSession
        sets = frequent_itemsets(baskets, floor, max_len, n_items_bound=n_items_bound)
        sets.write.parquet(f"{path}/itemsets")
        stored = spark.read.schema(sets.schema).parquet(f"{path}/itemsets")
        # Sorted by support, so that a threshold skips row groups.
        association_rules(stored, min_threshold=None).sort("support").write.parquet(f"{path}/rules")
        # Written last: without it the lattice is not whole and does not open.
        spark.createDataFrame([(float(floor), max_len)], "floor double, max_len int").write.parquet(f"{path}/settings")
        return cls(spark, path)

    def _checked(self, support: float) -> float:
        if support < self.floor:
            raise ValueError(f"mined at support {self.floor}; {support} needs mining again")
        return support

    def itemsets(self, min_support: float) -> DataFrame:
        self._checked(min_support)
        return self.spark.read.parquet(f"{self.path}/itemsets").where(F.col("support") >= F.lit(min_support))

    def rules(self, min_support: float, min_confidence: float | None = None, min_lift: float | None = None) -> DataFrame:
        """Rules at thresholds of one's own; None leaves a metric free."""
        self._checked(min_support)
        return filter_rules(self.spark.read.parquet(f"{self.path}/rules"), min_support, min_confidence, min_lift)

    def counts(self, supports: Sequence[float], confidences: Sequence[float], lifts: Sequence[float]) -> DataFrame:
        """How many rules each combination of thresholds keeps: (min_support, min_confidence, min_lift, n_rules), in one read."""
        grid = [(float(self._checked(s)), float(c), float(x)) for s in supports for c in confidences for x in lifts]
        rules = self.rules(min(supports), min(confidences), min(lifts))
        kept = [F.count_if((F.col("support") >= s) & (F.col("confidence") >= c) & (F.col("lift") >= x)).alias(f"n{i}") for i, (s, c, x) in enumerate(grid)]
        table = F.array(*[F.struct(F.lit(s).alias("min_support"), F.lit(c).alias("min_confidence"), F.lit(x).alias("min_lift"), F.col(f"n{i}").alias("n_rules"))
                          for i, (s, c, x) in enumerate(grid)])
        return rules.agg(*kept).select(F.inline(table))


# J4
def filter_rules(rules: DataFrame, min_support: float | None = 0.10, min_confidence: float | None = 0.55,
                 min_lift: float | None = 1.10) -> DataFrame:
    cond = F.lit(True)
    if min_support is not None:
        cond = cond & (F.col("support") >= min_support)
    if min_confidence is not None:
        cond = cond & (F.col("confidence") >= min_confidence)
    if min_lift is not None:
        cond = cond & (F.col("lift") >= min_lift)
    return rules.where(cond)


def rule_counts(rules: DataFrame, min_support: float | None = 0.10, min_confidence: float | None = 0.55,
                min_lift: float | None = 1.10) -> DataFrame:
    """One row: all rules and those passing the thresholds, from one scan."""
    cond = F.lit(True)
    if min_support is not None:
        cond = cond & (F.col("support") >= min_support)
    if min_confidence is not None:
        cond = cond & (F.col("confidence") >= min_confidence)
    if min_lift is not None:
        cond = cond & (F.col("lift") >= min_lift)
    return rules.agg(F.count(F.lit(1)).alias("total_rules"), F.count_if(cond).alias("filtered_rules"))


def with_display(rules: DataFrame, sep: str = ", ") -> DataFrame:
    """Add ``antecedents_str`` / ``consequents_str`` (sorted, joined)."""
    return rules.withColumns({"antecedents_str": F.array_join(F.array_sort("antecedents"), sep),
                              "consequents_str": F.array_join(F.array_sort("consequents"), sep)})


_RULE_ORDER = ["lift", "confidence", "support"]


# J5
def top_rules(rules: DataFrame, k: int = 20, by: str = "lift") -> DataFrame:
    """Top-k with display strings; ties broken by the other metrics, then by
    the display strings, so the result is reproducible."""
    order = [by] + [m for m in _RULE_ORDER if m != by]
    r = with_display(rules)
    return (r.orderBy(*[F.col(c).desc() for c in order], "antecedents_str", "consequents_str").limit(k)
            .select("antecedents_str", "consequents_str", "support", "confidence", "lift"))


# J6
def outcome_rules(rules: DataFrame, pattern: str, k: int = 10, by: str = "lift") -> DataFrame:
    """Rules whose consequent matches ``pattern``, top-k."""
    r = with_display(rules)
    return top_rules(r.where(match_regex("consequents_str", pattern)), k, by)
