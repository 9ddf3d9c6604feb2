"""Registered association-rule queries (survey J1-J6, A4) with oracle SQL.

The oracle counts itemsets by brute force (self-joins of the long basket
table up to four items) and splits them with list lambdas, an algorithm
unrelated to the level-wise one under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import rules as ar
from cohortlens.plans.oracle import with_basket
from cohortlens.plans.registry import query, r6
from cohortlens.session import scratch_path
from cohortlens.sources import io
from cohortlens.sources.views import BASKET_ITEMS, basket

MIN_SUPPORT = 0.10
MAX_LEN = 4
RULE_MIN = 1.05
#: The lowest support that thresholds may be set to.
FLOOR = 0.05
FILTER = dict(min_support=0.10, min_confidence=0.55, min_lift=1.10)
OUTCOME_PATTERN = "bulk|many"


_mined: dict = {}


def _lattice(spark, root) -> ar.Lattice:
    """The lattice of a folder's baskets, mined once per application at the lowest support that is asked for."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _mined:
        b = ar.to_baskets(basket(spark, root), "id", BASKET_ITEMS)
        _mined[key] = ar.Lattice.mine(b, scratch_path(spark, "lattice"), FLOOR, MAX_LEN, n_items_bound=len(BASKET_ITEMS))
    return _mined[key]


def _rules(spark, root):
    return _lattice(spark, root).rules(MIN_SUPPORT, min_lift=RULE_MIN)


# Baskets collapse to bit masks (bit i: the i-th item by name); every mask of at
# most four items is counted against the weighted masks.
_NAMES = sorted(BASKET_ITEMS)
_MASK = " + ".join(f"(CASE WHEN {c} = 1 THEN {1 << i} ELSE 0 END)" for i, c in enumerate(_NAMES))
_LIST = "[" + ", ".join(f"'{c}'" for c in _NAMES) + "]"
_FI_SQL = f""", pat AS MATERIALIZED (SELECT mask, count(*) AS w FROM (SELECT {_MASK} AS mask FROM basket) GROUP BY mask),
nb AS (SELECT sum(w) AS n FROM pat),
fm AS MATERIALIZED (SELECT m, bit_count(m) AS size, CAST(sum(w) AS BIGINT) AS c, sum(w) / any_value(n) AS support
       FROM (SELECT unnest(range(1, {1 << len(_NAMES)})) AS m) JOIN pat ON (pat.mask & m) = m, nb
       WHERE bit_count(m) <= 4 GROUP BY m HAVING sum(w) / any_value(n) >= 0.1),
fi AS (SELECT m, list_filter({_LIST}, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS itemset, CAST(size AS INTEGER) AS size, c, support FROM fm)"""

_RULES_SQL = _FI_SQL + """,
ru AS (SELECT array_to_string(a.itemset, ', ') AS antecedents_str, array_to_string(c.itemset, ', ') AS consequents_str,
              a.support AS antecedent_support, c.support AS consequent_support, f.support,
              f.support / a.support AS confidence, f.support / a.support / c.support AS lift,
              f.support - a.support * c.support AS leverage
       FROM fi f JOIN fi a ON (a.m & f.m) = a.m AND a.m <> f.m JOIN fi c ON c.m = xor(f.m, a.m) WHERE f.size >= 2),
rl AS (SELECT * FROM ru WHERE lift >= 1.05)"""


def _round_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("to_baskets", sql=with_basket("SELECT id, item FROM bl", long=True))
def q_to_baskets(spark, root):
    return ar.baskets_long(basket(spark, root), "id", BASKET_ITEMS)


@query("frequent_itemsets", headline=True, sql=with_basket(
    _FI_SQL + " SELECT array_to_string(itemset, ', ') AS items_str, size, c AS count, round(support, 6) AS support "
    "FROM fi"))
def q_frequent_itemsets(spark, root):
    b = ar.to_baskets(basket(spark, root), "id", BASKET_ITEMS)
    fi = ar.frequent_itemsets(b, MIN_SUPPORT, MAX_LEN, n_items_bound=len(BASKET_ITEMS))
    return r6(fi.select(F.array_join("itemset", ", ").alias("items_str"), "size", "count", "support"))


_RULE_COLS = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage"]


@query("association_rules", headline=True, sql=with_basket(
    _RULES_SQL + " SELECT antecedents_str, consequents_str, " + _round_sql(_RULE_COLS) + " FROM rl"))
def q_association_rules(spark, root):
    r = ar.with_display(_rules(spark, root))
    return r6(r.select("antecedents_str", "consequents_str", *_RULE_COLS))


@query("filter_rules", sql=with_basket(
    _RULES_SQL + " SELECT antecedents_str, consequents_str, " + _round_sql(["support", "confidence", "lift"])
    + " FROM rl WHERE support >= 0.10 AND confidence >= 0.55 AND lift >= 1.10"))
def q_filter_rules(spark, root):
    r = ar.with_display(ar.filter_rules(_rules(spark, root), **FILTER))
    return r6(r.select("antecedents_str", "consequents_str", "support", "confidence", "lift"))


_TOP_SQL = (" SELECT antecedents_str, consequents_str, " + _round_sql(["support", "confidence", "lift"])
            + " FROM (SELECT * FROM rl WHERE support >= 0.10 AND confidence >= 0.55 AND lift >= 1.10 {extra}"
            " ORDER BY lift DESC, confidence DESC, support DESC, antecedents_str, consequents_str LIMIT {k}) t")


@query("top_rules", headline=True, sql=with_basket(_RULES_SQL + _TOP_SQL.format(extra="", k=20)))
def q_top_rules(spark, root):
    return r6(ar.top_rules(ar.filter_rules(_rules(spark, root), **FILTER), 20))


@query("outcome_rules", sql=with_basket(_RULES_SQL + _TOP_SQL.format(
    extra="AND coalesce(regexp_matches(consequents_str, 'bulk|many'), false)", k=10)))
def q_outcome_rules(spark, root):
    return r6(ar.outcome_rules(ar.filter_rules(_rules(spark, root), **FILTER), OUTCOME_PATTERN, 10))


@query("rules_csv_roundtrip", sql=with_basket(_RULES_SQL + _TOP_SQL.format(extra="", k=20)))
def q_rules_csv_roundtrip(spark, root):
    top = ar.top_rules(ar.filter_rules(_rules(spark, root), **FILTER), 20)
    path = io.write_csv(top, scratch_path(spark, "top-rules-csv"))
    return r6(io.read_csv(spark, path, schema=top.schema))


@query("rule_counts", sql=with_basket(
    _RULES_SQL + " SELECT count(*) AS total_rules, count(*) FILTER (WHERE support >= 0.10 AND confidence >= 0.55 "
    "AND lift >= 1.10) AS filtered_rules FROM rl"))
def q_rule_counts(spark, root):
    return ar.rule_counts(_rules(spark, root), **FILTER)


THRESHOLDS = {"supports": [0.05, 0.08, 0.10, 0.15, 0.20, 0.30], "confidences": [0.40, 0.55, 0.70, 0.90], "lifts": [1.0, 1.1, 1.5, 2.0]}
_FLOOR_SQL = _RULES_SQL.replace(">= 0.1)", f">= {FLOOR})")
_GRID_SQL = ", ".join(f"({s:f}::DOUBLE, {c:f}::DOUBLE, {x:f}::DOUBLE)" for s in THRESHOLDS["supports"] for c in THRESHOLDS["confidences"] for x in THRESHOLDS["lifts"])


@query("rules_at_thresholds", sql=with_basket(
    _FLOOR_SQL + f", g(min_support, min_confidence, min_lift) AS (VALUES {_GRID_SQL}) SELECT min_support, min_confidence, min_lift, count(ru.support) AS n_rules "
    "FROM g LEFT JOIN ru ON ru.support >= min_support AND ru.confidence >= min_confidence AND ru.lift >= min_lift GROUP BY ALL"))
def q_rules_at_thresholds(spark, root):
    """Every setting of the three thresholds that the explorer offers, answered from the stored lattice."""
    return _lattice(spark, root).counts(**THRESHOLDS)


@query("rule_explorer", sql=with_basket(
    _FLOOR_SQL + " SELECT antecedents_str, consequents_str, " + _round_sql(["support", "confidence", "lift"])
    + " FROM ru WHERE support >= 0.07 AND confidence >= 0.45 AND lift >= 1.0"))
def q_rule_explorer(spark, root):
    """Rules at one setting below the defaults."""
    r = ar.with_display(_lattice(spark, root).rules(0.07, 0.45, 1.0))
    return r6(r.select("antecedents_str", "consequents_str", "support", "confidence", "lift"))
