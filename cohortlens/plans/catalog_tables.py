"""Registered queries for sources, columns, aggregates, ranking and
statistics (survey A-E), each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as fx
from cohortlens.operators import aggregates as agg
from cohortlens.operators import ranking as rk
from cohortlens.operators import stats as st
from cohortlens.plans.oracle import with_basket, with_profile
from cohortlens.plans.registry import query, r6
from cohortlens.session import scratch_path
from cohortlens.sources import io
from cohortlens.sources.views import BASKET_ITEMS, basket, profile, register_views

# Fixed labels used by the example queries.
REGION_LABELS = {1: "R1", 2: "R2", 3: "R3", 4: "R4"}  # code 5 deliberately unmapped
TIER_LABELS = {1: "T1", 2: "T2", 3: "T3", 4: "T4", 5: "T5", 6: "T6"}
TIER_ORDER = ["T1", "T2", "T3", "T4", "T5", "T6", "T7"]  # T7 never occurs
FLAG_LABELS = {0: "Not Willing", 1: "Willing"}
SCORE_BANDS = ([7, 5], ["High", "Moderate", "Low"])
NUMERIC_PROFILE = ["balance", "n_orders", "avg_price", "qty", "avg_discount", "n_parts", "n_returned",
                   "score_1_10", "target_amount"]
LEAKAGE = ["id", "target_amount", "target_flag", "tier_code"]

# ---------------------------------------------------------------- A sources

_TABLE_COLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
               "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2,
               "labels": 3, "conversations": 4}


@query("csv_roundtrip", sql="SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, "
                            "c_mktsegment FROM customer")
def q_csv_roundtrip(spark, root):
    src = io.read_table(spark, root, "customer")
    path = io.write_csv(src, scratch_path(spark, "customer-csv"))
    return r6(io.read_csv(spark, path, schema=src.schema))


@query("resolve_source", sql="SELECT * FROM nation")
def q_resolve_source(spark, root):
    return io.resolve_source(spark, "nation", [root.rstrip("/") + "/__absent__", root])


@query("resolve_override", sql="SELECT source, n_rows, total FROM (SELECT 'frame' AS source, count(*) AS n_rows, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_regionkey = 1 "
       "UNION ALL SELECT 'view', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey <> 1) t")
def q_resolve_override(spark, root):
    """A caller's own table, as a frame or as a registered view, beats the file."""
    register_views(spark, root)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW own_nation AS SELECT * FROM nation WHERE n_regionkey <> 1")
    frame = io.resolve_source(spark, "nation", [root], {"nation": spark.table("nation").where("n_regionkey = 1")})
    view = io.resolve_source(spark, "own_nation", [root], {"own_nation": "view"})
    parts = [df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_nationkey").cast("long").alias("total")) for name, df in (("frame", frame), ("view", view))]
    return parts[0].unionByName(parts[1])


@query("table_shape", sql="\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, {n} AS n_cols FROM {t}"
    for t, n in _TABLE_COLS.items()))
def q_table_shape(spark, root):
    return io.table_shape({t: io.read_table(spark, root, t) for t in _TABLE_COLS})


# ---------------------------------------------------------------- B columns

@query("project", sql=with_profile("SELECT id, segment, round(balance, 6) AS balance FROM profile"))
def q_project(spark, root):
    return r6(fx.project(profile(spark, root), ["id", "segment", "balance"]))


@query("cols_with_prefix", sql=with_basket(
    "SELECT id, type_economy, type_small, type_medium, type_promo, type_standard, type_large FROM basket"))
def q_cols_with_prefix(spark, root):
    return fx.select_prefix(basket(spark, root), "type_", keep=["id"])


@query("numeric_features", sql=with_profile(
    "SELECT region_code, round(balance, 6) AS balance, n_orders, round(avg_price, 6) AS avg_price, "
    "round(max_price, 6) AS max_price, n_urgent, n_closed, round(qty, 6) AS qty, "
    "round(avg_discount, 6) AS avg_discount, n_parts, n_returned, score_1_10 FROM profile"))
def q_numeric_features(spark, root):
    p = profile(spark, root)
    return r6(p.select(*fx.numeric_features(p, exclude=LEAKAGE)))


@query("first_existing", sql=with_profile("SELECT id, score_1_10 AS score, 0 AS fallback FROM profile"))
def q_first_existing(spark, root):
    p = profile(spark, root)
    return p.select("id", fx.first_existing(p, ["nps_score", "score_1_10"]).alias("score"),
                    fx.first_existing(p, ["not_there"], default=0).alias("fallback"))


@query("decode", sql=with_profile(
    "SELECT id, region_code, CASE region_code WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' WHEN 3 THEN 'R3' "
    "WHEN 4 THEN 'R4' END AS region_label FROM profile"))
def q_decode(spark, root):
    return fx.decode(profile(spark, root).select("id", "region_code"), "region_code", REGION_LABELS,
                     "region_label")


@query("rename", sql=with_profile("SELECT id, segment AS persona, round(balance, 6) AS account_balance FROM profile"))
def q_rename(spark, root):
    p = profile(spark, root).select("id", "segment", "balance")
    return r6(fx.rename(p, {"segment": "persona", "balance": "account_balance", "absent": "x"}))


@query("fill_nulls", sql=with_profile(
    "SELECT id, coalesce(n_orders, 0) AS n_orders, round(coalesce(target_amount, 0), 4) AS target_amount, "
    "coalesce(target_flag, 0) AS target_flag FROM profile"))
def q_fill_nulls(spark, root):
    p = profile(spark, root).select("id", "n_orders", "target_amount", "target_flag")
    return r6(fx.fill_nulls(p, ["n_orders", "target_amount", "target_flag"], 0), {"target_amount": 4})


@query("filter_by", sql=with_profile(
    "SELECT id, segment, score_1_10 FROM profile WHERE segment = 'BUILDING' AND score_1_10 >= 5"))
def q_filter_by(spark, root):
    p = profile(spark, root).select("id", "segment", "score_1_10")
    return fx.filter_by(fx.filter_by(p, {"segment": "BUILDING"}), F.col("score_1_10") >= 5)


@query("band", sql=with_profile(
    "SELECT id, score_1_10, CASE WHEN score_1_10 IS NULL THEN NULL WHEN score_1_10 >= 7 THEN 'High' "
    "WHEN score_1_10 >= 5 THEN 'Moderate' ELSE 'Low' END AS score_band FROM profile"))
def q_band(spark, root):
    p = profile(spark, root)
    return p.select("id", "score_1_10", fx.band("score_1_10", *SCORE_BANDS).alias("score_band"))


@query("classify_by_prefix", sql=(
    "SELECT p_partkey, p_type, CASE WHEN starts_with(p_type, 'ECO') THEN 'Budget' "
    "WHEN starts_with(p_type, 'PRO') THEN 'Promotional' WHEN starts_with(p_type, 'S') THEN 'Sized' "
    "ELSE 'Other' END AS kind FROM part"))
def q_classify_by_prefix(spark, root):
    part = io.read_table(spark, root, "part")
    rules = [("ECO", "Budget"), ("PRO", "Promotional"), ("S", "Sized")]
    return part.select("p_partkey", "p_type", fx.classify_by_prefix("p_type", rules, "Other").alias("kind"))


@query("match_regex", sql="SELECT p_partkey, p_name FROM part WHERE coalesce(regexp_matches(p_name, 'ring|widget'), false)")
def q_match_regex(spark, root):
    part = io.read_table(spark, root, "part").select("p_partkey", "p_name")
    return part.filter(fx.match_regex("p_name", "ring|widget"))


@query("round_cols", sql=with_profile("SELECT id, round(balance, 2) AS balance, round(avg_discount, 3) AS avg_discount FROM profile"))
def q_round_cols(spark, root):
    # Columns chosen without exact decimal ties: Spark rounds the decimal
    # form of a double, DuckDB the binary value, and they differ on ties.
    return fx.round_cols(profile(spark, root).select("id", "balance", "avg_discount"), {"balance": 2, "avg_discount": 3})


@query("to_flags", sql=with_basket("SELECT id, " + ", ".join(f"CAST({c} AS BOOLEAN) AS {c}" for c in BASKET_ITEMS)
                                   + " FROM basket"))
def q_to_flags(spark, root):
    return fx.to_flags(basket(spark, root), BASKET_ITEMS)


@query("set_to_string", sql=with_basket(
    "SELECT id, string_agg(item, ', ' ORDER BY item) AS items FROM bl GROUP BY id", long=True))
def q_set_to_string(spark, root):
    from cohortlens.operators.rules import to_baskets
    b = to_baskets(basket(spark, root), "id", BASKET_ITEMS)
    return b.select("id", fx.set_to_string("items").alias("items"))


@query("format_label", sql=(
    "SELECT o_orderkey, regexp_replace(o_orderpriority, '^(1-|2-|3-)', '') AS priority, "
    "substring(o_orderstatus || '/' || o_orderpriority, 1, 5) AS short, "
    "concat_ws(' → ', substring(o_orderpriority, 1, 4), o_orderstatus) AS arrow, printf('USD %.2f', o_totalprice) AS price, "
    "printf('%.1f%%', 100.0 * (o_orderkey % 7) / 7) AS share FROM orders"))
def q_format_label(spark, root):
    o = io.read_table(spark, root, "orders")
    return o.select("o_orderkey",
                    fx.strip_prefixes("o_orderpriority", ["1-", "2-", "3-"]).alias("priority"),
                    fx.truncate(F.concat_ws("/", "o_orderstatus", "o_orderpriority"), 5).alias("short"),
                    fx.arrow_label("o_orderpriority", "o_orderstatus", left_len=4).alias("arrow"),
                    fx.money_label("o_totalprice", "USD", 2).alias("price"),
                    fx.pct_label(fx.percent_of(F.col("o_orderkey") % 7, F.lit(7))).alias("share"))


@query("percent_of", sql=with_profile(
    "SELECT id, round(100.0 * n_urgent / nullif(n_orders, 0), 4) AS urgent_pct FROM profile"))
def q_percent_of(spark, root):
    p = profile(spark, root)
    return p.select("id", fx.percent_of("n_urgent", "n_orders", 4).alias("urgent_pct"))


# ------------------------------------------------------------- C aggregates

@query("kpis", headline=True, sql=with_profile(
    "SELECT round(avg(target_flag) * 100, 6) AS willing_pct, round(avg(score_1_10), 6) AS avg_score, "
    "round(avg(target_amount), 4) AS avg_amount, round(median(target_amount), 4) AS median_amount, "
    "round(stddev_samp(score_1_10), 6) AS sd_score, CAST(count(id) AS BIGINT) AS n FROM profile"))
def q_kpis(spark, root):
    p = profile(spark, root)
    k = agg.kpis(p, [("willing_pct", "share", "target_flag"), ("avg_score", "mean", "score_1_10"),
                     ("avg_amount", "mean", "target_amount"), ("median_amount", "median", "target_amount"),
                     ("sd_score", "std", "score_1_10"), ("n", "count", "id")])
    return r6(k, {"avg_amount": 4, "median_amount": 4})


@query("spread", sql=with_profile(
    "SELECT round(stddev_samp(balance), 6) AS balance, round(stddev_samp(score_1_10), 6) AS score_1_10, "
    "round(stddev_samp(avg_discount), 6) AS avg_discount FROM profile"))
def q_spread(spark, root):
    return r6(agg.spread(profile(spark, root), ["balance", "score_1_10", "avg_discount"]))


@query("mean_profile", sql=with_basket("\nUNION ALL ".join(
    f"SELECT '{c}' AS item, round(avg({c}), 6) AS mean FROM basket" for c in BASKET_ITEMS)))
def q_mean_profile(spark, root):
    return r6(agg.mean_profile(basket(spark, root), BASKET_ITEMS))


@query("frequency", headline=True, sql="SELECT o_orderpriority, count(*) AS n FROM orders "
                                       "WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def q_frequency(spark, root):
    return agg.frequency(io.read_table(spark, root, "orders"), "o_orderpriority")


@query("ordered_frequency", sql=with_profile(
    "SELECT score_1_10, count(*) AS n FROM profile WHERE score_1_10 IS NOT NULL GROUP BY 1"))
def q_ordered_frequency(spark, root):
    return agg.ordered_frequency(profile(spark, root), "score_1_10")


@query("frequency_pct", sql=with_profile(
    "SELECT * FROM (SELECT region_label, n, round(100.0 * n / sum(n) OVER (), 1) AS pct FROM ("
    " SELECT CASE region_code WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' WHEN 3 THEN 'R3' WHEN 4 THEN 'R4' END "
    " AS region_label, count(*) AS n FROM profile GROUP BY 1) t) u WHERE region_label IS NOT NULL"))
def q_frequency_pct(spark, root):
    p = fx.decode(profile(spark, root), "region_code", REGION_LABELS, "region_label")
    return agg.frequency_pct(p, "region_label", base="all", digits=1)


@query("mode", sql="SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL "
                   "GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 1")
def q_mode(spark, root):
    return agg.mode(io.read_table(spark, root, "orders"), "o_orderpriority")


@query("group_means", sql=with_profile(
    "SELECT segment, round(avg(balance), 6) AS balance, round(avg(avg_price), 6) AS avg_price, "
    "round(avg(qty), 6) AS qty, round(avg(score_1_10), 6) AS score_1_10 FROM profile GROUP BY segment"))
def q_group_means(spark, root):
    return r6(agg.group_means(profile(spark, root), "segment", ["balance", "avg_price", "qty", "score_1_10"]))


@query("group_summary", sql=with_profile(
    "SELECT segment, count(id) AS n, round(avg(target_amount), 4) AS amount, "
    "round(avg(avg_discount), 6) AS discount, round(avg(score_1_10), 6) AS score FROM profile GROUP BY segment"))
def q_group_summary(spark, root):
    g = agg.group_summary(profile(spark, root), "segment", {
        "n": ("id", "count"), "amount": ("target_amount", "mean"), "discount": ("avg_discount", "mean"),
        "score": ("score_1_10", "mean")})
    return r6(g, {"amount": 4})


_TIER_CASE = ("CASE tier_code WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'T4' "
              "WHEN 5 THEN 'T5' WHEN 6 THEN 'T6' END")


@query("group_means_ordered", sql=with_profile(
    ", ord AS (SELECT * FROM (VALUES (0, 'T1'), (1, 'T2'), (2, 'T3'), (3, 'T4'), (4, 'T5'), (5, 'T6'), "
    "(6, 'T7')) v(pos, tier_label)), g AS (SELECT " + _TIER_CASE + " AS tier_label, avg(target_amount) AS mean "
    "FROM profile GROUP BY 1) SELECT ord.pos, ord.tier_label, round(g.mean, 4) AS mean FROM ord "
    "LEFT JOIN g ON ord.tier_label = g.tier_label"))
def q_group_means_ordered(spark, root):
    p = fx.decode(profile(spark, root), "tier_code", TIER_LABELS, "tier_label")
    return r6(agg.group_means_ordered(p, "tier_label", "target_amount", TIER_ORDER), {"mean": 4})


@query("group_means_ranked", sql=with_profile(
    "SELECT segment, round(avg(target_amount), 4) AS mean FROM profile GROUP BY segment"))
def q_group_means_ranked(spark, root):
    return r6(agg.group_means_ranked(profile(spark, root), "segment", "target_amount"), {"mean": 4})


@query("count_where", sql=with_profile(
    "SELECT count(*) FILTER (WHERE target_flag = 1) AS willing, count(*) FILTER (WHERE score_1_10 >= 7) AS "
    "high_score, count(*) FILTER (WHERE nps_category = 'Promoter') AS promoters FROM profile"))
def q_count_where(spark, root):
    return agg.count_where(profile(spark, root), {"willing": F.col("target_flag") == 1,
                                                  "high_score": "score_1_10 >= 7",
                                                  "promoters": F.col("nps_category") == "Promoter"})


FUNNEL_STAGES = [("Total", None), ("Willing", "target_flag = 1"), ("High score", "score_1_10 >= 7"),
                 ("Value seekers", "target_flag = 1 AND n_returned >= 15")]


@query("funnel", headline=True, sql=with_profile(
    ", w AS (SELECT count(*) AS total, count(*) FILTER (WHERE target_flag = 1) AS s1, "
    "count(*) FILTER (WHERE score_1_10 >= 7) AS s2, "
    "count(*) FILTER (WHERE target_flag = 1 AND n_returned >= 15) AS s3 FROM profile) "
    "SELECT step, stage, n, round(100.0 * n / total, 1) AS pct FROM ("
    "SELECT 0 AS step, 'Total' AS stage, total AS n, total FROM w UNION ALL "
    "SELECT 1, 'Willing', s1, total FROM w UNION ALL SELECT 2, 'High score', s2, total FROM w UNION ALL "
    "SELECT 3, 'Value seekers', s3, total FROM w) t"))
def q_funnel(spark, root):
    return agg.funnel(profile(spark, root), FUNNEL_STAGES)


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols: list[str], digits: int = 4) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), {digits}) AS mean, "
            f"round(stddev_samp({c}), {digits}) AS std, round(min({c}), {digits}) AS min, "
            f"round(quantile_cont({c}, 0.25), {digits}) AS p25, round(quantile_cont({c}, 0.5), {digits}) AS p50, "
            f"round(quantile_cont({c}, 0.75), {digits}) AS p75, round(max({c}), {digits}) AS max FROM {table}")
    return "\nUNION ALL ".join(parts)


@query("describe", headline=True, sql=_describe_sql("lineitem", DESCRIBE_COLS))
def q_describe(spark, root):
    return agg.describe(io.read_table(spark, root, "lineitem"), DESCRIBE_COLS, digits=4)


@query("histogram", sql=with_profile(
    ", base AS (SELECT CAST(target_amount AS DOUBLE) AS x FROM profile WHERE target_amount IS NOT NULL), "
    "r0 AS (SELECT min(x) AS mn0, max(x) AS mx0 FROM base), "
    "r AS (SELECT CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn, "
    "CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM r0), "
    "c AS (SELECT CAST(least(floor((x - mn) * 20 / (mx - mn)), 19) AS INTEGER) AS bin, count(*) AS n "
    "FROM base, r GROUP BY 1), g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) "
    "SELECT g.bin, round(mn + g.bin * ((mx - mn) / 20), 4) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 20), 4) AS hi, "
    "coalesce(c.n, 0) AS n FROM g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin"))
def q_histogram(spark, root):
    return r6(agg.histogram(profile(spark, root), "target_amount", 20), {"lo": 4, "hi": 4})


@query("crosstab", headline=True, sql=with_profile(
    ", b AS (SELECT " + _TIER_CASE + " AS tier_label, CASE target_flag WHEN 0 THEN 'Not Willing' "
    "WHEN 1 THEN 'Willing' END AS flag_label FROM profile), "
    "b2 AS (SELECT * FROM b WHERE tier_label IS NOT NULL AND flag_label IS NOT NULL), "
    "rws AS (SELECT DISTINCT tier_label FROM b2), cls AS (SELECT DISTINCT flag_label FROM b2), "
    "cnt AS (SELECT tier_label, flag_label, count(*) AS n FROM b2 GROUP BY 1, 2), "
    "grid AS (SELECT tier_label, flag_label FROM rws CROSS JOIN cls) "
    "SELECT g.tier_label, g.flag_label, coalesce(c.n, 0) AS n, "
    "round(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.tier_label), 6) AS pct "
    "FROM grid g LEFT JOIN cnt c ON g.tier_label = c.tier_label AND g.flag_label = c.flag_label"))
def q_crosstab(spark, root):
    p = fx.decode(profile(spark, root), "tier_code", TIER_LABELS, "tier_label")
    p = fx.decode(p, "target_flag", FLAG_LABELS, "flag_label")
    return r6(agg.crosstab(p, "tier_label", "flag_label", normalize="index"))


@query("mean_of_group_means", sql=with_profile(
    "SELECT round(avg(a), 4) AS target_amount, round(avg(b), 6) AS avg_discount FROM ("
    "SELECT segment, avg(target_amount) AS a, avg(avg_discount) AS b FROM profile GROUP BY segment) t"))
def q_mean_of_group_means(spark, root):
    return r6(agg.mean_of_group_means(profile(spark, root), "segment", ["target_amount", "avg_discount"]),
              {"target_amount": 4})


@query("value_range", sql="\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))
def q_value_range(spark, root):
    return r6(agg.value_range(io.read_table(spark, root, "lineitem"),
                              ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))


# ---------------------------------------------------------------- D ranking

_SEG_MEANS_SQL = ("seg AS (SELECT segment, round(avg(score_1_10), 0) AS score, round(avg(avg_discount), 3) AS disc, "
                  "avg(target_amount) AS amount FROM profile GROUP BY segment)")


def _seg_means(spark, root):
    p = profile(spark, root)
    return p.groupBy("segment").agg(F.round(F.avg("score_1_10"), 0).alias("score"),
                                    F.round(F.avg("avg_discount"), 3).alias("disc"),
                                    F.avg("target_amount").alias("amount"))


@query("average_rank", sql=with_profile(
    ", " + _SEG_MEANS_SQL + " SELECT segment, "
    "CAST(floor(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS INTEGER) AS score_rank, "
    "CAST(floor(rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0) AS INTEGER) AS amount_rank "
    "FROM seg"))
def q_average_rank(spark, root):
    return rk.average_rank(_seg_means(spark, root), ["score", "amount"]).select("segment", "score_rank", "amount_rank")


@query("min_max_scale", sql=with_profile(
    ", " + _SEG_MEANS_SQL + " SELECT segment, round((disc - min(disc) OVER ()) / (max(disc) OVER () - min(disc) OVER () + 1e-9), 6) AS disc, "
    "round((amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER () + 1e-9), 6) AS amount FROM seg"))
def q_min_max_scale(spark, root):
    return r6(rk.min_max_scale(_seg_means(spark, root), ["disc", "amount"]).select("segment", "disc", "amount"))


@query("sort_by", sql=with_profile("SELECT id, round(balance, 6) AS balance FROM profile ORDER BY balance DESC, id"))
def q_sort_by(spark, root):
    return r6(rk.sort_by(profile(spark, root).select("id", "balance"), [("balance", "desc")], ["id"]))


@query("top_k", headline=True, sql=with_profile(
    "SELECT id, round(target_amount, 4) AS target_amount FROM profile ORDER BY target_amount DESC NULLS LAST, id LIMIT 10"))
def q_top_k(spark, root):
    return r6(rk.top_k(profile(spark, root).select("id", "target_amount"), 10, [("target_amount", "desc")], ["id"]),
              {"target_amount": 4})


@query("arg_best", sql=with_profile(
    ", " + _SEG_MEANS_SQL + " SELECT segment, round(amount, 4) AS amount FROM seg ORDER BY amount DESC, segment LIMIT 1"))
def q_arg_best(spark, root):
    return r6(rk.arg_best(_seg_means(spark, root), "amount", "segment"), {"amount": 4})


# ------------------------------------------------------------- E statistics

CORR_COLS = ["balance", "n_orders", "avg_price", "qty", "avg_discount", "score_1_10", "target_amount", "const"]


def _guard_sql(x: str, y: str) -> str:
    xm = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    ym = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    return f"covar_pop({xm}, {ym}) / nullif(stddev_pop({xm}) * stddev_pop({ym}), 0)"


def _corr_lower_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[:i]:
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, round({_guard_sql(a, b)}, 6) AS r FROM p1")
    return with_profile(", p1 AS (SELECT *, 1.0 AS const FROM profile) " + "\nUNION ALL ".join(parts))


@query("pearson", sql=with_profile(
    f"SELECT round({_guard_sql('n_orders', 'target_amount')}, 6) AS r, "
    "count(CASE WHEN n_orders IS NOT NULL AND target_amount IS NOT NULL THEN 1 END) AS n FROM profile"))
def q_pearson(spark, root):
    return r6(st.pearson(profile(spark, root), "n_orders", "target_amount"))


@query("corr_matrix", headline=True, sql=_corr_lower_sql())
def q_corr_matrix(spark, root):
    p = profile(spark, root).withColumn("const", F.lit(1.0))
    return r6(st.corr_matrix(p, CORR_COLS, triangle="lower"))


@query("corr_with_target", sql=with_profile("\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, round({_guard_sql(c, 'target_amount')}, 6) AS r FROM profile"
    for c in ["balance", "n_orders", "avg_price", "qty", "avg_discount", "score_1_10"])))
def q_corr_with_target(spark, root):
    return corr_with_target_of(profile(spark, root))


def corr_with_target_of(p):
    return r6(st.corr_with_target(p, ["balance", "n_orders", "avg_price", "qty", "avg_discount", "score_1_10",
                                      "target_amount"], "target_amount"))


def _trend_sql(by: str | None) -> str:
    xm = "CASE WHEN avg_discount IS NOT NULL AND target_amount IS NOT NULL THEN avg_discount END"
    ym = "CASE WHEN avg_discount IS NOT NULL AND target_amount IS NOT NULL THEN target_amount END"
    slope = f"(covar_pop({xm}, {ym}) / nullif(var_pop({xm}), 0))"
    sel = (f"round({slope}, 2) AS slope, round(avg({ym}) - {slope} * avg({xm}), 2) AS intercept, "
           f"round({_guard_sql('avg_discount', 'target_amount')}, 6) AS r, count({xm}) AS n")
    if by:
        return with_profile(f"SELECT {by}, {sel} FROM profile GROUP BY {by}")
    return with_profile(f"SELECT {sel} FROM profile")


@query("linear_trend", sql=_trend_sql("segment"))
def q_linear_trend(spark, root):
    t = st.linear_trend(profile(spark, root), "avg_discount", "target_amount", by="segment")
    return r6(t, {"slope": 2, "intercept": 2})


@query("trend_points", sql=with_profile(
    ", f AS (SELECT covar_pop(x, y) / nullif(var_pop(x), 0) AS slope, avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x) "
    "AS intercept, min(x) AS lo, max(x) AS hi FROM (SELECT CASE WHEN n_parts IS NOT NULL AND qty IS NOT NULL THEN "
    "CAST(n_parts AS DOUBLE) END AS x, CASE WHEN n_parts IS NOT NULL AND qty IS NOT NULL THEN qty END AS y FROM profile) t) "
    "SELECT CAST(range AS INTEGER) AS i, round(lo + range * ((hi - lo) / 99), 4) AS x, "
    "round(intercept + slope * (lo + range * ((hi - lo) / 99)), 4) AS y_hat FROM range(100), f"))
def q_trend_points(spark, root):
    return r6(st.trend_points(profile(spark, root), "n_parts", "qty", 100), {"x": 4, "y_hat": 4})
