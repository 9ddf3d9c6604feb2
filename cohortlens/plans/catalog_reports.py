"""Registered composed reports (survey K1-K6) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.columns import decode
from cohortlens.operators import aggregates as agg
from cohortlens.plans import catalog_models, catalog_rules  # noqa: F401  (run_all names their queries)
from cohortlens.plans import reports as rp
from cohortlens.plans.catalog_tables import REGION_LABELS, TIER_LABELS, FLAG_LABELS, corr_with_target_of
from cohortlens.plans.oracle import with_both, with_profile
from cohortlens.plans.registry import ORACLE, QUERIES, query, r6
from cohortlens.session import scratch_path
from cohortlens.sources import documents as nd
from cohortlens.sources.views import basket, profile


_CT_TIER = ("CASE tier_code WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'T4' WHEN 5 THEN 'T5' "
            "WHEN 6 THEN 'T6' END")
_CT_REGION = "CASE region_code WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' WHEN 3 THEN 'R3' WHEN 4 THEN 'R4' END"

_DEMOGRAPHICS = {"tier_dist": ("tier_code", TIER_LABELS), "region_dist": ("region_code", REGION_LABELS),
                 "flag_label_dist": ("target_flag", FLAG_LABELS)}
_CT_FLAG = "CASE target_flag WHEN 0 THEN 'Not Willing' WHEN 1 THEN 'Willing' END"
_BAND = "CASE WHEN score_1_10 >= 7 THEN 'High' WHEN score_1_10 >= 5 THEN 'Medium' WHEN score_1_10 IS NOT NULL THEN 'Low' END"


def _dist_sql(section: str, expr: str) -> str:
    return f"UNION ALL SELECT '{section}', CAST({expr} AS VARCHAR), count(*) FROM profile WHERE {expr} IS NOT NULL GROUP BY {expr} "


def _tidy(report):
    """Values to 4 digits, but medians to 6: the midpoint of two snapped amounts is an exact tie at the fifth."""
    digits = F.when(F.col("key") == "median_amount", F.round("value", 6)).otherwise(F.round("value", 4))
    return report.withColumn("value", digits)


@query("descriptive_report", headline=True, sql=with_profile(
    ", rg AS (SELECT CASE WHEN min(target_amount) = max(target_amount) THEN min(target_amount) - 0.5 ELSE min(target_amount) END AS lo, "
    "CASE WHEN min(target_amount) = max(target_amount) THEN max(target_amount) + 0.5 ELSE max(target_amount) END AS hi FROM profile), "
    "hb AS (SELECT CAST(least(floor((target_amount - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS n "
    "FROM profile, rg WHERE target_amount IS NOT NULL GROUP BY 1) "
    "SELECT 'kpi' AS section, 'willing_pct' AS key, CAST(round(avg(target_flag) * 100, 4) AS DOUBLE) AS value FROM profile "
    "UNION ALL SELECT 'kpi', 'avg_score', round(avg(score_1_10), 4) FROM profile "
    "UNION ALL SELECT 'kpi', 'avg_nps', round(avg(n_closed), 4) FROM profile "
    "UNION ALL SELECT 'kpi', 'avg_pain', round(avg(avg_discount), 4) FROM profile "
    "UNION ALL SELECT 'kpi', 'avg_amount', round(avg(target_amount), 4) FROM profile "
    "UNION ALL SELECT 'kpi', 'median_amount', round(median(target_amount), 6) FROM profile "
    "UNION ALL SELECT 'amount_range', 'min', round(lo, 4) FROM rg UNION ALL SELECT 'amount_range', 'max', round(hi, 4) FROM rg "
    "UNION ALL SELECT 'amount_histogram', CAST(g.range AS VARCHAR), coalesce(hb.n, 0) FROM range(20) g LEFT JOIN hb ON g.range = hb.bin "
    + _dist_sql("flag_dist", "target_flag") + _dist_sql("category_dist", "nps_category") + _dist_sql("score_dist", "score_1_10")
    + _dist_sql("score_band", f"({_BAND})") + _dist_sql("tier_dist", f"({_CT_TIER})") + _dist_sql("region_dist", f"({_CT_REGION})")
    + _dist_sql("flag_label_dist", f"({_CT_FLAG})")))
def q_descriptive_report(spark, root):
    return _descriptive(profile(spark, root))


def _descriptive(p):
    return _tidy(rp.descriptive_report(p, "target_flag", "score_1_10", "target_amount", "nps_category", nps_score="n_closed",
                                       pain="avg_discount", demographics=_DEMOGRAPHICS))


def _ct_sql(dim: str, row_expr: str) -> str:
    return (f"SELECT '{dim}' AS dimension, g.row_label, g.col_label, coalesce(c.n, 0) AS n, "
            "round(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.row_label), 6) AS pct FROM "
            f"(SELECT r.row_label, v.col_label FROM (SELECT DISTINCT {row_expr} AS row_label FROM lab WHERE {row_expr} "
            "IS NOT NULL AND flag_label IS NOT NULL) r, (VALUES ('Not Willing'), ('Willing')) v(col_label)) g "
            f"LEFT JOIN (SELECT {row_expr} AS row_label, flag_label AS col_label, count(*) AS n FROM lab "
            f"WHERE {row_expr} IS NOT NULL AND flag_label IS NOT NULL GROUP BY 1, 2) c "
            "ON g.row_label = c.row_label AND g.col_label = c.col_label")




@query("crosstab_report", sql=with_profile(
    ", lab AS (SELECT *, CASE target_flag WHEN 0 THEN 'Not Willing' WHEN 1 THEN 'Willing' END AS flag_label "
    "FROM profile) " + " UNION ALL ".join(
        [_ct_sql("segment", "segment"), _ct_sql("tier", _CT_TIER), _ct_sql("region", _CT_REGION)])))
def q_crosstab_report(spark, root):
    return _crosstabs(profile(spark, root))


def _crosstabs(p):
    rep = rp.crosstab_report(p, "target_flag",
                             {"segment": "segment", "tier": ("tier_code", TIER_LABELS),
                              "region": ("region_code", REGION_LABELS)}, FLAG_LABELS)
    return r6(rep)


_DIAG = {"discount_amount_r": ("avg_discount", "target_amount"), "discount_score_r": ("avg_discount", "score_1_10"),
         "parts_amount_r": ("n_parts", "target_amount")}


def _g(x: str, y: str) -> str:
    xm = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    ym = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    return f"covar_pop({xm}, {ym}) / nullif(stddev_pop({xm}) * stddev_pop({ym}), 0)"


_DIAG_COLS = ["balance", "n_orders", "qty", "avg_discount", "n_parts", "score_1_10"]
_TREND = ("avg_discount", "target_amount")
_TX, _TY = [f"CASE WHEN avg_discount IS NOT NULL AND target_amount IS NOT NULL THEN CAST({c} AS DOUBLE) END" for c in _TREND]
_SLOPE = f"(covar_pop({_TX}, {_TY}) / nullif(var_pop({_TX}), 0))"


@query("diagnostic_report", sql=with_profile("\nUNION ALL ".join(
    [f"SELECT '{s}' AS section, '{k}' AS key, round({_g(x, y)}, 6) AS value FROM profile" for s, k, x, y in
     [("pairs", n, x, y) for n, (x, y) in _DIAG.items()]
     + [("matrix", f"{x}|{y}", x, y) for i, x in enumerate(_DIAG_COLS) for y in _DIAG_COLS[:i]]
     + [("target", c, c, "target_amount") for c in _DIAG_COLS] + [("trend", "r", *_TREND)]]
    + [f"SELECT 'trend', 'slope', round({_SLOPE}, 2) FROM profile",
       f"SELECT 'trend', 'intercept', round(avg({_TY}) - {_SLOPE} * avg({_TX}), 2) FROM profile",
       f"SELECT 'trend', 'n', CAST(count({_TX}) AS DOUBLE) FROM profile"])))
def q_diagnostic_report(spark, root):
    return _diagnostic(profile(spark, root))


def _diagnostic(p):
    line = F.col("key").isin("slope", "intercept")
    return rp.diagnostic_report(p, _DIAG, _DIAG_COLS, "target_amount", _TREND).withColumn("value", F.when(line, F.round("value", 2)).otherwise(F.round("value", 6)))


@query("diagnostic_scatter", sql=with_profile(
    "SELECT id, segment AS \"group\", round(avg_discount, 6) AS x, round(target_amount, 4) AS y FROM profile "
    "WHERE avg_discount IS NOT NULL AND target_amount IS NOT NULL"))
def q_diagnostic_scatter(spark, root):
    return _scatter(profile(spark, root))


def _scatter(p):
    return r6(rp.scatter_rows(p, "id", *_TREND, "segment"), {"y": 4})


@query("opportunity_map", headline=True, sql=with_profile(
    ", g AS (SELECT segment, count(id) AS n, avg(target_amount) AS value, avg(score_1_10) AS readiness, "
    "avg(avg_discount) AS pain FROM profile GROUP BY segment), "
    "b AS (SELECT *, avg(value) OVER () AS value_bench, avg(readiness) OVER () AS readiness_bench FROM g) "
    "SELECT segment, n, round(value, 4) AS value, round(readiness, 6) AS readiness, round(pain, 6) AS pain, "
    "round(value_bench, 4) AS value_bench, round(readiness_bench, 6) AS readiness_bench, "
    "CASE WHEN value >= value_bench AND readiness >= readiness_bench THEN 'Priority' "
    "WHEN value >= value_bench THEN 'High value, low readiness' WHEN readiness >= readiness_bench "
    "THEN 'Ready, low value' ELSE 'Deprioritise' END AS quadrant FROM b"))
def q_opportunity_map(spark, root):
    return _opportunity(profile(spark, root))


def _opportunity(p):
    return r6(rp.opportunity_map(p, "segment", "target_amount", "score_1_10", "avg_discount", "id"), {"value": 4, "value_bench": 4})


_ITEMS = ["n_urgent", "n_closed", "n_returned", "n_parts", "n_orders"]
_COUNTS = {"high_score": "score_1_10 >= 7", "value_seekers": "target_flag = 1 AND n_returned >= 15"}


@query("business_report", sql=with_profile(
    ", ti AS (" + " UNION ALL ".join(f"SELECT '{c}' AS item, avg({c}) AS m FROM profile" for c in _ITEMS) + "), "
    "ch AS (SELECT " + _CT_TIER + " AS choice, count(*) AS n FROM profile GROUP BY 1 HAVING choice IS NOT NULL) "
    "SELECT * FROM (SELECT 'top_items' AS section, item AS key, round(m, 4) AS value FROM ti "
    "ORDER BY m DESC, item LIMIT 5) t1 "
    "UNION ALL SELECT 'choice_dist', choice, n FROM ch "
    "UNION ALL SELECT * FROM (SELECT 'choice_mode', choice, n FROM ch ORDER BY n DESC, choice LIMIT 1) t2 "
    "UNION ALL SELECT 'summary', 'willing_pct', round(avg(target_flag) * 100, 4) FROM profile "
    "UNION ALL SELECT 'summary', 'median_amount', round(median(target_amount), 6) FROM profile "
    "UNION ALL SELECT 'summary', 'high_score', count(*) FILTER (WHERE score_1_10 >= 7) FROM profile "
    "UNION ALL SELECT 'summary', 'value_seekers', count(*) FILTER (WHERE target_flag = 1 AND n_returned >= 15) "
    "FROM profile"))
def q_business_report(spark, root):
    return _business(profile(spark, root))


def _business(p):
    rep = rp.business_report(p, _ITEMS, None, "tier_code", TIER_LABELS, "target_flag",
                             "target_amount", _COUNTS, top=5)
    return _tidy(rep)


# name -> (query that plans it, its rows where no SQL states it: models, clusters, targets x models)
_SECTIONS = {"descriptive": ("descriptive_report", None), "diagnostic": ("diagnostic_report", None), "scatter": ("diagnostic_scatter", None),
             "opportunity": ("opportunity_map", None), "crosstabs": ("crosstab_report", None), "correlations": ("corr_with_target", None),
             "classification": ("classifier_comparison", 4), "clustering": ("kmeans", 5), "rules": ("top_rules", None), "regression": ("fit_targets", 8),
             "business": ("business_report", None)}


# Sections made from the profile alone: a run gives them the profile that its models read, so its joins are computed once.
_OF_PROFILE = {"descriptive": _descriptive, "diagnostic": _diagnostic, "scatter": _scatter, "opportunity": _opportunity, "crosstabs": _crosstabs,
               "correlations": corr_with_target_of, "business": _business}


def _sections(spark, root):
    def plan(name, q):
        return _OF_PROFILE[name](catalog_models._profile(spark, root)) if name in _OF_PROFILE else QUERIES[q](spark, root)
    return {name: (lambda name=name, q=q: plan(name, q)) for name, (q, _) in _SECTIONS.items()}


# Sections that fit models take longest.
_LONG = ["classification", "regression", "clustering"]


def _run_all_sql() -> str:
    parts = [f"SELECT '{name}' AS section, " + (f"CAST({n} AS BIGINT)" if n else f"(SELECT count(*) FROM ({ORACLE[q]}) t)") + " AS n_rows" for name, (q, n) in _SECTIONS.items()]
    return "\nUNION ALL ".join(parts)


@query("run_all", sql=_run_all_sql())
def q_run_all(spark, root):
    """All sections of the reference's run, written with a manifest each."""
    return rp.run_all(spark, _sections(spark, root), scratch_path(spark, "run-all"), first=_LONG)


@query("run_all_resumed", sql=_run_all_sql())
def q_run_all_resumed(spark, root):
    """A run that stops after three sections, then is called again."""
    path, sections = scratch_path(spark, "run-all"), _sections(spark, root)
    first = list(sections)[:3]
    rp.run_all(spark, {n: sections[n] for n in first}, path)

    def again(name):
        raise ValueError(f"{name} was written before")
    return rp.run_all(spark, {n: (lambda n=n: again(n)) if n in first else s for n, s in sections.items()}, path, first=_LONG)


_DOC_TIERS = "SELECT " + _CT_TIER + " AS tier, count(*) AS n FROM profile GROUP BY 1 HAVING tier IS NOT NULL"
_DOC_SQL = f"""
, doc AS (
SELECT 'descriptive.summary.' || k AS path, v AS number FROM (SELECT unnest(['willing_pct', 'avg_amount', 'avg_score', 'n']) AS k,
  unnest([avg(target_flag) * 100, avg(target_amount), avg(score_1_10), count(*)]) AS v FROM profile)
UNION ALL SELECT 'descriptive.tiers.' || tier, n FROM ({_DOC_TIERS})
UNION ALL SELECT 'crosstab.willing_by_segment.' || segment || '.' || CASE target_flag WHEN 1 THEN 'Willing' ELSE 'Not willing' END, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY segment)
  FROM profile WHERE target_flag IS NOT NULL AND segment IS NOT NULL GROUP BY segment, target_flag
UNION ALL SELECT 'association.frequent_pairs.' || (row_number() OVER (ORDER BY n DESC, a, b) - 1) || '.n', n FROM pair)"""
_PAIR_SQL = "".join(f" UNION ALL SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = 1 AND {b} = 1) AS n FROM basket" for a, b in (("big_qty", "bulk"), ("bulk", "many_lines"), ("returned", "urgent")))


@query("results_document", sql=with_both(
    f", pair AS ({_PAIR_SQL.removeprefix(' UNION ALL ')})" + _DOC_SQL + " SELECT path, round(number, 4) AS number, CAST(NULL AS VARCHAR) AS text FROM doc "
    "UNION ALL SELECT 'association.frequent_pairs.' || (row_number() OVER (ORDER BY n DESC, a, b) - 1) || '.pair', CAST(NULL AS DOUBLE), a || ', ' || b FROM pair"))
def q_results_document(spark, root):
    """Sections of four shapes in one JSON document, read back and flattened."""
    p, b = profile(spark, root), basket(spark, root)
    kpis = p.agg((F.avg("target_flag") * 100).alias("willing_pct"), F.avg("target_amount").alias("avg_amount"), F.avg("score_1_10").alias("avg_score"), F.count(F.lit(1)).alias("n"))
    tiers = decode(p, "tier_code", TIER_LABELS, "tier").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    willing = agg.crosstab(p.where("segment is not null").withColumn("label", F.when(F.col("target_flag") == 1, "Willing").when(F.col("target_flag") == 0, "Not willing")),
                           "segment", "label", normalize="index")
    pairs = b.agg(*[F.count_if((F.col(x) == 1) & (F.col(y) == 1)).alias(f"{x}, {y}") for x, y in (("big_qty", "bulk"), ("bulk", "many_lines"), ("returned", "urgent"))])
    pairs = pairs.unpivot([], pairs.columns, "pair", "n").withColumn("place", -F.col("n"))
    doc = nd.results_document(spark, {
        "descriptive": {"summary": nd.as_record(kpis), "tiers": nd.as_map(tiers, "tier", "n")},
        "crosstab": {"willing_by_segment": nd.as_nested_map(willing, "segment", "label", "pct")},
        "association": {"frequent_pairs": nd.as_rows(pairs, ["place", "pair"])}})
    path = scratch_path(spark, "results-document")
    schema = nd.write_document(doc, path)
    flat = nd.flatten_document(nd.read_document(spark, path, schema)).where("not endswith(path, '.place')")
    return flat.withColumn("number", F.round("number", 4))
