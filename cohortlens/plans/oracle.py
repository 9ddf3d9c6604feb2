"""Independent SQL for every oracle-checkable query (DuckDB dialect).

The test tables are registered as views by the checker; the two fixture
views are spelled out here as CTEs so the SQL stands alone. Doubles are
rounded to 6 digits (4 above 1e5) on both sides; counts are BIGINT.
"""

from __future__ import annotations

PROFILE_CTE = """
oagg AS (
  SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price, max(o_totalprice) AS max_price,
         count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_urgent,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS n_closed
  FROM orders GROUP BY o_custkey),
lagg AS (
  SELECT o.o_custkey AS l_custkey, sum(l.l_quantity) AS qty, round(avg(l.l_discount), 8) AS avg_discount,
         count(DISTINCT l.l_partkey) AS n_parts,
         count(*) FILTER (WHERE l.l_returnflag = 'R') AS n_returned,
         round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS target_amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
profile AS (
  SELECT c.c_custkey AS id, c.c_mktsegment AS segment, n.n_regionkey + 1 AS region_code,
         CASE WHEN c.c_acctbal IS NULL THEN NULL WHEN c.c_acctbal < 0 THEN 1 WHEN c.c_acctbal < 2000 THEN 2
              WHEN c.c_acctbal < 4000 THEN 3 WHEN c.c_acctbal < 6000 THEN 4 WHEN c.c_acctbal < 8000 THEN 5
              ELSE 6 END AS tier_code,
         c.c_acctbal AS balance, oagg.n_orders, oagg.avg_price, oagg.max_price, oagg.n_urgent, oagg.n_closed,
         lagg.qty, lagg.avg_discount, lagg.n_parts, lagg.n_returned, lagg.target_amount,
         CASE WHEN lagg.target_amount >= 2000000 THEN 1 WHEN lagg.target_amount IS NOT NULL THEN 0 END AS target_flag,
         CASE WHEN oagg.n_urgent + 2 > 10 THEN 10 ELSE oagg.n_urgent + 2 END AS score_1_10,
         CASE WHEN oagg.n_closed >= 5 THEN 'Promoter' WHEN oagg.n_closed >= 3 THEN 'Passive'
              WHEN oagg.n_closed IS NOT NULL THEN 'Detractor' END AS nps_category
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN oagg ON c.c_custkey = oagg.o_custkey
  LEFT JOIN lagg ON c.c_custkey = lagg.l_custkey)"""

BASKET_CTE = """
blines AS (
  SELECT l.l_orderkey,
         max(CASE WHEN p.p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS type_economy,
         max(CASE WHEN p.p_type = 'SMALL' THEN 1 ELSE 0 END) AS type_small,
         max(CASE WHEN p.p_type = 'MEDIUM' THEN 1 ELSE 0 END) AS type_medium,
         max(CASE WHEN p.p_type = 'PROMO' THEN 1 ELSE 0 END) AS type_promo,
         max(CASE WHEN p.p_type = 'STANDARD' THEN 1 ELSE 0 END) AS type_standard,
         max(CASE WHEN p.p_type = 'LARGE' THEN 1 ELSE 0 END) AS type_large,
         max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
         count(*) AS n_lines, sum(l.l_quantity) AS tot_qty
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey),
basket AS (
  SELECT o.o_orderkey AS id, b.type_economy, b.type_small, b.type_medium, b.type_promo, b.type_standard,
         b.type_large, b.returned,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed,
         CASE WHEN b.n_lines >= 5 THEN 1 ELSE 0 END AS many_lines,
         CASE WHEN b.tot_qty >= 150 THEN 1 ELSE 0 END AS big_qty,
         CASE WHEN b.n_lines >= 5 AND b.tot_qty >= 150 THEN 1 ELSE 0 END AS bulk
  FROM orders o JOIN blines b ON o.o_orderkey = b.l_orderkey)"""

BASKET_ITEMS = ["type_economy", "type_small", "type_medium", "type_promo", "type_standard", "type_large",
                "returned", "urgent", "closed", "many_lines", "big_qty", "bulk"]

# Long form of the basket: one row per (basket, item present).
BASKET_LONG_CTE = BASKET_CTE + ",\nbl AS (\n" + "\n  UNION ALL ".join(
    f"SELECT id, '{c}' AS item FROM basket WHERE {c} = 1" for c in BASKET_ITEMS) + ")"


def with_profile(body: str) -> str:
    return "WITH " + PROFILE_CTE.strip() + "\n" + body


def with_basket(body: str, long: bool = False) -> str:
    return "WITH " + (BASKET_LONG_CTE if long else BASKET_CTE).strip() + "\n" + body


def with_both(body: str) -> str:
    return "WITH " + PROFILE_CTE.strip() + ",\n" + BASKET_CTE.strip() + "\n" + body
