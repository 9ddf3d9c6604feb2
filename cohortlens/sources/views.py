"""Respondent-style views derived from the star-schema test tables.

``profile`` has one row per customer (stands for the wide respondent table);
``basket`` has one 0/1 item row per order (stands for the item matrix used by
rule mining). Both are plain DataFrame plans, so Catalyst prunes columns at
the Parquet scan and aggregates partially before every shuffle.

Scale notes: ``lineitem`` is the big side. It is joined to ``orders`` on the
order key (``orders`` is unique on that key, so
no key fans out), then aggregated per customer with map-side partial
aggregation, which also absorbs a hot customer. That join is dealt over as many
tasks as its lines need: distinct (customer, part) pairs are as good as
the lines themselves, so a task's hash table is as large as its share of them, and a share by
file splits would hold millions. Joins with data-sized tables are merge joins by hint: by the sizes of
compressed files all orders would pass through the driver as a broadcast. ``nation`` is a fixed
25-row dimension in TPC-H, so broadcasting it is bounded by the schema.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.io import read_table

# Fixed values of the fixture definition (FIXTURES.md section 2 and 3).
URGENT_PRIORITIES = ["1-URGENT", "2-HIGH"]
TIER_CUTS = [0.0, 2000.0, 4000.0, 6000.0, 8000.0]
TARGET_FLAG_CUT = 2000000.0
PART_TYPES = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"]
NATION_ROWS_BOUND = 25

#: Most lines that a task joins and counts; below the other number a further task is not worth its start.
_LINES_A_TASK = 500_000
_LINES_WORTH_A_TASK = 16_000


def _tier(col):
    expr = F.when(col.isNull(), F.lit(None))
    for i, cut in enumerate(TIER_CUTS):
        expr = expr.when(col < cut, F.lit(i + 1))
    return expr.otherwise(F.lit(len(TIER_CUTS) + 1))


def _line_tasks(lineitem: DataFrame) -> int:
    """Tasks for a join of all lines: by their number (from the file footers), and no fewer than cores where that pays."""
    n, cores = lineitem.count(), lineitem.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / _LINES_A_TASK), min(cores, math.ceil(n / _LINES_WORTH_A_TASK)))


def profile(spark: SparkSession, root: str) -> DataFrame:
    customer = read_table(spark, root, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, root, "nation").select("n_nationkey", "n_regionkey")
    orders = read_table(spark, root, "orders")
    lineitem = read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")

    per_order_cust = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"),
        F.max("o_totalprice").alias("max_price"),
        F.count_if(F.col("o_orderpriority").isin(URGENT_PRIORITIES)).alias("n_urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"),
    )
    tasks = _line_tasks(lineitem)
    buyers = orders.select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    lines = lineitem.repartition(tasks, "l_orderkey").join(buyers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Equal pairs meet in one of as many tasks again, so the table of distinct pairs is bounded alike.
    lines = lines.drop("l_orderkey", "o_orderkey").repartition(tasks, "o_custkey", "l_partkey")
    per_line_cust = lines.groupBy(F.col("o_custkey").alias("l_custkey")).agg(
        F.sum("l_quantity").alias("qty"),
        F.round(F.avg("l_discount"), 8).alias("avg_discount"),
        F.count_distinct("l_partkey").alias("n_parts"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("target_amount"),
    )
    joined = (customer
              .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
              .join(per_order_cust.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left")
              .join(per_line_cust.hint("merge"), F.col("c_custkey") == F.col("l_custkey"), "left"))
    amount = F.col("target_amount")
    urgent2 = F.col("n_urgent") + 2
    closed = F.col("n_closed")
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("n_regionkey") + 1).alias("region_code"),
        _tier(F.col("c_acctbal")).alias("tier_code"),
        F.col("c_acctbal").alias("balance"),
        "n_orders", "avg_price", "max_price", "n_urgent", "n_closed",
        "qty", "avg_discount", "n_parts", "n_returned", "target_amount",
        F.when(amount >= TARGET_FLAG_CUT, F.lit(1)).when(amount.isNotNull(), F.lit(0)).alias("target_flag"),
        F.when(urgent2 > 10, F.lit(10)).otherwise(urgent2).alias("score_1_10"),
        F.when(closed >= 5, F.lit("Promoter")).when(closed >= 3, F.lit("Passive"))
         .when(closed.isNotNull(), F.lit("Detractor")).alias("nps_category"),
    )


BASKET_ITEMS = [f"type_{t.lower()}" for t in PART_TYPES] + [
    "returned", "urgent", "closed", "many_lines", "big_qty", "bulk"]


def basket(spark: SparkSession, root: str) -> DataFrame:
    orders = read_table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lineitem = read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    part = read_table(spark, root, "part").select("p_partkey", "p_type")
    # Aggregate lines per order before meeting ``orders``: one row per order
    # crosses the second shuffle instead of one per line.
    per_order = (lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
                 .groupBy("l_orderkey").agg(
                     *[F.max(F.when(F.col("p_type") == t, 1).otherwise(0)).alias(f"type_{t.lower()}")
                       for t in PART_TYPES],
                     F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
                     F.count(F.lit(1)).alias("n_lines"),
                     F.sum("l_quantity").alias("tot_qty")))
    j = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    many = F.col("n_lines") >= 5
    big = F.col("tot_qty") >= 150
    return j.select(
        F.col("o_orderkey").alias("id"),
        *[F.col(f"type_{t.lower()}") for t in PART_TYPES],
        "returned",
        F.when(F.col("o_orderpriority").isin(URGENT_PRIORITIES), 1).otherwise(0).alias("urgent"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("closed"),
        F.when(many, 1).otherwise(0).alias("many_lines"),
        F.when(big, 1).otherwise(0).alias("big_qty"),
        F.when(many & big, 1).otherwise(0).alias("bulk"),
    )


def register_views(spark: SparkSession, root: str) -> None:
    """Register the source tables and both fixture views as temp views."""
    from cohortlens.sources.io import TABLES
    for name in TABLES:
        read_table(spark, root, name).createOrReplaceTempView(name)
    profile(spark, root).createOrReplaceTempView("profile")
    basket(spark, root).createOrReplaceTempView("basket")
