"""Ranking, ordering and running totals (survey D1-D5).

Un-partitioned windows (``Window.orderBy`` with no partition) gather all rows
in one task. They are used here only on k-row aggregates (cluster profiles,
model tables), never on raw rows. Running totals over large ordered data go
through :func:`ordered_cumsum`, which splits the order domain into ranges and
only windows inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_cols(keys: Sequence[str | tuple[str, str] | Column]) -> list[Column]:
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
        elif isinstance(k, tuple):
            name, direction = k
            out.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
        else:
            out.append(F.col(k).asc_nulls_last())
    return out


# D1
def average_rank(df: DataFrame, cols: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """Ascending rank with ties averaged, then truncated to an integer.

    For ties {1,2,2,3}: ranks 1, 2.5, 2.5, 4 -> 1, 2, 2, 4. ``df`` must be a
    small aggregate (one row per group).
    """
    out = df
    for c in cols:
        first = F.rank().over(Window.orderBy(F.col(c).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(F.col(c)))
        avg_rank = first + (ties - 1) / 2.0
        out = out.withColumn(f"{c}{suffix}", F.when(F.col(c).isNull(), F.lit(None))
                             .otherwise(F.floor(avg_rank).cast("int")))
    return out


# D2
def min_max_scale(df: DataFrame, cols: Sequence[str], eps: float = 1e-9, suffix: str = "") -> DataFrame:
    """(x - min) / (max - min + eps) across the rows of a small aggregate."""
    w = Window.partitionBy()
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + F.lit(eps))
        for c in cols})


# D3
def sort_by(df: DataFrame, keys: Sequence[str | tuple[str, str] | Column],
            tie_break: Sequence[str] = ()) -> DataFrame:
    """Total order: the given keys, then a unique tie-break key."""
    return df.orderBy(*_order_cols(keys), *_order_cols(tie_break))


# D4
def top_k(df: DataFrame, k: int, keys: Sequence[str | tuple[str, str] | Column],
          tie_break: Sequence[str] = ()) -> DataFrame:
    """Top-k; planned as ``TakeOrderedAndProject`` (per-partition top-k, then merge)."""
    return sort_by(df, keys, tie_break).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: Sequence[str],
                    keys: Sequence[str | tuple[str, str] | Column], rank_col: str = "rank") -> DataFrame:
    """Top-k within each group; Catalyst adds a ``WindowGroupLimit`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*_order_cols(keys))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# D5
def arg_best(df: DataFrame, metric: str, key: str, order: str = "max", group: Sequence[str] = ()) -> DataFrame:
    """Key with the best metric (ties -> smallest key), one row per group."""
    keys = [(metric, "desc" if order == "max" else "asc"), key]
    cols = [*group, key, metric]
    if not group:
        return top_k(df.select(*cols), 1, keys)
    return top_k_per_group(df.select(*cols), 1, group, keys).drop("rank")


def ordered_cumsum(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False,
                   n_ranges: int = 512, suffix: str = "_cum", next_cols: Sequence[str] = ()) -> DataFrame:
    """Inclusive running totals of ``value_cols`` along ``order_col``.

    ``order_col`` must be unique in ``df`` (aggregate per distinct value
    first). The order domain is cut into ``n_ranges`` ranges from approximate
    quantiles; per-range totals (``n_ranges`` rows) give each range its
    offset, and the window runs inside each range only, so no task ever holds
    more than about ``rows / n_ranges`` rows.
    """
    key = F.col(order_col).cast("double")
    if descending:
        key = -key
    work = df.withColumn("__ord", key)
    grid = [i / n_ranges for i in range(1, n_ranges)]
    row = work.agg(F.percentile_approx("__ord", grid, 10 * n_ranges).alias("s")).first()
    splits = sorted(set(v for v in (row["s"] or []) if v is not None))
    splits = [float("-inf")] + splits + [float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="__ord", outputCol="__rng",
                          handleInvalid="keep").transform(work)
    totals = bucketed.groupBy("__rng").agg(*[F.sum(c).alias(f"__t_{c}") for c in value_cols])
    # ``totals`` has at most n_ranges + 2 rows (a parameter), so one window over
    # it and a broadcast of it are both bounded.
    wo = Window.orderBy("__rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__rng", *[F.coalesce(F.sum(f"__t_{c}").over(wo), F.lit(0)).alias(f"__o_{c}")
                                       for c in value_cols])
    w = Window.partitionBy("__rng").orderBy("__ord").rowsBetween(Window.unboundedPreceding, 0)
    out = bucketed.join(F.broadcast(offsets), "__rng")
    out = out.withColumns({f"{c}{suffix}": F.sum(c).over(w) + F.col(f"__o_{c}") for c in value_cols})
    if next_cols:
        # ``next_<c>``: value of the following row in order. Inside a range it
        # is a lead(); the last row of a range takes the first row of the next
        # non-empty range, found on the per-range table (n_ranges rows).
        wr = Window.partitionBy("__rng").orderBy("__ord")
        out = out.withColumns({f"__lead_{c}": F.lead(c).over(wr) for c in next_cols})
        firsts = bucketed.groupBy("__rng").agg(*[F.min_by(c, F.col("__ord")).alias(f"__f_{c}") for c in next_cols])
        wn = Window.orderBy("__rng")
        nxt = firsts.select("__rng", *[F.lead(f"__f_{c}").over(wn).alias(f"__n_{c}") for c in next_cols])
        out = out.join(F.broadcast(nxt), "__rng").withColumns(
            {f"next_{c}": F.coalesce(F.col(f"__lead_{c}"), F.col(f"__n_{c}")) for c in next_cols})
        out = out.drop(*[f"__lead_{c}" for c in next_cols], *[f"__n_{c}" for c in next_cols])
    return out.drop("__ord", "__rng", *[f"__o_{c}" for c in value_cols])
