"""Aggregations (survey C1-C18).

Each report is one ``agg`` or one ``groupBy().agg`` where possible, so the
scan happens once and partial aggregation runs map-side before the shuffle
(which also absorbs a hot group). Percentages use the total row count,
NULL rows included, taken from the same aggregate rather than a constant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.quantiles import one_row, summarize

_PIVOT_LIMIT = 1000


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def _q(name: str) -> str:
    return f"`{name}`"


# C1
def kpis(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One-row KPI table. ``specs`` = (output, kind, column) with kind in
    mean, median, share (share of 1s x 100), sum, count, std, min, max."""
    simple = []
    medians = []
    for out, kind, col in specs:
        x = _c(col)
        if kind == "mean":
            simple.append(F.avg(x).alias(out))
        elif kind == "share":
            simple.append((F.avg(x.cast("double")) * 100).alias(out))
        elif kind == "sum":
            simple.append(F.sum(x).alias(out))
        elif kind == "count":
            simple.append(F.count(x).alias(out))
        elif kind == "std":
            simple.append(F.stddev_samp(x).alias(out))
        elif kind == "min":
            simple.append(F.min(x).alias(out))
        elif kind == "max":
            simple.append(F.max(x).alias(out))
        elif kind == "median":
            medians.append((out, col))
        else:
            raise ValueError(f"unknown KPI kind {kind}")
    if not medians:
        return df.agg(*simple).select(*[o for o, _, _ in specs])
    # Medians need passes of their own; the plain aggregates ride on the
    # first of them, so the input is read once.
    inputs = [c for _, kind, c in specs if kind != "median"]
    if not all(isinstance(c, str) for c in inputs):
        inputs = df.columns  # expressions: their inputs are not known here
    st, q = summarize(df, [c for _, c in medians], [0.5], simple, inputs)
    res = one_row(df.agg(*simple), st, [o for o, kind, _ in specs if kind != "median"]) if simple \
        else df.sparkSession.range(1).drop("id")
    res = res.withColumns({out: F.lit(q[c][0]).cast("double") for out, c in medians})
    return res.select(*[o for o, _, _ in specs])


# C2
def spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.stddev_samp(c).alias(c) for c in cols])


# C3
def mean_profile(df: DataFrame, cols: Sequence[str], labels: Mapping[str, str] | None = None,
                 descending: bool = True, name_col: str = "item", value_col: str = "mean") -> DataFrame:
    """Mean of each item column in long form, sorted. Aggregates first, so
    the unpivot touches a single row."""
    wide = df.agg(*[F.avg(c).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), name_col, value_col)
    if labels:
        m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        long = long.withColumn(name_col, F.coalesce(F.try_element_at(m, F.col(name_col)), F.col(name_col)))
    order = F.col(value_col).desc() if descending else F.col(value_col).asc()
    return long.orderBy(order, F.col(name_col))


# C4
def frequency(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Counts per value, NULL dropped, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.col(count_col).desc(), F.col(col)))


# C5
def ordered_frequency(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.col(col)))


# C6
def frequency_pct(df: DataFrame, col: str, base: str = "all", digits: int | None = 1,
                  count_col: str = "n", pct_col: str = "pct") -> DataFrame:
    """C4 plus percentage. ``base='all'`` divides by every row (NULL rows
    included); ``base='non_null'`` by the counted rows only."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
    # The denominator is a scalar subquery (one aggregate, read as a
    # constant), not a window that would gather every distinct value in one
    # task.
    den = df.agg(F.count(F.lit(1)) if base == "all" else F.count(F.col(col))).scalar()
    pct = F.lit(100.0) * F.col(count_col) / F.nullif(den, F.lit(0))
    if digits is not None:
        pct = F.round(pct, digits)
    return (g.withColumn(pct_col, pct).where(F.col(col).isNotNull())
            .orderBy(F.col(count_col).desc(), F.col(col)))


# C7
def mode(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Most frequent non-null value; ties -> smallest value."""
    return frequency(df, col, count_col).limit(1)


# C8
def group_means(df: DataFrame, key: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols]).orderBy(*keys)


# C9
def group_summary(df: DataFrame, key: str | Sequence[str],
                  named_aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``named_aggs`` = {out: (column, fn)}; fn in count (non-null), mean,
    sum, min, max, std, median_approx."""
    keys = [key] if isinstance(key, str) else list(key)
    fns = {"count": F.count, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
           "std": F.stddev_samp, "median_approx": lambda c: F.percentile_approx(c, 0.5, 10000)}
    aggs = [fns[fn](F.col(col)).alias(out) for out, (col, fn) in named_aggs.items()]
    return df.groupBy(*keys).agg(*aggs).orderBy(*keys)


# C10
def group_means_ordered(df: DataFrame, key: str, col: str, order: Sequence, keep_missing: bool = True,
                        out: str = "mean", pos_col: str = "pos") -> DataFrame:
    """Group mean re-indexed to a fixed label order. Labels absent from the
    data give a NULL row (``keep_missing``) or are dropped; labels outside
    the order are dropped."""
    spark = df.sparkSession
    ord_df = spark.createDataFrame([(v, i) for i, v in enumerate(order)], [key, pos_col]).select(
        F.col(key).cast(df.schema[key].dataType), F.col(pos_col).cast("int"))
    # At most one mean per listed label: the side that can be broadcast.
    listed = [v for v in order if v is not None]
    agg = df.where(F.col(key).isin(listed)).groupBy(key).agg(F.avg(col).alias(out))
    how = "left" if keep_missing else "inner"
    return ord_df.join(F.broadcast(agg), key, how).orderBy(pos_col).select(pos_col, key, out)


# C11
def group_means_ranked(df: DataFrame, key: str, col: str, out: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(col).alias(out)).orderBy(F.col(out).desc(), F.col(key))


# C12
def count_where(df: DataFrame, predicates: Mapping[str, Column | str]) -> DataFrame:
    """One row, one conditional count per named predicate."""
    return df.agg(*[F.count_if(F.coalesce(F.expr(p) if isinstance(p, str) else p, F.lit(False))).alias(n)
                    for n, p in predicates.items()])


# C13
def funnel(df: DataFrame, stages: Sequence[tuple[str, Column | str | None]], cumulative: bool = False,
           digits: int | None = 1) -> DataFrame:
    """Stage counts and % of all rows. Stages are independent conditions by
    default (the reference's behaviour); ``cumulative`` ANDs each with the
    previous ones. A stage with condition ``None`` counts every row."""
    conds, acc = [], F.lit(True)
    for name, p in stages:
        c = F.lit(True) if p is None else (F.expr(p) if isinstance(p, str) else p)
        c = F.coalesce(c, F.lit(False))
        if cumulative:
            acc = acc & c
            c = acc
        conds.append((name, c))
    wide = df.agg(F.count(F.lit(1)).alias("__total"), *[F.count_if(c).alias(f"__s{i}") for i, (_, c) in enumerate(conds)])
    stack = ", ".join(f"{i}, '{n}', __s{i}" for i, (n, _) in enumerate(conds))
    long = wide.selectExpr("__total", f"stack({len(conds)}, {stack}) as (step, stage, n)")
    pct = F.lit(100.0) * F.col("n") / F.nullif(F.col("__total"), F.lit(0))
    if digits is not None:
        pct = F.round(pct, digits)
    return long.select(F.col("step").cast("int"), "stage", "n", pct.alias("pct")).orderBy("step")


# C14
_DESC_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max per column, long form
    (one row per column). Quartiles are exact unless ``approx``."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        if approx:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"{c}__q"))
    if approx:
        wide = df.agg(*aggs)
    else:
        # One pass for the plain statistics and the counts, one window job
        # for the quartiles of every column; the result is a computed table.
        st, q = summarize(df, cols, [0.25, 0.5, 0.75], aggs, cols)
        wide = one_row(df.agg(*aggs), st, [f"{c}__{k}" for c in cols for k in ("count", "mean", "std", "min", "max")])
        wide = wide.withColumns({f"{c}__q": F.array(*[F.lit(v).cast("double") for v in q[c]]) for c in cols})
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                        F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                        F.col(f"{c}__min").alias("min"), F.col(f"{c}__q")[0].cast("double").alias("p25"),
                        F.col(f"{c}__q")[1].cast("double").alias("p50"),
                        F.col(f"{c}__q")[2].cast("double").alias("p75"), F.col(f"{c}__max").alias("max"))
               for c in cols]
    long = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    if digits is not None:
        long = long.withColumns({k: F.round(k, digits) for k in ["mean", "std", "min", "p25", "p50", "p75", "max"]})
    return long


# C15
def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the top edge belongs to the last
    bin; empty bins are kept. A constant column is widened to +-0.5."""
    x = F.col(col).cast("double")
    base = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = base.agg(F.min("x").alias("mn0"), F.max("x").alias("mx0"))
    # Scalar subqueries: the range is computed once and read as a constant.
    mn = rng.select(F.when(F.col("mn0") == F.col("mx0"), F.col("mn0") - 0.5)
                    .otherwise(F.col("mn0"))).scalar()
    mx = rng.select(F.when(F.col("mn0") == F.col("mx0"), F.col("mx0") + 0.5)
                    .otherwise(F.col("mx0"))).scalar()
    idx = F.least(F.floor((F.col("x") - mn) * F.lit(bins) / (mx - mn)), F.lit(bins - 1)).cast("int")
    counts = base.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # The bin grid has ``bins`` rows (a parameter).
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (mx - mn) / F.lit(bins)
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (mn + F.col("bin") * step).alias("lo"),
                    (mn + (F.col("bin") + 1) * step).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n"))
            .orderBy("bin"))


# C16
def crosstab(df: DataFrame, row: str, col: str, normalize: str | None = "index", scale: float = 100.0,
             values: Sequence | None = None, digits: int | None = None) -> DataFrame:
    """Contingency table in long form (row, col, n, pct), zero cells kept.

    Rows with a NULL on either side are dropped (as after a decode). The
    column labels are pivoted with a known value list (no extra job when
    ``values`` is given); the long form is restored with ``stack``.
    """
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    if values is None:
        vals = [r[0] for r in base.select(col).distinct().limit(_PIVOT_LIMIT + 1).collect()]
        if len(vals) > _PIVOT_LIMIT:
            raise ValueError(f"crosstab column {col} has more than {_PIVOT_LIMIT} labels")
        values = sorted(vals)
    wide = base.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    names = [str(v) for v in values]
    tot = sum((F.col(_q(n)) for n in names), F.lit(0))
    stack = ", ".join(f"{_lit(v)}, {_q(n)}" for v, n in zip(values, names))
    long = wide.withColumn("__row_total", tot).selectExpr(
        row, "__row_total", f"stack({len(names)}, {stack}) as ({col}, n)")
    if normalize == "index":
        den = F.col("__row_total")
    elif normalize == "all":
        # Cells counted in the table (labels in ``values``): a scalar
        # subquery, not a window that gathers every row in one task.
        den = base.where(F.col(col).isin(list(values))).agg(F.count(F.lit(1))).scalar()
    elif normalize == "columns":
        # One row per column label: a bounded table, not a window over all cells of a label.
        sums = base.where(F.col(col).isin(list(values))).groupBy(F.col(col).alias("__label")).agg(F.count(F.lit(1)).alias("__col_total"))
        long = long.join(F.broadcast(sums), F.col(col) == F.col("__label"), "left")
        den = F.col("__col_total")
    else:
        den = None
    out = long.withColumn("n", F.col("n").cast("long"))
    if den is not None:
        pct = F.lit(scale) * F.col("n") / F.nullif(den, F.lit(0))
        out = out.withColumn("pct", F.round(pct, digits) if digits is not None else pct)
    return out.drop("__row_total", "__label", "__col_total").orderBy(row, col)


def crosstab_wide(df: DataFrame, row: str, col: str, values: Sequence, normalize: str | None = "index",
                  scale: float = 100.0) -> DataFrame:
    """The matrix form of :func:`crosstab`: one row per row label, one column
    per (known) column label, zero-filled; percentages when normalised."""
    long = crosstab(df, row, col, normalize=normalize, scale=scale, values=values)
    metric = "pct" if normalize else "n"
    wide = long.groupBy(row).pivot(col, list(values)).agg(F.first(metric))
    return wide.na.fill(0).orderBy(row)


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


# C17
def mean_of_group_means(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Unweighted mean over groups of each group's mean (benchmark lines)."""
    g = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])
    return g.agg(*[F.avg(c).alias(c) for c in cols])


# C18
def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long (column, min, max), one scan."""
    wide = df.agg(*[a for c in cols for a in (F.min(c).cast("double").alias(f"{c}__min"),
                                              F.max(c).cast("double").alias(f"{c}__max"))])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
               for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
