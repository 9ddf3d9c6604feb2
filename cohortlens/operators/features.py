"""Feature preparation and exact, engine-neutral splits (survey F1-F4).

Splits are reproducible across engines and plans: rows are ordered by
``md5(seed ':' key)`` then key, and each stratum sends exactly its quota to
the test side. To avoid sorting a whole stratum in one task (a stratum can
hold a third of all rows), its last test row is found as an order statistic: rows are counted by
the first four hex digits of the hash (65,536 buckets), and only the one
bucket that holds that row is ranked. Every row is then compared with it in one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import scratch_path

_HASH_DIGITS = 4
# Quota and boundary tables have one row per stratum; they are broadcast,
# so the number of strata is checked against this bound first.
_MAX_STRATA = 100_000


# F1
def assemble(df: DataFrame, features: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=handle_invalid).transform(df)


# F2
def fit_zscore(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (scikit-learn ``StandardScaler``
    rule); a zero std is replaced by 1. One aggregate; 2 x d numbers return."""
    row = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}__m"], row[f"{c}__s"]
        out[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def apply_zscore(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def zscore(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / std_pop with statistics from ``fit_on`` (default: ``df``)."""
    return apply_zscore(df, fit_zscore(fit_on if fit_on is not None else df, cols), suffix)


def split_hash(key: str | Column, seed: int | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    # A NULL key hashes like any other value, so its rows stay in the split.
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit("\u0000"))))


def _quotas(counts: dict, test: float) -> dict:
    """Per-stratum test sizes: n_test = ceil(test * n); train sizes by
    largest remainder (ties -> stratum order), test = count - train."""
    n = sum(counts.values())
    n_test = int(math.ceil(test * n))
    n_train = n - n_test
    exact = {s: Fraction(c * n_train, n) for s, c in counts.items()}
    train = {s: int(math.floor(v)) for s, v in exact.items()}
    left = n_train - sum(train.values())
    order = sorted(counts, key=lambda s: (-(exact[s] - train[s]), s))
    for s in order[:left]:
        train[s] += 1
    return {s: counts[s] - train[s] for s in counts}


# F3
def stratified_split(df: DataFrame, key: str, label: str | None, test: float = 0.2, seed: int = 42,
                     out: str = "is_test") -> DataFrame:
    """Adds boolean ``out``. Rows with a NULL label are dropped (they belong
    to no stratum); rows with a NULL key stay. Exact quotas per stratum, identical for any engine that
    orders by the same hash."""
    spark = df.sparkSession
    strat = F.col(label) if label else F.lit(0)
    base = df.where(strat.isNotNull()) if label else df
    # First read: stratum, hash and key of every row, written; all that follows up to the last projection reads that.
    slim = base.select(strat.alias("__s"), split_hash(key, seed).alias("__h"), F.col(key).alias("__k"))
    path = scratch_path(spark, "split")
    slim.write.parquet(path)
    slim = spark.read.schema(slim.schema).parquet(path)
    bucket = F.conv(F.substring("__h", 1, _HASH_DIGITS), 16, 10).cast("int")
    # (stratum, bucket) counts: at most 65,536 rows per stratum.
    bc = slim.groupBy("__s", bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__c")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Strata are the label classes: a handful of rows reach the driver.
        counts = {r["__s"]: r["c"] for r in
                  bc.groupBy("__s").agg(F.sum("__c").alias("c")).limit(_MAX_STRATA + 1).collect()}
        if len(counts) > _MAX_STRATA:
            raise ValueError(f"more than {_MAX_STRATA} strata: stratify on a class label, not a key")
        if not counts:
            return base.withColumn(out, F.lit(False))
        quotas = _quotas(counts, test)
        qdf = spark.createDataFrame([(s, q) for s, q in quotas.items()],
                                    T.StructType([bc.schema["__s"], T.StructField("__q", T.LongType())]))
        w = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        cum = bc.join(F.broadcast(qdf), "__s").withColumn("__hi", F.sum("__c").over(w)).withColumn(
            "__lo", F.col("__hi") - F.col("__c"))
        # Per stratum with a quota: the bucket that holds its last test row, and which row of the bucket that is.
        edges = cum.where((F.col("__lo") < F.col("__q")) & (F.col("__hi") >= F.col("__q"))).select(
            "__s", "__b", (F.col("__q") - F.col("__lo")).alias("__n")).collect()
    finally:
        bc.unpersist()
    edge = spark.createDataFrame([tuple(r) for r in edges], T.StructType([slim.schema["__s"], T.StructField("__b", T.IntegerType()), T.StructField("__n", T.LongType())]))
    inside = slim.withColumn("__b", bucket).join(F.broadcast(edge), ["__s", "__b"])
    # Rows alike in hash and key collapse, so a key that repeats often is one row here.
    alike = inside.groupBy("__s", "__h", "__k", "__n").agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy("__s").orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, 0)
    alike = alike.withColumn("__hi", F.sum("__c").over(order))
    last = alike.where((F.col("__hi") >= F.col("__n")) & (F.col("__hi") - F.col("__c") < F.col("__n")))
    last = last.select("__s", F.col("__h").alias("__lh"), F.col("__k").alias("__lk"), (F.col("__hi") - F.col("__n")).alias("__over")).collect()
    bounds = spark.createDataFrame([tuple(r) for r in last], T.StructType([
        slim.schema["__s"], T.StructField("__lh", T.StringType()), T.StructField("__lk", slim.schema["__k"].dataType), T.StructField("__over", T.LongType())]))
    # Second read: every row is compared with its stratum's last test row.
    rows = base.withColumn("__s", strat).withColumn("__h", split_hash(key, seed)).join(F.broadcast(bounds), "__s", "left")
    here = F.struct("__h", F.col(key).alias("__k"))
    there = F.struct(F.col("__lh").alias("__h"), F.col("__lk").alias("__k"))
    if any(r["__over"] for r in last):
        # The last test row has equals beyond the quota: that many of them, by number, stay in the training side.
        equal = F.col("__lh").isNotNull() & (here == there)
        n = F.row_number().over(Window.partitionBy("__s", "__eq").orderBy(F.lit(0)))
        rows = rows.withColumn("__eq", equal)
        first = rows.where(~F.col("__eq")).withColumn("__t", F.col("__lh").isNotNull() & (here < there))
        rows = first.unionByName(rows.where("__eq").withColumn("__t", n > F.col("__over")))
    else:
        rows = rows.withColumn("__t", F.col("__lh").isNotNull() & (here <= there))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__t").alias(out))


# F4
def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Exact ``ceil(test * n)`` hold-out; the same rows for every target."""
    return stratified_split(df, key, None, test, seed, out)


#: Below this a further task costs an iterative fit more than it saves: boosting of 150 rounds runs some thousand jobs.
_ROWS_WORTH_A_TASK = 16_000


def size_partitions(df: DataFrame, rows_per_partition: int = 500_000) -> DataFrame:
    """Partition a training set by its size: ``ceil(rows / rows_per_partition)``
    partitions, and as many as there are cores once each has a task's worth of rows (coalesced down without a shuffle, or repartitioned up).
    Iterative MLlib fits run several jobs per iteration, so tiny inputs spread
    over many partitions pay task overhead, and huge ones need the parallelism."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    target = max(1, math.ceil(n / rows_per_partition), min(cores, math.ceil(n / _ROWS_WORTH_A_TASK)))
    current = df.rdd.getNumPartitions()
    if target < current:
        return df.coalesce(target)
    if target > current:
        return df.repartition(target)
    return df


def to_array(df: DataFrame, features: str | Sequence[str], out: str = "__x") -> DataFrame:
    """Features as ``array<double>``: from an array/vector column or a list of numeric columns."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    if isinstance(features, str):
        dt = df.schema[features].dataType
        if isinstance(dt, VectorUDT):
            return df.withColumn(out, vector_to_array(F.col(features)))
        if isinstance(dt, T.ArrayType):
            return df.withColumn(out, F.col(features).cast("array<double>"))
        features = [features]
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in features]))
