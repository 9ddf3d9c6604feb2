"""Sources and sinks (survey A1-A6).

All readers return lazy DataFrames; writers go through the DataFrame writer,
so output is produced by the executors in parallel, never via the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read ``{root}/{name}.{fmt}``; NaN reads as NULL, as everywhere at ingest."""
    return nan_to_null(spark.read.format(fmt).load(f"{root.rstrip('/')}/{name}.{fmt}"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = False, multi_line: bool = False) -> DataFrame:
    """Header CSV (A1). An explicit schema avoids the inference pass over the
    whole file; ``infer=True`` reproduces type inference when none is known.
    Empty fields and ``NaN`` read as NULL so aggregates skip them. Quotes
    inside a quoted field are doubled; ``multi_line`` allows line ends there."""
    reader = spark.read.option("header", "true").option("nanValue", "NaN") \
        .option("nullValue", "").option("mode", "FAILFAST") \
        .option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true" if infer else "false")
    df = reader.csv(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on floating columns: Spark aggregates skip NULL, not NaN."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def resolve_source(spark: SparkSession, name: str, roots: Iterable[str],
                   overrides: Mapping[str, DataFrame] | None = None,
                   fmt: str = "parquet") -> DataFrame:
    """First existing ``{root}/{name}.{fmt}`` wins (A2).

    A caller-supplied DataFrame (or a registered temp view of that name when
    ``overrides`` holds the string ``"view"``) beats any file on disk.
    """
    if overrides and name in overrides:
        over = overrides[name]
        return spark.table(name) if isinstance(over, str) else over
    tried = []
    for root in roots:
        path = f"{root.rstrip('/')}/{name}.{fmt}"
        tried.append(path)
        if path_exists(spark, path):
            return nan_to_null(spark.read.format(fmt).load(path))
    raise FileNotFoundError(f"cannot find table {name!r}; looked in: " + ", ".join(tried))


def table_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table (A3), one row per table, one Spark job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table_name"), "n_rows",
                       F.lit(len(df.columns)).alias("n_cols"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flatten_for_text(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Arrays become sorted ``sep``-joined strings so text sinks accept them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.array_sort(F.col(f.name).cast("array<string>")), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV (A4). Executors write their own parts in parallel."""
    flatten_for_text(df).write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    return path


def write_results(sections: Mapping[str, DataFrame], path: str, fmt: str = "json",
                  mode: str = "overwrite") -> dict[str, str]:
    """One folder per result section (A5); native types, no driver round trip."""
    out = {}
    for name, df in sections.items():
        target = f"{path.rstrip('/')}/{name}"
        df.write.mode(mode).format(fmt).save(target)
        out[name] = target
    return out


def save_pipeline(model, path: str) -> str:
    """Persist a fitted ``PipelineModel`` (A6); feature lists live in its
    ``VectorAssembler`` stage."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
