"""One nested results document out of sections of different shapes (survey A5).

Each section is a DataFrame folded into one value: a record, a map, a map of maps or a list of rows. The
values are attached as scalar subqueries, so the document is one row of one plan, written as one JSON line
by one task. It is as large as the report it stands for: a section of more than ``limit`` entries is an error, not a cut.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of one section.
SECTION_LIMIT = 10_000


def _bounded(df: DataFrame, value: Column, limit: int) -> DataFrame:
    """One row with ``value``, an aggregate over the rows of ``df``, or an error if there are more than ``limit``."""
    few = df.limit(limit + 1)  # nothing beyond the first row too many is gathered
    too_many = F.raise_error(F.lit(f"a section of a results document has at most {limit} entries"))
    return few.agg(F.count(F.lit(1)).alias("n"), value.alias("v")).select(F.when(F.col("n") <= limit, F.col("v")).otherwise(too_many).alias("v"))


def as_record(df: DataFrame) -> DataFrame:
    """A one-row table as a struct of its columns."""
    return _bounded(df, F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 1)


def as_map(df: DataFrame, key: str, value: str, limit: int = SECTION_LIMIT) -> DataFrame:
    """key -> value, in the order of keys; rows without a key are left out, a repeated key is an error."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))
    return _bounded(rows, F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))), limit)


def as_nested_map(df: DataFrame, outer: str, inner: str, value: str, limit: int = SECTION_LIMIT) -> DataFrame:
    """outer -> inner -> value."""
    rows = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).select(
        F.col(outer).cast("string").alias("o"), F.col(inner).cast("string").alias("k"), F.col(value).alias("v")).limit(limit + 1)
    inside = rows.groupBy("o").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"), F.count(F.lit(1)).alias("n"))
    too_many = F.raise_error(F.lit(f"a section of a results document has at most {limit} entries"))
    # Maps cannot be compared, so the outer keys are sorted by themselves.
    entries = F.array_sort(F.collect_list(F.struct("o", "m")), lambda a, b: F.when(a["o"] < b["o"], -1).otherwise(1))
    return inside.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.map_from_entries(entries).alias("v")).select(
        F.when(F.col("n") <= limit, F.col("v")).otherwise(too_many).alias("v"))


def as_rows(df: DataFrame, order: list[str], limit: int = SECTION_LIMIT) -> DataFrame:
    """All rows as a list of structs, in ascending ``order``."""
    keys = F.struct(*[F.col(f"`{c}`") for c in order])
    rows = F.array_sort(F.collect_list(F.struct(keys.alias("k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return _bounded(df, F.transform(rows, lambda x: x["r"]), limit)


def results_document(spark: SparkSession, sections: Mapping) -> DataFrame:
    """One row with a column for each section; a section is a folded table (``as_...``) or a mapping of further sections."""
    def value(section) -> Column:
        if isinstance(section, Mapping):
            return F.struct(*[value(s).alias(name) for name, s in section.items()])
        return section.scalar()

    return spark.range(1).select(*[value(s).alias(name) for name, s in sections.items()])


def write_document(doc: DataFrame, path: str) -> T.StructType:
    """Write the document as one JSON line under ``path``; missing values are kept. Returns its schema, which reads it back."""
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return doc.schema


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_document(doc: DataFrame) -> DataFrame:
    """Every leaf of a document: path (names joined by dots, list places from 0), number and text, one of them null."""
    def leaf(path: Column, x: Column, kind: T.DataType) -> Column:
        text = isinstance(kind, (T.StringType, T.BooleanType, T.DateType, T.TimestampType))
        number, words = (F.lit(None).cast("double"), x.cast("string")) if text else (x.cast("double"), F.lit(None).cast("string"))
        return F.array(F.struct(path.alias("path"), number.alias("number"), words.alias("text")))

    def walk(path: Column, x: Column, kind: T.DataType) -> Column:
        dot = F.concat(path, F.lit("."))
        if isinstance(kind, T.StructType):
            return F.concat(*[walk(F.concat(dot, F.lit(f.name)), x[f.name], f.dataType) for f in kind.fields])
        if isinstance(kind, T.MapType):
            return F.flatten(F.transform(F.map_entries(x), lambda e: walk(F.concat(dot, e["key"]), e["value"], kind.valueType)))
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(x, lambda e, i: walk(F.concat(dot, i.cast("string")), e, kind.elementType)))
        return leaf(path, x, kind)

    parts = [walk(F.lit(f.name), F.col(f"`{f.name}`"), f.dataType) for f in doc.schema.fields]
    none = F.array().cast("array<struct<path:string,number:double,text:string>>")
    return doc.select(F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("l")).select("l.*")
