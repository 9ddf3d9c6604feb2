"""The count and funnel KPIs over a growing folder of respondent files.

The reference computes its KPI block and demand funnel in batch; when
responses arrive as files, the same aggregates run as a Structured Streaming
query: ``readStream`` over the folder, a global aggregate in ``complete``
mode (state is one row, so it never grows with the data), and a
``foreachBatch`` sink that rewrites the current table atomically per epoch.
The stage conditions are the same expressions as the batch ``funnel``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_responses(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over a folder of response files (explicit schema)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(folder)


def funnel_counts(stream: DataFrame, stages: Sequence[tuple[str, Column | str | None]]) -> DataFrame:
    """Running total plus one conditional count per stage (one state row)."""
    aggs = [F.count(F.lit(1)).alias("__total")]
    for name, p in stages:
        c = F.lit(True) if p is None else (F.expr(p) if isinstance(p, str) else p)
        aggs.append(F.count_if(F.coalesce(c, F.lit(False))).alias(name))
    return stream.agg(*aggs)


def to_long(counts: DataFrame, stages: Sequence[str], digits: int = 1) -> DataFrame:
    """(step, stage, n, pct of total) from the one-row running counts."""
    stack = ", ".join(f"{i}, '{n}', `{n}`" for i, n in enumerate(stages))
    long = counts.selectExpr("__total", f"stack({len(stages)}, {stack}) as (step, stage, n)")
    return long.select(F.col("step").cast("int"), "stage", "n",
                       F.round(F.lit(100.0) * F.col("n") / F.nullif(F.col("__total"), F.lit(0)), digits).alias("pct"))


def start_funnel(stream: DataFrame, stages: Sequence[tuple[str, Column | str | None]], out_path: str,
                 checkpoint: str, trigger_once: bool = False):
    """Start the streaming funnel; each epoch overwrites ``out_path`` with
    the current long table. ``checkpoint`` must be on shared storage so the
    query restarts where it stopped after a driver or executor loss."""
    names = [n for n, _ in stages]

    def write(batch: DataFrame, epoch: int) -> None:
        to_long(batch, names).write.mode("overwrite").parquet(out_path)

    w = (funnel_counts(stream, stages).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(write))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
