"""The streaming funnel equals the batch funnel on the same rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from cohortlens.operators import aggregates as agg
from cohortlens.sources.views import profile
from cohortlens.streaming import read_responses, start_funnel

STAGES = [("Total", None), ("Willing", "target_flag = 1"), ("High score", "score_1_10 >= 7")]


def test_stream_matches_batch(spark, tmp_path):
    p = profile(spark, SF_SMALL).select("id", "target_flag", "score_1_10")
    src = str(tmp_path / "in")
    # Two arrivals of response files.
    p.where(F.col("id") % 2 == 0).write.parquet(src + "/part=a")
    p.where(F.col("id") % 2 == 1).write.parquet(src + "/part=b")
    stream = read_responses(spark, src, p.schema.add("part", "string"))
    q = start_funnel(stream, STAGES, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    got = {r.stage: (r.n, r.pct) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    exp = {r.stage: (r.n, r.pct) for r in agg.funnel(p, STAGES).collect()}
    assert got == exp
