import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_vectors import brute, clouds, frame

from cinderbase.llm import neighbours


def written(spark):
    """The rows each stage has written to a shuffle, by stage."""
    ctx = spark.sparkContext
    stages = ctx._jsc.sc().statusStore().stageList(None, False, False, ctx._gateway.new_array(ctx._gateway.jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def small_blocks(monkeypatch, x, rows):
    """The index is fitted here, since the workers have the usual sizes."""
    for name, value in (("BLOCK", rows), ("SMALL_BLOCK", rows), ("QUERY_BLOCK", rows), ("WAVE", 1)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    monkeypatch.setattr(neighbours, "train", lambda df, margin, **kw: neighbours._train(len(x), margin, pd.DataFrame({"vec": list(x)})))


def test_no_stage_sends_the_vectors_many_times(spark, monkeypatch):
    """Queries that go to many blocks go in waves, and find the same."""
    x = clouds(21, 20, 20, 200, spread=0.3)
    small_blocks(monkeypatch, x, 128)
    df = frame(spark, x).select(F.col("ingest_seq").alias("id"), F.col("embedding").alias("vec"))
    before = set(written(spark))
    got = {(r["id"], r["neighbour"]) for r in neighbours.knn(df, 5, 0.85, exact=True).collect()}
    most = max(n for stage, n in written(spark).items() if stage not in before)
    assert got == brute(x, 5, 0.85)[0]
    assert most < 3 * len(x)


def test_who_asks_everywhere_in_waves(spark, monkeypatch):
    x = clouds(22, 10, 3, 170)
    small_blocks(monkeypatch, x, 64)
    df = frame(spark, x).select(F.col("ingest_seq").alias("id"), F.col("embedding").alias("vec"))
    got = neighbours.knn(df, 5, margin=0.0).collect()
    assert len(got) == 5 * len(x) == len({(r["id"], r["neighbour"]) for r in got}) and np.all([r["id"] != r["neighbour"] for r in got])


def test_members_are_joined_without_the_vectors(spark):
    rows = frame(spark, clouds(23, 4, 5, 20)).selectExpr("'' part", "ingest_seq id", "embedding vec")
    _, _, members = neighbours.search(rows, 3, 0.8)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(part#" in plan
    assert not any("blob" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)
