import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_vectors import brute, clouds, frame, maximal

from cinderbase.llm import neighbours, spectral


def spread_copies(spark, x, times):
    """The vectors repeated, each repetition in partitions of its own."""
    df = frame(spark, x)
    every = df.crossJoin(spark.range(times).withColumnRenamed("id", "k")).withColumn("ingest_seq", F.col("ingest_seq") + F.col("k") * len(x))
    return every.repartitionByRange(times, "k").drop("k")


def test_copies_of_all_batches_are_one_node(spark, monkeypatch):
    x = clouds(11, 5, 8, 60, 0.2)
    df = spread_copies(spark, x, 4)
    assert df.select(F.spark_partition_id()).distinct().count() > 1
    rows = spectral.fading(df)
    found, encoded, members = neighbours.search(rows, 8, 0.8, graph=True)
    assert encoded.count() == len(x) == found.count() and {r["weight"] for r in encoded.collect()} == {4}
    ids = {r["node"]: sorted(r["ids"]) for r in members.groupBy("node").agg(F.flatten(F.collect_list("members")).alias("ids")).collect()}
    assert sorted(map(tuple, ids.values())) == [tuple(i + k * len(x) for k in range(4)) for i in range(len(x))]


def test_groups_and_neighbours_of_copies(spark):
    x = clouds(12, 4, 6, 20, 0.3)
    df = spread_copies(spark, x, 3)
    y = np.concatenate([x] * 3)
    want, s = brute(y, 5, 0.85)
    groups = maximal(s, range(len(y)), 0.8)
    got = {(r["ingest_seq"], r["group_seq"]) for r in spectral.cluster(df).collect()}
    assert got == {(i, min(g)) for g in groups for i in g}
    near = neighbours.knn(df.select(F.col("ingest_seq").alias("id"), F.col("embedding").alias("vec")), 5, 0.85, exact=True)
    assert {(r["id"], r["neighbour"]) for r in near.collect()} == want


def test_the_graph_needs_no_estimate(spark):
    """With estimates that say nothing the graph still has every pair."""
    x = clouds(13, 3, 20, 30, 0.3)
    index = neighbours._train(len(x), 0.7, pd.DataFrame({"vec": list(x)}))
    nodes = neighbours._encode(index, 0.7, 1, [frame(spark, x).selectExpr("'' part", "ingest_seq id", "embedding vec", "1L weight").toPandas()])
    base = next(nodes).assign(code=0, length=0.0, align=1.0)
    base["node"] = base["rep"]
    asked = next(neighbours._ask(index, iter([base]), everywhere=True))
    _, s = brute(x, 5, 0.8)
    got = {int(i): 0 for i in range(len(x))}
    for block, q in asked.groupby("q_block"):
        out = neighbours._search(index, 8, 0.8, True, base[base["block"] == block], q.reset_index(drop=True))
        for n, d in zip(out["node"], out["degree"]):
            got[int(n)] += int(d)
    assert got == {i: int((s[i] >= 0.8).sum()) for i in range(len(x))}
