"""Streams give what the batch operators give."""

from cinderbase import queries_memory as qm


def test_stream_boost_equals_replay(spark, data):
    stream = {r["memory_seq"]: r for r in qm.stream_boost(spark, data).collect()}
    batch = {r["memory_seq"]: r for r in qm.boost_replay(spark, data).collect()}
    assert stream.keys() == batch.keys() and stream
    same = sum(abs(stream[k]["stability"] - batch[k]["stability"]) < 1e-6 for k in stream)
    assert same == len(stream)


def test_stream_changes_equals_feed(spark, data):
    from cinderbase.queries_general import p5_found

    want = {r["entity_kind"]: r["count"] for r in p5_found(spark, data).groupBy("entity_kind").count().collect()}
    assert {r["entity_kind"]: r["n"] for r in qm.stream_changes(spark, data).collect()} == want


def test_access_counts(spark, data, tmp_path):
    from cinderbase.streaming import boosts

    counts = boosts.stream_access_counts(qm._stream(spark, data, "access_log"))
    q = counts.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_jobs_after_every_nth_batch():
    from cinderbase.streaming.boosts import every

    done = []
    sink = every(5, lambda: done.append(1))
    for k in range(12):
        sink(None, k)
    assert len(done) == 2
