"""Streaming variants: the change log kept as a state, and the accesses that stability is made of.

Both are extensions; the engine itself has no streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cinderbase.operators import changefeed


def stream_changes(spark: SparkSession, source: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of a change feed as a run of a store; ``changefeed.merge_runs`` reads the state.

    A batch that is delivered again after a failure writes the same changes once more, which the merge
    folds away, so the state is exact without transactions.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        changefeed.append_run(changefeed.canonical_changes(batch), store, int(batch_id))

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_access_counts(source: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Accesses and distinct sessions per memory and day, with late accesses up to the delay."""
    root = F.regexp_replace("session_id", "_perspective_.*$", "")
    return (
        source.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 day").alias("day"), "memory_seq")
        .agg(F.count("*").alias("n_accesses"), F.approx_count_distinct(root).alias("n_sessions"))
    )


def stream_accesses(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the accesses of each micro-batch under the path: ``memory_seq, ts``; ``maintain.replay_boosts`` makes the stability of them.

    Nothing is dropped for being late, and an access that is delivered again counts once in the replay,
    so the stability does not depend on the number of files and batches or their order.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.where("memory_seq IS NOT NULL AND ts IS NOT NULL").select("memory_seq", "ts").distinct().write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(source: DataFrame, idle: str = "30 days") -> DataFrame:
    """Exact numbers of distinct sessions per memory as they grow; a session's entry leaves the state when it is older than ``idle``.

    The state holds one entry for each memory and session, spread over all tasks, so a hot memory is no hot key.
    The rows are first sights of a session: add up ``n_sessions`` per memory (append mode).
    """
    root = F.regexp_replace("session_id", "_perspective_.*$", "")
    seen = source.where("memory_seq IS NOT NULL AND session_id IS NOT NULL").select("memory_seq", root.alias("root"), "ts").withWatermark("ts", idle)
    return seen.dropDuplicatesWithinWatermark(["memory_seq", "root"]).select("memory_seq", "root", F.lit(1).alias("n_sessions"))


def every(n: int, job: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that runs a job after each n-th batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id % n == n - 1:
            job()

    return run
