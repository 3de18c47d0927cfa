"""Applying a change feed of inserts, updates and deletes as a log-structured merge.

Runs
    ``append_run`` reduces a batch of changes to the last change of each key and appends it to a store as
    one run. A store is a table bucketed by key and sorted by key within its buckets, with a partition for
    each run. Deletes stay in the run as tombstones, because an older run may still hold the row they remove.
Merge on read
    ``merge_runs`` reads each bucket of all runs in one task, without a shuffle, and merges the sorted runs
    there (Spark's sort finds the sorted stretches and merges them), then keeps the last change of each key
    in one pass. A run holds a key once, so a hot key has no more rows there than there are runs.
    Tombstones that win are dropped.
Compaction
    ``compact`` replaces many runs by one, bucket by bucket and again without a shuffle. A full compaction
    may drop tombstones, a partial one keeps them.

Order: changes of one key take effect by ``at_ms``, equal times by ``writer_seq``, then by
``event_no``; nulls come first. Repeated deliveries carry the same number and fold into one.

Defined cases: an unknown event type, or a change without its key, is ignored; keys are trimmed and
lower case; a delete of an unknown row has no effect; an empty feed gives an empty state; extra
columns of the feed are carried in the winning row unless their name clashes with a column of the
result, in which case the result's own wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderbase.session import new_table, table_path

SEQUENCE = ("at_ms", "writer_seq", "event_no")
#: Lines of a run at least, and runs of a feed at most, by default.
RUN_ROWS, MOST_RUNS = 5_000, 24
#: Lines of a feed for each bucket of its store, and the fewest and most buckets.
BUCKET_LINES, FEW_BUCKETS, MOST_BUCKETS = 250_000, 8, 65_536
STATE_KEY = ("entity_kind", "key_a", "key_b")


def _norm(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def canonical_changes(feed: DataFrame, payload: tuple[str, ...] = (), *keep: str) -> DataFrame:
    """Changes with canonical kind, key, sequence and tombstone flag; rows without a key are left out. Columns to ``keep`` stay beside them."""
    kind = F.regexp_replace(F.lower(F.col("event_type")), r"[^a-z]", "")
    a, b, m = _norm(F.col("link_a")), _norm(F.col("link_b")), _norm(F.col("memory_id"))
    is_link = kind.startswith("link")
    known = kind.isin("memory", "memorydelete", "link", "linkdelete")
    out = feed.select(
        *keep,
        F.when(is_link, "link").otherwise("memory").alias("entity_kind"),
        F.when(is_link, F.least(a, b)).otherwise(m).alias("key_a"),
        F.when(is_link, F.greatest(a, b)).otherwise(F.lit("")).alias("key_b"),
        kind.endswith("delete").alias("tombstone"),
        F.struct(*[F.col(c).alias(c) for c in SEQUENCE]).alias("seq"),
        F.struct(*[F.col(c).alias(c) for c in payload]).alias("row") if payload else F.lit(None).cast("struct<x:int>").alias("row"),
        (known & F.when(is_link, a.isNotNull() & b.isNotNull()).otherwise(m.isNotNull())).alias("usable"),
    )
    return out.where("usable").drop("usable")


def fold(changes: DataFrame, *extra: str) -> DataFrame:
    """The last change of each key (and of each value of the extra columns)."""
    return (
        changes.groupBy(*extra, *STATE_KEY)
        .agg(F.max(F.struct("seq", "tombstone", "row")).alias("last"))
        .select(*extra, *STATE_KEY, "last.seq", "last.tombstone", "last.row")
    )


def new_store(spark: SparkSession) -> str:
    """The name of a new store in the shared folder; the first append makes it."""
    return new_table(spark, "runs")


def append_run(changes: DataFrame, store: str, run: int, buckets: int = FEW_BUCKETS) -> None:
    """Append one batch of canonical changes as a run, sorted by key within its buckets."""
    append_runs(changes, F.lit(run), store, buckets)


def append_runs(changes: DataFrame, run: Column, store: str, buckets: int = FEW_BUCKETS) -> None:
    """Append several runs in one job; ``run`` numbers them. All appends to a store have the same number of buckets."""
    # folded before the first exchange, so that a hot key is small when it is sent to its bucket
    folded = fold(changes.withColumn("run", run.cast("int")), "run")
    _write(folded.repartition(buckets, *STATE_KEY), store, buckets)


def _write(rows: DataFrame, store: str, buckets: int) -> None:
    writer = rows.write.mode("append").format("parquet").option("path", table_path(rows.sparkSession, store))
    writer.bucketBy(buckets, *STATE_KEY).sortBy(*STATE_KEY).partitionBy("run").saveAsTable(store)


def merge_runs(spark: SparkSession, store: str, keep_tombstones: bool = False) -> DataFrame:
    """The state after all runs of a store: the last change of each key."""
    newer = F.lead("seq").over(Window.partitionBy(*STATE_KEY).orderBy("seq", "tombstone"))
    last = spark.table(store).withColumn("newer", newer).where("newer IS NULL")
    state = last.select(*STATE_KEY, "seq", "tombstone", "row")
    return state if keep_tombstones else state.where(~F.col("tombstone"))


def compact(spark: SparkSession, store: str, buckets: int = FEW_BUCKETS, full: bool = True) -> str:
    """A new store that holds the runs of another as one run; a full compaction drops tombstones."""
    target = new_store(spark)
    _write(merge_runs(spark, store, keep_tombstones=not full).withColumn("run", F.lit(-1)), target, buckets)
    return target


def apply_feed(feed: DataFrame, payload: tuple[str, ...] = (), run_rows: int | None = None, compact_after: int = 8) -> DataFrame:
    """The state after a whole feed: append runs, compact whenever there are ``compact_after``, merge on read.

    ``log_line`` is the order of arrival; a run holds ``run_rows`` lines of it. By default a feed makes
    as many runs of ``RUN_ROWS`` lines as it needs, but at most ``MOST_RUNS``.
    """
    spark = feed.sparkSession
    if "log_line" not in feed.columns:
        feed = feed.withColumn("log_line", F.lit(0))
    size = feed.agg(F.max("log_line").alias("last"), F.count("*").alias("n")).first()
    last = max(0, size["last"] or 0)
    buckets = int(min(MOST_BUCKETS, max(FEW_BUCKETS, -(-size["n"] // BUCKET_LINES))))
    if run_rows is None:
        run_rows = max(RUN_ROWS, -(-(last + 1) // MOST_RUNS))
    line = F.greatest(F.col("log_line"), F.lit(0))
    store = new_store(spark)
    for first in range(0, last // run_rows + 1, compact_after):
        if first:
            # tombstones stay, since an earlier change of a deleted key may arrive in a later run
            store = compact(spark, store, buckets, full=False)
        due = F.col("log_line") < (first + compact_after) * run_rows
        due = due & (F.col("log_line") >= first * run_rows) if first else due | F.col("log_line").isNull()
        numbered = feed.where(due).withColumn("_run", F.coalesce(F.floor(line / F.lit(run_rows)), F.lit(0)).cast("int"))
        changes = canonical_changes(numbered, payload, "_run")
        append_runs(changes, F.col("_run"), store, buckets)
    state = merge_runs(spark, store)
    return state.select(*STATE_KEY, *[f"seq.{c}" for c in SEQUENCE], *[F.col(f"row.{c}").alias(c) for c in payload if c not in (*STATE_KEY, *SEQUENCE)])
