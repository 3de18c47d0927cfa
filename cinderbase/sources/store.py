"""The memory store: reading the snapshot with its defaults, versioned snapshots and the event log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbase.functions import vector
from cinderbase.session import table

DIMS = 64
ISO_SECONDS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def decode(rows: DataFrame) -> DataFrame:
    """Rows as stored to rows with defaults: null categories, flags and numbers filled, unusable vectors null."""
    return rows.select(
        "ingest_seq", "id", "user_id", "content",
        F.coalesce(F.nullif(F.lower(F.trim("category")), F.lit("")), F.lit("episodic")).alias("category"),
        F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.coalesce("stability", F.lit(0.1)).alias("stability"),
        F.col("retention").alias("cached"),
        F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
        F.coalesce("session_count", F.lit(0)).cast("long").alias("session_count"),
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("last_accessed_at").alias("accessed_us"),
        F.when(vector.usable(F.col("embedding"), DIMS), F.col("embedding")).alias("vec"),
        F.coalesce("is_cold", F.lit(False)).alias("is_cold"),
        F.unix_micros("cold_since").alias("cold_us"),
        F.coalesce("days_at_floor", F.lit(0)).alias("days_at_floor"),
        F.coalesce("is_superseded", F.lit(False)).alias("is_superseded"),
        F.coalesce("is_stub", F.lit(False)).alias("is_stub"),
        F.coalesce("memory_type", F.lit("other")).alias("memory_type"),
        F.unix_micros(F.when(F.col("valid_until").rlike(ISO_SECONDS), F.try_to_timestamp("valid_until", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))).alias("until_us"),
        "ttl_seconds",
    ).where("ingest_seq IS NOT NULL AND id IS NOT NULL")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(table(spark, sf_dir, "memories"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links without repeats: the highest weight and the last use of each."""
    a = table(spark, sf_dir, "associations").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return a.groupBy("src", "dst").agg(
        F.max("weight").alias("weight"),
        F.max(F.unix_micros(F.coalesce("last_co_retrieval", "created_at"))).alias("used_us"),
        F.min(F.unix_micros("created_at")).alias("created_us"),
    )


def hot() -> Column:
    return ~F.col("is_cold") & ~F.col("is_stub")


def cold() -> Column:
    return F.col("is_cold") & ~F.col("is_stub")


def filters(user: str | None = None, categories: tuple[str, ...] = (), min_retention: float | None = None, min_importance: float | None = None,
            created_after: int | None = None, created_before: int | None = None, include_superseded: bool = False) -> Column:
    """The conjunction of the given filters; stubs are always left out."""
    out = ~F.col("is_stub")
    if user is not None:
        out = out & (F.col("user_id") == user)
    if categories:
        out = out & F.col("category").isin(*categories)
    if min_retention is not None:
        out = out & (F.col("cached") >= min_retention)
    if min_importance is not None:
        out = out & (F.col("importance") >= min_importance)
    if created_after is not None:
        out = out & (F.col("created_us") >= created_after)
    if created_before is not None:
        out = out & (F.col("created_us") <= created_before)
    return out if include_superseded else out & ~F.col("is_superseded")


class Snapshots:
    """Versioned Parquet snapshots. A version counts once its manifest is there, and that appears by one rename.

    A crash before the rename leaves files without a manifest, which the next commit overwrites; readers see
    the version before throughout. Of two writers of one version the second fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest version with a manifest; 0 if there is none."""
        _, root, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return max([0, *(int(n[9:]) for n in names if n.startswith("MANIFEST.") and n[9:].isdigit())])

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.version()}")

    def commit(self, df: DataFrame) -> int:
        """Write the next version, then make its manifest appear."""
        new = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        self._publish(new)
        return new

    def _publish(self, new: int) -> None:
        jvm, root, fs = self._fs()
        staged, final = jvm.org.apache.hadoop.fs.Path(root, f"STAGED.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(root, f"MANIFEST.{new}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps({"version": new}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise RuntimeError(f"version {new} was written by another process")


LOG_SCHEMA = "type string, id string, a string, b string, strength double, content string, category string, importance double, stability double"
SEGMENT = r"\.(\d+)\.(\d+)$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of all log files: rolled-over ones by time and number, the base file last."""
    rows = spark.read.schema(LOG_SCHEMA).json(path).withColumn("file", F.col("_metadata.file_name"))
    start = F.col("_metadata.file_block_start")
    last = F.lit(2**62)
    return rows.select(
        "*", F.coalesce(F.nullif(F.regexp_extract("file", SEGMENT, 1), F.lit("")).cast("long"), last).alias("file_ts"),
        F.coalesce(F.nullif(F.regexp_extract("file", SEGMENT, 2), F.lit("")).cast("long"), last).alias("file_seq"), start.alias("block"), F.monotonically_increasing_id().alias("line"),
    )


def replay(log: DataFrame, key: list[str], order: list[str], gone: Column) -> DataFrame:
    """Last writer wins: the last row of each key, unless it is a deletion. Folded before the shuffle, so a hot key does no harm."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), F.struct(*order)).alias("last"))
    return last.select(*key, "last.*").where(~gone)


def append_log(events: DataFrame, path: str, max_lines: int = 200_000) -> None:
    """Append events as JSON lines; a file rolls over after ``max_lines``."""
    events.write.mode("append").option("maxRecordsPerFile", max_lines).json(path)
