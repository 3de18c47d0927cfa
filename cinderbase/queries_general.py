"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbase.operators import changefeed, timestamps
from cinderbase.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = changefeed.apply_feed(table(spark, sf_dir, "memory_log"))
    return state.select("entity_kind", "key_a", "key_b", "event_no")


ROW = ("user_id", "writer", "importance", "stability", "strength")


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory and link that exists, with its last written row."""
    return changefeed.apply_feed(table(spark, sf_dir, "memory_log"), ROW)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timestamps.normalise(table(spark, sf_dir, "memories"), table(spark, sf_dir, "client_apps"))
    return found.where("utc_micros IS NOT NULL").select("ingest_seq", "field_name", "utc_micros")


def p4_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source uses each notation, and how many of its values are no time."""
    found = timestamps.normalise(table(spark, sf_dir, "memories"), table(spark, sf_dir, "client_apps"))
    return found.groupBy("client", "notation").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("utc_micros").isNull()).alias("n_no_time"),
        F.count_if("ambiguous").alias("n_ambiguous"),
    )


def p4_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per client, of its ambiguous slash dates: how many the path reads in the declared order, without being told it."""
    memories, clients = table(spark, sf_dir, "memories"), table(spark, sf_dir, "client_apps")
    keys = ["ingest_seq", "field_name"]
    told = timestamps.normalise(memories, clients).where("ambiguous AND notation = 'slash'").select(*keys, "client", F.col("utc_micros").alias("told"))
    inferred = timestamps.normalise(memories, clients, declared=False).where("ambiguous AND notation = 'slash'").select(*keys, "utc_micros")
    both = inferred.join(told, keys)
    return both.groupBy("client").agg(F.count("*").alias("n_ambiguous"), F.count_if(F.col("told") == F.col("utc_micros")).alias("n_as_declared"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_notations": p4_notations, "p4_orders": p4_orders, "p5_found": p5_found, "p5_state": p5_state}


P5_SQL = r"""
WITH c AS (
  SELECT regexp_replace(lower(event_type), '[^a-z]', '', 'g') AS k, event_no, at_ms, writer_seq,
         nullif(lower(trim(memory_id, E' \t\n\r')), '') AS m, nullif(lower(trim(link_a, E' \t\n\r')), '') AS a,
         nullif(lower(trim(link_b, E' \t\n\r')), '') AS b,
         user_id, writer, importance, stability, strength
  FROM memory_log),
e AS (
  SELECT CASE WHEN k LIKE 'link%' THEN 'link' ELSE 'memory' END AS entity_kind,
         CASE WHEN k LIKE 'link%' THEN least(a, b) ELSE m END AS key_a,
         CASE WHEN k LIKE 'link%' THEN greatest(a, b) ELSE '' END AS key_b,
         k LIKE '%delete' AS gone, event_no, at_ms, writer_seq, user_id, writer, importance, stability, strength
  FROM c WHERE (k IN ('memory', 'memorydelete') AND m IS NOT NULL) OR (k IN ('link', 'linkdelete') AND a IS NOT NULL AND b IS NOT NULL)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY entity_kind, key_a, key_b
    ORDER BY at_ms DESC NULLS LAST, writer_seq DESC NULLS LAST, event_no DESC NULLS LAST) AS rn FROM e)
SELECT entity_kind, key_a, key_b, event_no FROM r WHERE rn = 1 AND NOT gone
"""


def oracle_sql() -> dict:
    row = "SELECT entity_kind, key_a, key_b, at_ms, writer_seq, event_no, user_id, writer, importance, stability, strength FROM r"
    return {"p5_found": P5_SQL, "p5_state": P5_SQL.replace("SELECT entity_kind, key_a, key_b, event_no FROM r", row)}
