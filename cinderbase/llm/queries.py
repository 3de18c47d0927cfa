"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbase.llm import leaks, mixing, neighbours, privacy, spectral, truncation
from cinderbase.session import table


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redact(table(spark, sf_dir, "memories"), table(spark, sf_dir, "name_lexicon"), secret="a key kept outside the data")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds that the redaction replaced in each memory."""
    return privacy.kinds_found(_redacted(spark, sf_dir)).select(F.col("row_key").alias("ingest_seq"), "kind")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir).select(F.col("row_key").alias("ingest_seq"), F.col("redacted").alias("content"), "n_mentions")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.cluster(table(spark, sf_dir, "memories")).select("ingest_seq", "group_seq")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "memories")
    return spectral.describe(spectral.cluster(memories), memories)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories").select(F.col("ingest_seq").alias("id"), F.col("embedding").alias("vec"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.knn(_vectors(spark, sf_dir), k=5, min_sim=0.85)
    return near.select(F.least("id", "neighbour").alias("seq_a"), F.greatest("id", "neighbour").alias("seq_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other memories of every memory, however far they are, with their similarity."""
    near = neighbours.knn(_vectors(spark, sf_dir), k=5, margin=neighbours.FAR_MARGIN)
    return near.select(F.col("id").alias("ingest_seq"), F.col("neighbour").alias("neighbour_seq"), F.col("sim").alias("cosine"), "rank")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.leaked(found).select("item_id", "doc_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: in how many documents it leaked, verbatim or with other values."""
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.leaked(found).groupBy("item_id", "kind").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("window_share").alias("max_share"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of a mix of as many tokens as there are: a row for each use of a document, with its place in the stream."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).selection


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its shares: target, tempered and actual share of each source, its tokens, the most uses of one text, and the exponent."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixed.shares.withColumn("exponent", F.lit(round(mixed.exponent, 9)))


def p7_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of the largest mix that meets every target share as it is."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), exact=True).selection


def p7_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), exact=True)
    return mixed.shares.withColumn("exponent", F.lit(round(mixed.exponent, 9)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect(table(spark, sf_dir, "documents")).where("cut").select(F.col("row_key").alias("doc_id"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.source_rates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_clusters": p2_clusters, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p6_found": p6_found, "p6_items": p6_items, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_mix_exact": p7_mix_exact, "p7_shares_exact": p7_shares_exact, "p8_found": p8_found, "p8_rates": p8_rates}


def oracle_sql() -> dict:
    return {}
