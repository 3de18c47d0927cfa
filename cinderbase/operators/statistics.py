"""Counts and statistics of the store, each in one pass."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config
from cinderbase.functions import decay
from cinderbase.sources.store import cold, hot


def tier_counts(m: DataFrame) -> DataFrame:
    return m.agg(F.count_if(hot()).alias("hot"), F.count_if(cold()).alias("cold"), F.count_if("is_stub").alias("stub"), F.count("*").alias("total"))


def stats(m: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    m = m.withColumn("r", F.when(~F.col("is_stub"), decay.retention(now, cfg)))
    return m.agg(
        F.count_if(hot()).alias("hot"), F.count_if(cold()).alias("cold"), F.count_if("is_stub").alias("stub"), F.count("*").alias("total"),
        F.count_if(~F.col("is_stub") & (F.col("category") == "core")).alias("core"), F.count_if(F.col("r") < cfg.faint_threshold).alias("faint"),
        F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 6).alias("avg_retention"),
    )


def group_summary(m: DataFrame, typical: int = 0) -> DataFrame:
    """Per category what a summary of its rows would carry, without gathering their contents."""
    return m.groupBy("category").agg(
        F.count("*").alias("n"), F.max("importance").alias("importance"), F.round(F.avg("stability"), 6).alias("stability"), F.max("access_count").alias("access_count")
    )


def token_usage(calls: DataFrame, *by: str) -> DataFrame:
    """Tokens of model calls ``prompt_tokens, completion_tokens``, summed over the stages of each key."""
    both = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    return calls.groupBy(*by).agg(F.sum(both[0]).alias("prompt_tokens"), F.sum(both[1]).alias("completion_tokens"), F.sum(both[0] + both[1]).alias("total_tokens"))
