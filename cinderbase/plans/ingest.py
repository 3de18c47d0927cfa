"""Ingestion: raw turns, extraction replies, embedding, links within a batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config
from cinderbase.functions import decay, text, vector


def raw_memories(conversations: DataFrame) -> DataFrame:
    """One episodic memory per turn line: ``conv_id, line, content, category, importance, stability``."""
    turns = conversations.select("conv_id", F.explode(text.raw_turns(F.col("conversation_text"))).alias("t"))
    importance = F.lit(DEFAULT.default_importance)
    return turns.select("conv_id", F.col("t.line").cast("long").alias("line"), "t.content", F.lit("episodic").alias("category"), (F.lit(0.0) + 0.3).alias("importance"), (0.1 + 0.2 * importance).alias("stability"))


def build(items: DataFrame, reply: Column, default_category: str = "episodic") -> DataFrame:
    """Memories of model replies, with trimmed contents, known categories and types, clamped importance."""
    rows = items.select("*", F.posexplode(text.parse_reply(reply)).alias("pos", "i"))
    category = F.lower(F.trim("i.category"))
    importance = F.coalesce(text.clamp_unit(F.col("i.importance").try_cast("double")), F.lit(0.5))
    rows = rows.withColumns({"content": F.trim("i.content"), "category": F.when(category.isin(*text.CATEGORIES), category).otherwise(default_category), "importance": importance})
    rows = rows.withColumns({
        "stability": 0.1 + 0.3 * F.col("importance"),
        "memory_type": F.when(F.col("i.memory_type").isin(*text.MEMORY_TYPES), F.col("i.memory_type")).otherwise("other"),
        "ttl_seconds": F.col("i.ttl_seconds").try_cast("int"),
        "source_turn_ids": F.transform("i.source_turn_ids", lambda t: t.cast("string")),
        "valid_from": F.try_to_timestamp("i.valid_from"), "valid_until": F.try_to_timestamp("i.valid_until"),
    })
    return rows.where("content <> ''").drop("i")


def batch_links(memories: DataFrame, batch: str, cfg: Config = DEFAULT) -> DataFrame:
    """Links between memories of one ingestion batch with cosine from the threshold: ``batch, a, b, weight``.

    A batch is one conversation, so its pairs are few; rows have the batch column, ``id`` and ``vec``.
    Vectors are normalised once before the join.
    """
    unit = memories.select(F.col(batch).alias("batch"), "id", vector.normalize(F.col("vec")).alias("u"))
    other = unit.select("batch", F.col("id").alias("b"), F.col("u").alias("v"))
    pairs = unit.select("batch", F.col("id").alias("a"), "u").join(other, "batch").where("a < b")
    pairs = pairs.withColumn("sim", F.round(vector.dot(F.col("u"), F.col("v")), 6)).where(F.col("sim") >= cfg.ingestion_link_threshold)
    return pairs.select("batch", "a", "b", F.round(decay.ingestion_weight(F.col("sim"), cfg), 6).alias("weight"))


EXTRACTION = "Extract the memories of this conversation as a JSON array of objects with content, category, importance, memory_type, valid_until and ttl_seconds.\n{custom}{conversation}"


def extraction_prompt(conversation: Column, custom: str = "") -> Column:
    """The prompt for one conversation; custom instructions stand before it."""
    return text.prompt(EXTRACTION, custom=F.lit(f"{custom.strip()}\n" if custom.strip() else ""), conversation=conversation)


def extract(conversations: DataFrame, complete: Callable[[str], str], column: str = "conversation_text") -> DataFrame:
    """Ask an injected model for each conversation, in Arrow batches; the reply is a column."""
    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: complete(t) if isinstance(t, str) else None)

    return conversations.withColumn("reply", ask(F.col(column)))
