"""State changes as deltas: a delta joined to the snapshot gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config
from cinderbase.functions import decay, text


def apply_delta(snapshot: DataFrame, delta: DataFrame, key: str = "ingest_seq", nulls: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot with the delta's columns replaced where they are not null; those named in ``nulls`` are replaced by nulls too.

    Unknown keys of the delta have no effect.
    """
    changed = [c for c in delta.columns if c != key]
    renamed = delta.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    joined = snapshot.join(renamed, key, "left")
    new = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in nulls else F.coalesce(F.col(f"_new_{c}"), F.col(c))
    return joined.select(*[new(c).alias(c) if c in changed else F.col(c) for c in snapshot.columns])


def delete(snapshot: DataFrame, ids: DataFrame, key: str = "ingest_seq") -> DataFrame:
    return snapshot.join(ids.select(key).distinct(), key, "left_anti")


def create(snapshot: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Add rows; a new row replaces one of the same key."""
    return snapshot.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links ``a, b, strength`` with new ones added up to a strength of 1; ends in any order."""
    canon = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "strength")
    old = canon(links).groupBy("a", "b").agg(F.max("strength").alias("old"))
    add = canon(new).groupBy("a", "b").agg(F.sum("strength").alias("add"))
    return old.join(add, ["a", "b"], "full_outer").select("a", "b", F.least(F.lit(1.0), F.coalesce("old", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("strength"))


def to_cold(cond: Column, now: int) -> dict[str, Column]:
    return {"is_cold": F.when(cond, True).otherwise(F.col("is_cold")), "cold_us": F.when(cond, F.lit(now)).otherwise(F.col("cold_us"))}


def to_hot(cond: Column) -> dict[str, Column]:
    return {
        "is_cold": F.when(cond, False).otherwise(F.col("is_cold")),
        "cold_us": F.when(~cond, F.col("cold_us")),
        "days_at_floor": F.when(cond, 0).otherwise(F.col("days_at_floor")),
    }


def to_stub(cond: Column) -> dict[str, Column]:
    """A stub keeps its id and the beginning of its content; it loses vector and stability and stays cold."""
    return {
        "content": F.when(cond, text.stub_text(F.col("content"))).otherwise(F.col("content")),
        "stability": F.when(cond, 0.0).otherwise(F.col("stability")),
        "vec": F.when(~cond, F.col("vec")),
        "is_cold": F.when(cond, True).otherwise(F.col("is_cold")),
        "is_stub": F.when(cond, True).otherwise(F.col("is_stub")),
    }


def migrate_cold(snapshot: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Count ticks at the floor; rows long at the floor and superseded rows go cold; core rows are exempt."""
    candidate = ~F.col("is_cold") & ~F.col("is_stub") & (F.col("category") != "core")
    floor = F.coalesce(decay.at_floor(now, cfg), F.lit(False))
    days = F.when(candidate & ~F.col("is_superseded"), F.when(floor, F.col("days_at_floor") + 1).otherwise(0)).otherwise(F.col("days_at_floor"))
    out = snapshot.withColumn("days_at_floor", days)
    move = candidate & (F.col("is_superseded") | (F.col("days_at_floor") >= cfg.cold_migration_days))
    return out.withColumns(to_cold(move, now))


def expire_cold(snapshot: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Cold rows beyond their time to live become stubs; core rows and rows without a date are exempt."""
    over = F.col("is_cold") & ~F.col("is_stub") & (F.col("category") != "core") & (decay.days_between(now, F.col("cold_us")) >= cfg.cold_storage_ttl_days)
    return snapshot.withColumns(to_stub(F.coalesce(over, F.lit(False))))
