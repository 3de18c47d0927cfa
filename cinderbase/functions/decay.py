"""Retention, scores and boosts as column expressions. ``now`` is microseconds since 1970."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config

DAY_US = 86_400_000_000.0


def days_between(now: Column | int, then: Column) -> Column:
    """Fractional days since ``then``, never negative."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.greatest(F.lit(0.0), (now - then) / F.lit(DAY_US))


def floor(cfg: Config = DEFAULT) -> Column:
    return F.when(F.col("category") == "core", F.lit(cfg.core_retention_floor)).otherwise(F.lit(cfg.regular_retention_floor))


def base_days(cfg: Config = DEFAULT) -> Column:
    out = None
    for name, days in cfg.decay_days.items():
        out = F.when(F.col("category") == name, days) if out is None else out.when(F.col("category") == name, days)
    return out.otherwise(cfg.decay_days["episodic"])


def importance_boost() -> Column:
    return F.least(F.lit(3.0), 1 + F.col("importance") * 2)


def retention(now: int, cfg: Config = DEFAULT) -> Column:
    """Of a stub 0, without times the floor, of a procedural memory 1, else the decay above the floor."""
    last = F.coalesce("accessed_us", "created_us")
    rate = F.greatest(F.col("stability"), F.lit(0.01)) * importance_boost() * base_days(cfg)
    x = days_between(now, last) / rate
    raw = F.pow(1 + x, F.lit(-cfg.power_decay_gamma)) if cfg.decay_model == "power" else F.exp(-x)
    return F.when(F.col("is_stub"), 0.0).when(last.isNull(), floor(cfg)).when(F.col("category") == "procedural", 1.0).otherwise(F.greatest(floor(cfg), raw))


def score(similarity: Column, kept: Column, cfg: Config = DEFAULT) -> Column:
    return similarity * F.pow(kept, F.lit(cfg.retrieval_score_exponent))


def spaced_rep(now: int, cfg: Config = DEFAULT) -> Column:
    last = F.coalesce("accessed_us", "created_us")
    return F.coalesce(F.least(F.lit(cfg.max_spaced_rep_multiplier), days_between(now, last) / cfg.spaced_rep_interval_days), F.lit(1.0))


def boosted(now: int, boost: float, cfg: Config = DEFAULT) -> Column:
    return F.least(F.lit(1.0), F.col("stability") + F.lit(boost) * spaced_rep(now, cfg))


def update_stability(stability: Column, days: Column, boost: float = 0.1, cap: float = 2.0, interval: float = 7.0) -> Column:
    return F.least(F.lit(1.0), stability + F.lit(boost) * F.least(F.lit(cap), F.greatest(F.lit(0.0), days) / interval))


def link_weight(weight: Column, now: int, then: Column, cfg: Config = DEFAULT) -> Column:
    """A link's weight after decay; without a time it is undecayed."""
    return F.coalesce(weight * F.exp(-days_between(now, then) / cfg.association_decay_constant_days), weight)


def ingestion_weight(similarity: Column, cfg: Config = DEFAULT) -> Column:
    return F.least(F.lit(0.5), cfg.ingestion_link_base + (similarity - cfg.ingestion_link_threshold) * 0.5)


def promotable(cfg: Config = DEFAULT) -> Column:
    return (F.col("access_count") >= cfg.core_access_threshold) & (F.col("stability") >= cfg.core_stability_threshold) & (F.col("session_count") >= cfg.core_session_threshold) & (F.col("category") != "core")


def at_floor(now: int, cfg: Config = DEFAULT) -> Column:
    return F.abs(retention(now, cfg) - floor(cfg)) < 0.001


def expired(now: int) -> Column:
    """Plans and transient states whose validity or time to live has passed."""
    late = F.coalesce(F.lit(now) > F.col("until_us"), F.lit(False)) | F.coalesce(F.lit(now) > F.col("created_us") + F.col("ttl_seconds").cast("long") * 1_000_000, F.lit(False))
    return F.col("memory_type").isin("plan", "transient_state") & late
