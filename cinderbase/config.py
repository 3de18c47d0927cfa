"""All knobs of the memory engine with their defaults; values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    faint_threshold: float = 0.15
    decay_model: str = "exponential"
    power_decay_gamma: float = 1.4427
    direct_boost: float = 0.1
    associative_boost: float = 0.03
    max_spaced_rep_multiplier: float = 2.0
    spaced_rep_interval_days: float = 7.0
    core_access_threshold: int = 10
    core_stability_threshold: float = 0.85
    core_session_threshold: int = 3
    association_strengthen_amount: float = 0.1
    association_retrieval_threshold: float = 0.3
    association_decay_constant_days: float = 90.0
    consolidation_retention_threshold: float = 0.20
    consolidation_group_size: int = 5
    consolidation_similarity_threshold: float = 0.70
    cold_migration_days: int = 7
    cold_storage_ttl_days: int = 180
    deep_recall_penalty: float = 0.5
    hybrid_search: bool = False
    k_sparse: int = 30
    filter_expired_transients: bool = True
    include_expired_in_deep_recall: bool = True
    graph_expansion_hops: int = 1
    bridge_discovery: bool = False
    max_bridge_paths: int = 3
    min_bridge_edge_weight: float = 0.3
    rerank_enabled: bool = False
    k_rerank: int = 10
    retrieval_score_exponent: float = 0.3
    run_maintenance_during_ingestion: bool = True
    custom_extraction_instructions: str = ""
    extraction_mode: str = "semantic"
    embedding_dimensions: int = 1536
    conflict_threshold: float = 0.85
    reinforcement_threshold: float = 0.75
    ingestion_link_threshold: float = 0.4
    ingestion_link_base: float = 0.2
    default_importance: float = 0.5
    default_stability: float = 0.3
    min_retention: float = 0.2
    core_retention_floor: float = 0.60
    regular_retention_floor: float = 0.02
    decay_days: dict = field(default_factory=lambda: {"episodic": 45.0, "semantic": 120.0, "core": 120.0})

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.endswith(("_threshold", "_boost", "_floor", "_penalty")) and isinstance(value, float):
                require_unit_interval(f.name, value)
        if self.decay_model not in ("exponential", "power"):
            raise ValueError("decay_model must be exponential or power")
        if self.extraction_mode not in ("semantic", "raw", "hybrid"):
            raise ValueError("extraction_mode must be semantic, raw or hybrid")


def require_non_empty(name: str, value: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    return value


def require_unit_interval(name: str, value: float) -> float:
    if not 0 <= value <= 1:  # NaN fails as well
        raise ValueError(f"{name} must be between 0 and 1")
    return value


def require_count(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer")
    return value


DEFAULT = Config()
