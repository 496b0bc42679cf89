"""Settings of the engine as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    rrf_k: int = 60
    vector_weight: float = 0.6
    keyword_weight: float = 0.4
    route_top_k: int = 10
    top_k: int = 5
    max_rewrites: int = 3
    rerank: bool = False
    rerank_top_k: int = 5
    min_year_hits: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25


@dataclass(frozen=True)
class Chunking:
    size: int = 500
    overlap: int = 100
    window_size: int = 512
    window_overlap: int = 50


@dataclass(frozen=True)
class AnswerPolicy:
    cite_required: bool = True
    refuse_if_low_confidence: bool = True
    min_confidence: float = 0.6
    page_window: int = 5


@dataclass(frozen=True)
class Resilience:
    max_attempts: int = 3
    backoff_multiplier: float = 1.0
    backoff_max: float = 10.0
    total_seconds: float = 30.0
    breaker_failures: int = 5
    breaker_seconds: float = 60.0


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    chunking: Chunking = field(default_factory=Chunking)
    policy: AnswerPolicy = field(default_factory=AnswerPolicy)
    resilience: Resilience = field(default_factory=Resilience)

    @classmethod
    def from_nested(cls, values: dict) -> Settings:
        """Settings from a nested mapping such as a parsed file; what is missing keeps its default, unknown keys are ignored."""
        parts = {}
        for name, kind in (("retrieval", Retrieval), ("chunking", Chunking), ("policy", AnswerPolicy), ("resilience", Resilience)):
            given = values.get(name) or {}
            parts[name] = kind(**{k: given[k] for k in kind.__dataclass_fields__ if k in given})
        return cls(**parts)


DEFAULT = Settings()
