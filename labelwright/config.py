"""Settings of the plans."""

from __future__ import annotations

from dataclasses import dataclass

from labelwright.fixed import limits as lim


@dataclass(frozen=True)
class RetrievalConfig:
    """How candidates are retrieved, fused and reranked."""

    top_k: int = lim.STREAM_TOP_K
    rerank_k: int = lim.RERANK_TOP_K
    rrf_k: int = lim.RRF_K
    status: str | None = "current"
    # Word indexed for an empty metadata column.
    null_token: str = "None"
    # Compare schedules by numeral, however they are spelled.
    canonical_schedules: bool = True
    intent_threshold: float = lim.INTENT_USE


@dataclass(frozen=True)
class LayoutConfig:
    """Image geometry assumed when the image itself is not at hand."""

    image_height: float = lim.DEFAULT_IMAGE_HEIGHT
    column_gap: float = lim.COLUMN_GAP_PX


@dataclass(frozen=True)
class EmbedderConfig:
    """Sentence model plugged in by ``functions.embed.model_embedder``."""

    model_name: str = "sentence-transformers/all-MiniLM-L6-v2"
    dimension: int = lim.EMBEDDING_DIM
    batch_size: int = 32
