"""Hybrid retrieval for a table of queries: four streams, fusion, reranking."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.config import RetrievalConfig
from labelwright.functions.citations import canonical_schedule, reference
from labelwright.functions.embed import Embedder, pair_context
from labelwright.functions.text import first_truthy
from labelwright.operators.dense import dense_topk
from labelwright.operators.exact import exact_matches, ranked_exact
from labelwright.operators.fuse import fuse
from labelwright.operators.index import with_status
from labelwright.operators.intent import normalize_intent
from labelwright.operators.lexical import bm25_topk, build_index
from labelwright.operators.rerank import rerank
from labelwright.session import fits, small_side


def query_text(raw: Column | None = None, query: Column | None = None, terms: Column | None = None) -> Column:
    """Text a query is searched by: the raw string, else the query, else its terms joined."""
    parts = [c for c in (raw, query) if c is not None]
    if terms is not None:
        parts.append(F.array_join(terms, " "))
    return F.coalesce(first_truthy(*parts), F.lit(""))


def understand(queries: DataFrame, text: str = "query", catalogue: list[dict] | None = None) -> DataFrame:
    """Add the explicit references and the intent of each query."""
    return normalize_intent(queries.withColumn("reference", reference(F.col(text))), text, "intent", catalogue)


def _matchable(corpus: DataFrame, config: RetrievalConfig) -> DataFrame:
    if config.canonical_schedules and "schedule" in corpus.columns:
        return corpus.withColumn("schedule", canonical_schedule(F.col("schedule")))
    return corpus


def retrieve(
    queries: DataFrame, corpus: DataFrame, embed: Embedder | None = None, config: RetrievalConfig = RetrievalConfig(),
    catalogue: list[dict] | None = None,
) -> DataFrame:
    """Fused candidates of each query: ranks, scores, sources, and the chunk itself.

    queries: query_id, query.  corpus: chunk columns, insert_ord, and an
    ``embedding`` when ``embed`` is given; without an embedder the two vector
    streams stay empty, as when no model is at hand.
    """
    asked = understand(queries.filter(F.coalesce("query", F.lit("")) != ""), "query", catalogue)
    streams: dict[str, DataFrame] = {}
    if embed is not None:
        live = with_status(corpus, config.status)
        streams["original_vector"] = dense_topk(
            asked.select("query_id", embed(F.col("query")).alias("query_vector")), live, config.top_k)
        expanded = asked.filter(
            (F.col("intent.confidence") >= config.intent_threshold) & (F.col("intent.canonical_expansion") != ""))
        streams["intent_vector"] = dense_topk(
            expanded.select("query_id", embed(F.col("intent.canonical_expansion")).alias("query_vector")),
            live, config.top_k)
    index = build_index(corpus, null_token=config.null_token)
    streams["bm25"] = bm25_topk(asked, index, config.top_k, status=config.status)
    matches = exact_matches(asked, _matchable(corpus, config), status=config.status)
    streams["exact_provision"] = ranked_exact(matches, spread=not fits(corpus.select("chunk_id")))

    fused = fuse(streams, rrf_k=config.rrf_k)
    chunks = _matchable(corpus.drop("embedding", "score"), config)
    return fused.join(small_side(chunks), "chunk_id").join(asked, "query_id")


def search(
    queries: DataFrame, corpus: DataFrame, embed: Embedder | None = None, config: RetrievalConfig = RetrievalConfig(),
    catalogue: list[dict] | None = None, pair_score: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Retrieve and rerank: the best candidates of each query with ``final_rank``."""
    candidates = retrieve(queries, corpus, embed, config, catalogue)
    if pair_score is not None:
        candidates = candidates.withColumn(
            "cross_encoder_score", pair_score(F.col("query"), pair_context(F.col("query"), F.col("intent"))))
    return rerank(candidates, config.rerank_k)
