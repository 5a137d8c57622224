"""Retrieval benchmark over a table of evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.config import RetrievalConfig
from labelwright.functions.citations import canonical_schedule
from labelwright.functions.embed import Embedder
from labelwright.operators.evaluate import corpus_gaps, diagnose, match_ranks, retrieval_metrics
from labelwright.plans.retrieval import search
from labelwright.session import cut_lineage


def evaluate_cases(
    cases: DataFrame, corpus: DataFrame, embed: Embedder | None = None,
    config: RetrievalConfig = RetrievalConfig(), catalogue: list[dict] | None = None,
) -> DataFrame:
    """Per-case diagnostics: match rank, top-1 provision, result and failure class."""
    queries = cases.select(F.col("id").alias("query_id"), "query")
    ranked = search(queries, corpus, embed, config, catalogue)
    return cut_lineage(diagnose(match_ranks(cases, ranked), corpus_gaps(cases, _canonical(corpus, config))))


def _canonical(corpus: DataFrame, config: RetrievalConfig) -> DataFrame:
    return corpus.withColumn("schedule", canonical_schedule(F.col("schedule"))) if config.canonical_schedules else corpus


def summary(diagnosed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overall metrics and metrics per category."""
    return retrieval_metrics(diagnosed), retrieval_metrics(diagnosed, ["category"])
