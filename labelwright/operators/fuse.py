"""Reciprocal rank fusion of the candidate streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.fixed.limits import RRF_K, STREAM_WEIGHTS

# Streams in the order in which they are fused, and the column that keeps each one's rank.
STREAMS = ["original_vector", "intent_vector", "bm25", "exact_provision"]
RANK_COLUMNS = {
    "original_vector": "vector_rank", "intent_vector": "intent_rank",
    "bm25": "bm25_rank", "exact_provision": "exact_rank",
}


def fuse(
    streams: dict[str, DataFrame], query_id: str = "query_id", doc_id: str = "chunk_id", rrf_k: int = RRF_K,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """One row per (query, document) with its ranks, scores, sources and fused score.

    Streams are stacked and grouped once, instead of full outer joins; the sum
    runs in stream order whatever the row order.  Keys are (query, document),
    so no key is hot.
    """
    weights = weights or STREAM_WEIGHTS
    stacked = reduce(DataFrame.unionByName, [
        df.select(
            query_id, doc_id, F.lit(name).alias("_stream"), F.col("rank").cast("int").alias("rank"),
            (F.col("score") if "score" in df.columns else F.lit(0.0)).alias("score"),
        )
        for name, df in streams.items()
    ])

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("_stream") == name, F.col(value)))

    grouped = stacked.groupBy(query_id, doc_id).agg(
        *[of(name, "rank").alias(RANK_COLUMNS[name]) for name in STREAMS],
        F.coalesce(of("original_vector", "score"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(of("bm25", "score"), F.lit(0.0)).alias("bm25_score"),
    )

    def share(name: str) -> Column:
        rank = F.col(RANK_COLUMNS[name])
        return F.when(rank.isNotNull(), F.lit(weights[name]) / (F.lit(rrf_k) + rank)).otherwise(F.lit(0.0))

    total = reduce(lambda a, b: a + b, [share(name) for name in STREAMS])
    sources = F.array_compact(F.array(*[
        F.when(F.col(RANK_COLUMNS[name]).isNotNull(), F.lit(name)) for name in STREAMS]))
    first = F.coalesce(*[
        F.when(F.col(RANK_COLUMNS[name]).isNotNull(), F.struct(
            F.lit(i).alias("stream"), F.col(RANK_COLUMNS[name]).alias("rank")))
        for i, name in enumerate(STREAMS)])
    return (
        grouped.withColumn("rrf_score", total)
        .withColumn("hybrid_score", F.col("rrf_score"))
        .withColumn("score", F.col("rrf_score"))
        .withColumn("retrieval_sources", sources)
        .withColumn("_first", first)
    )


def fused_order() -> list[Column]:
    """Best fused score first; equal scores in order of first appearance."""
    return [F.desc("rrf_score"), F.col("_first.stream"), F.col("_first.rank")]


def fused_rank(fused: DataFrame, query_id: str = "query_id", name: str = "fused_rank") -> DataFrame:
    """Rank within each query; a query has at most its streams' top lists and its exact matches."""
    return fused.withColumn(name, F.row_number().over(W.partitionBy(query_id).orderBy(*fused_order())))
