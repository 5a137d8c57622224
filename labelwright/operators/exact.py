"""Exact provision matches between parsed references and a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.text import truthy
from labelwright.operators.in_order import rank_in_order
from labelwright.session import small_side

# Reference parts in the order in which a match counts.
PRIORITY = ["clause", "sub_rule", "schedule", "section", "rule"]


def _parts(source: dict[str, Column]) -> Column:
    """Each given part as (priority, kind, value in lower case)."""
    return F.array_compact(F.array(*[
        F.when(truthy(value).isNotNull(), F.struct(
            F.lit(PRIORITY.index(kind) + 1).alias("priority"), F.lit(kind).alias("kind"),
            F.lower(value).alias("value")))
        for kind, value in source.items()
    ]))


def exact_matches(
    queries: DataFrame, corpus: DataFrame, reference: str = "reference", query_id: str = "query_id",
    doc_id: str = "chunk_id", order: str = "insert_ord", status: str | None = "current",
) -> DataFrame:
    """Documents sharing a reference part with a query: (query_id, doc id, order, priority).

    Both sides are unfolded into (kind, value) keys and meet in one hash join;
    the best priority of a pair is a ``min``.  Nothing is cut off.
    """
    ref = F.col(reference)
    asked = queries.filter(ref["explicit_provision"]).select(
        query_id, F.explode_outer(_parts({k: ref[k] for k in PRIORITY})).alias("_p"))
    keep = corpus if status is None else corpus.filter(
        truthy(F.col("status")).isNull() | (F.col("status") == status))
    have = {k: F.col(k).cast("string") for k in PRIORITY if k in corpus.columns}
    filed = keep.select(doc_id, order, F.explode_outer(_parts(have)).alias("_p")).select(
        doc_id, order, F.col("_p.kind").alias("kind"), F.col("_p.value").alias("value"))
    wanted = asked.select(query_id, "_p.priority", "_p.kind", "_p.value")
    pairs = wanted.join(small_side(filed), ["kind", "value"])
    return pairs.groupBy(query_id, doc_id, order).agg(F.min("priority").alias("priority"))


def ranked_exact(
    matches: DataFrame, query_id: str = "query_id", order: str = "insert_ord", spread: bool = False
) -> DataFrame:
    """Rank the matches of each query by priority, then corpus order.

    A query matches at most the corpus, so a small corpus ranks in a window;
    with ``spread`` one query's matches are ranked over many tasks.
    """
    by = [F.col("priority"), F.col(order)]
    if spread:
        return rank_in_order(matches, [query_id], by, "rank")
    return matches.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(*by)))
