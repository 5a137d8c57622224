"""Dense retrieval: cosine top-k between query vectors and a corpus of vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.operators.topk import best_items_per_row, best_rows_per_item, in_blocks

# A held block of vectors has at most this many numbers (64 MB of doubles).
HELD_NUMBERS = 8_000_000


Held = dict[int, tuple[np.ndarray, np.ndarray]]


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of length ``dim`` in a list column, and these rows scaled to length one."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(-1, dim)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return fit, np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _held(block: DataFrame, id_col: str, vector: str, order: str) -> tuple[list, list, Held]:
    """Ids, order values and unit vectors, by their length, of one bounded block, in order."""
    rows = block.select(id_col, vector, F.col(order).alias("_o")).toArrow().sort_by("_o")
    column = rows[vector].combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) if len(column) else []
    return rows[id_col].to_pylist(), rows["_o"].to_pylist(), {int(n): _unit_rows(column, int(n)) for n in sizes if n}


def _scores(column: pa.Array, held: Held, n_items: int) -> np.ndarray:
    """Cosine of every row with every held vector; vectors of different lengths score 0."""
    out = np.zeros((len(column), n_items))
    for dim, (items, matrix) in held.items():
        rows, own = _unit_rows(column, dim)
        if rows.size:
            out[np.ix_(rows, items)] = own @ matrix.T
    return out


def dense_topk(
    queries: DataFrame, corpus: DataFrame, k: int, query_vector: str = "query_vector", vector: str = "embedding",
    query_id: str = "query_id", doc_id: str = "chunk_id", order: str = "insert_ord",
    held_numbers: int = HELD_NUMBERS,
) -> DataFrame:
    """The k nearest corpus rows of each query: (query_id, chunk_id, insert_ord, score, rank).

    When the corpus is small it is held and queries stream past it without any
    shuffle; otherwise the queries are held, in bounded blocks, and the corpus
    streams past them.  A pair of vectors of different lengths scores 0.
    """
    spark = corpus.sparkSession
    corpus = corpus.select(doc_id, F.col(order).cast("long").alias(order), vector)
    nothing = spark.createDataFrame([], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, "
                                        f"{doc_id} {corpus.schema[doc_id].dataType.simpleString()}, "
                                        f"{order} bigint, score double, rank int")
    weight = F.coalesce(F.size(vector), F.lit(0))
    small = corpus.limit(100_001).agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if small[0] <= 100_000 and small[1] <= held_numbers:
        ids, orders, matrix = _held(corpus, doc_id, vector, order)
        if not ids:
            return nothing
        shared = spark.sparkContext.broadcast(matrix)

        def per_query():
            held = shared.value
            return lambda batch: _scores(batch.column(query_vector), held, len(ids))

        found = best_items_per_row(queries.select(query_id, query_vector), per_query, len(ids), k, query_id)
        table = spark.createDataFrame(
            [(i, a, b) for i, (a, b) in enumerate(zip(ids, orders))],
            f"item_no int, {doc_id} {corpus.schema[doc_id].dataType.simpleString()}, {order} bigint",
        )
        return found.join(F.broadcast(table), "item_no").select(query_id, doc_id, order, "score", "rank")

    queries = queries.select(query_id, query_vector).withColumn(
        "_w", F.coalesce(F.size(query_vector), F.lit(0)).cast("long"))
    parts = []
    for block in in_blocks(queries, query_id, "_w", held_numbers):
        ids, _, matrix = _held(block, query_id, query_vector, query_id)
        if not ids:
            continue
        shared = spark.sparkContext.broadcast(matrix)

        def per_doc(shared=shared, n=len(ids)):
            held = shared.value
            return lambda batch: _scores(batch.column(vector), held, n)

        found = best_rows_per_item(corpus, per_doc, len(ids), k, doc_id, order)
        table = spark.createDataFrame(
            list(enumerate(ids)), f"item_no int, {query_id} {queries.schema[query_id].dataType.simpleString()}")
        parts.append(found.join(F.broadcast(table), "item_no").select(query_id, doc_id, order, "score", "rank"))
    return reduce(DataFrame.unionByName, parts) if parts else nothing
