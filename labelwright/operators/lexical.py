"""BM25 keyword retrieval."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed.limits import BM25_B, BM25_EPSILON, BM25_K1
from labelwright.functions.text import tokens
from labelwright.operators.topk import best_items_per_row, best_rows_per_item, in_blocks
from labelwright.session import cut_lineage

# A held block has at most this many (token, item) weights.
HELD_WEIGHTS = 2_000_000
INDEXED = ["text", "rule", "sub_rule", "clause", "chapter", "schedule"]


@dataclass(frozen=True)
class LexicalIndex:
    """Tokens of every document, and the weight of every token of the corpus."""

    docs: DataFrame       # doc_id, insert_ord, status, tokens
    weights: DataFrame    # token, idf
    n_docs: int
    mean_length: float
    doc_id: str


def indexed_text(columns: list[str], null_token: str = "None") -> Column:
    """Searchable text of a chunk; an empty metadata column counts as the word for nothing."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit(null_token)) for c in columns])


def document_frequencies(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """Documents per token; the row with a null token counts all documents and all tokens.

    One pass: each document sends its distinct tokens and one null marker, and
    counts combine map-side, so a token found everywhere is no hot spot.  The
    outer explode keeps the optimizer from testing (and recomputing) the array
    in a filter below it; it is used for every computed array in this package.
    """
    marked = F.concat(F.array_distinct(column), F.array(F.lit(None).cast("string")))
    return docs.select(F.explode_outer(marked).alias("token"), F.size(column).alias("_len")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.col("token").isNull(), F.col("_len"))).alias("total_length"),
    )


def build_index(
    corpus: DataFrame, columns: list[str] | None = None, doc_id: str = "chunk_id", order: str = "insert_ord",
    null_token: str = "None",
) -> LexicalIndex:
    """Token table and token weights over the whole corpus, whatever a document's status."""
    present = [c for c in (columns or INDEXED) if c in corpus.columns]
    status = F.col("status") if "status" in corpus.columns else F.lit("current")
    docs = corpus.select(
        F.col(doc_id), F.col(order).cast("long").alias("insert_ord"), status.alias("status"),
        tokens(indexed_text(present, null_token)).alias("tokens"),
    )
    freq = cut_lineage(document_frequencies(docs))
    head = freq.filter(F.col("token").isNull()).first()
    n, total = (head["n_docs"], head["total_length"]) if head else (0, 0)
    raw = freq.filter(F.col("token").isNotNull()).select(
        "token", (F.log(F.lit(n) - F.col("n_docs") + 0.5) - F.log(F.col("n_docs") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * BM25_EPSILON).alias("floor")).scalar()
    weights = raw.select("token", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(docs, weights, n, total / n if n else 0.0, doc_id)


def _saturation(tf, length, mean):
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def _held_weights(rows: pa.Table, items: dict):
    """Sorted vocabulary and, per token, the items it weighs for."""
    vocab, where = np.unique(rows["token"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    by_token = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[by_token], np.arange(len(vocab) + 1))
    item = np.array([items[x] for x in rows["item"].to_pylist()], dtype=np.int64)[by_token]
    return vocab.tolist(), starts, item, rows["weight"].to_numpy(zero_copy_only=False)[by_token]


def _sparse_scorer(vocab, starts, item, weight, n_items, mean_length):
    """Scores of token lists against held weights; ``mean_length`` set means the lists are documents."""
    words = pa.array(vocab, pa.string())

    def score(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("tokens")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.index_in(lists.flatten().cast(pa.string()), value_set=words)
        row = np.repeat(np.arange(len(lists)), lengths)
        ok = pc.is_valid(known).to_numpy(zero_copy_only=False)
        pair = row[ok] * len(vocab) + known.drop_null().to_numpy(zero_copy_only=False)
        pair, tf = np.unique(pair, return_counts=True)
        row, word = pair // max(1, len(vocab)), pair % max(1, len(vocab))
        value = tf.astype(np.float64)
        if mean_length is not None:
            value = _saturation(value, lengths[row], mean_length)
        spread = (starts[word + 1] - starts[word]).astype(np.int64)
        table = np.zeros(len(lists) * n_items)
        # Expand (row, word) to (row, item) a slice at a time.
        ends = np.cumsum(spread)
        at = 0
        while at < len(word):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
            n = spread[at:to]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slot = np.repeat(starts[word[at:to]], n) + offset
            cell = np.repeat(row[at:to], n) * n_items + item[slot]
            table += np.bincount(cell, np.repeat(value[at:to], n) * weight[slot], minlength=table.size)
            at = to
        table = table.reshape(len(lists), n_items)
        return np.where(table > 0, table, np.nan)

    return score


def bm25_topk(
    queries: DataFrame, index: LexicalIndex, k: int, text: str = "query", query_id: str = "query_id",
    status: str | None = "current", held_weights: int = HELD_WEIGHTS, hold: str | None = None,
) -> DataFrame:
    """The k best documents of each query with a positive score: (query_id, doc id, insert_ord, score, rank).

    Repeated query words count repeatedly.  Token weights come from the whole
    corpus; the status filter applies to candidates only.  ``hold`` names the
    side kept in memory ("corpus" or "queries"); by default the corpus when it
    is small, else the queries in bounded blocks.
    """
    spark = index.docs.sparkSession
    doc_id = index.doc_id
    asked = queries.select(query_id, tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    candidates = index.docs if status is None else index.docs.filter(F.col("status") == status)
    if hold is None:
        size = F.coalesce(F.sum(F.size("tokens")), F.lit(0))
        n, total = index.docs.limit(20_001).agg(F.count(F.lit(1)), size).first()
        hold = "corpus" if n <= 20_000 and total <= held_weights else "queries"
    counted = ["_id", "token"]

    if hold == "corpus":
        names = candidates.select(doc_id, "insert_ord").orderBy("insert_ord").toArrow()
        ids, orders = names[doc_id].to_pylist(), names["insert_ord"].to_pylist()
        tf = candidates.select(F.col(doc_id).alias("_id"), F.size("tokens").alias("_len"),
                               F.explode_outer("tokens").alias("token"))
        tf = tf.groupBy("_id", "_len", "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        sat = _saturation(F.col("tf"), F.col("_len"), F.lit(index.mean_length))
        held = tf.join(index.weights, "token").select(
            "token", F.col("_id").alias("item"), (F.col("idf") * sat).alias("weight")).toArrow()
        shared = spark.sparkContext.broadcast(_held_weights(held, {x: i for i, x in enumerate(ids)}))
        n_items = max(1, len(ids))
        found = best_items_per_row(
            asked, lambda: _sparse_scorer(*shared.value, n_items, None), n_items, k, query_id)
        kind = index.docs.schema[doc_id].dataType.simpleString()
        table = spark.createDataFrame(
            [(i, a, b) for i, (a, b) in enumerate(zip(ids, orders))], f"item_no int, {doc_id} {kind}, insert_ord bigint")
        return found.join(F.broadcast(table), "item_no").select(query_id, doc_id, "insert_ord", "score", "rank")

    tf = asked.select(F.col(query_id).alias("_id"), F.explode_outer("tokens").alias("token")).groupBy(*counted).agg(
        F.count(F.lit(1)).alias("tf"))
    held = cut_lineage(tf.join(index.weights, "token").select(
        F.col("_id").alias("item"), "token", (F.col("idf") * F.col("tf")).alias("weight"), F.lit(1).alias("_w")))
    kind = queries.schema[query_id].dataType.simpleString()
    mean = index.mean_length
    parts = []
    for block in in_blocks(held, "item", "_w", held_weights):
        rows = block.select("item", "token", "weight").toArrow()
        ids = sorted(set(rows["item"].to_pylist()))
        if not ids:
            continue
        shared = spark.sparkContext.broadcast(_held_weights(rows, {x: i for i, x in enumerate(ids)}))
        n_items = len(ids)

        def per_doc(shared=shared, n_items=n_items):
            return _sparse_scorer(*shared.value, n_items, mean)

        found = best_rows_per_item(candidates.select(doc_id, "insert_ord", "tokens"), per_doc, n_items, k,
                                   doc_id, "insert_ord")
        table = spark.createDataFrame(list(enumerate(ids)), f"item_no int, {query_id} {kind}")
        parts.append(found.join(F.broadcast(table), "item_no").select(query_id, doc_id, "insert_ord", "score", "rank"))
    if not parts:
        doc_kind = index.docs.schema[doc_id].dataType.simpleString()
        return spark.createDataFrame(
            [], f"{query_id} {kind}, {doc_id} {doc_kind}, insert_ord bigint, score double, rank int")
    return reduce(DataFrame.unionByName, parts)
