"""A written inverted index for BM25: postings blocks with bounds, and statistics that follow the corpus.

Documents are cut into segments of neighbouring ``insert_ord``; a block holds one
token's postings in one segment, with its highest count and its shortest document.
The two bound what the block can add to any score, whatever the corpus' mean length
becomes.  A search reads the bounds alone first (the arrays stay on disk), scores each
query's most promising segments, and leaves out every segment whose bound is below the
k-th score found there: exact, ties included.

Writing moves each document's text once, to its segment, in parts of a bounded size;
counting and gathering need no further shuffle.  A token found everywhere is one block
per segment, so no task meets all of it.  Searching sends the few asked tokens, and the
segments to be read, to the blocks; postings are not moved.

Statistics are sums (documents per token, documents, words), so a change of the corpus
is a table of differences: what left counts minus, what came counts plus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.fixed.limits import BM25_B, BM25_EPSILON, BM25_K1
from labelwright.functions.text import tokens
from labelwright.operators.lexical import INDEXED, document_frequencies, indexed_text
from labelwright.operators.topk import SCORE_DIGITS
from labelwright.session import cut_lineage, fits, small_side, tasks_for

SEGMENT = 1024
# Segments of a query that are scored first, by their bound; any number gives the same result.
STARTS = 4
# Bytes of the corpus per task that counts and gathers: its tables stay in memory.
WRITE_TASK_BYTES = 4 << 20
# (query, segment) pairs are two numbers; this many are sent to every task.
HELD_PAIRS = 1_000_000


# ---- statistics -----------------------------------------------------------------------------

def searchable(
    corpus: DataFrame, columns: list[str] | None = None, doc_id: str = "chunk_id", order: str = "insert_ord", null_token: str = "None",
) -> DataFrame:
    """(doc id, insert_ord, status, text) of every chunk; a corpus without a status is current."""
    present = [c for c in (columns or INDEXED) if c in corpus.columns]
    status = F.col("status") if "status" in corpus.columns else F.lit("current")
    return corpus.select(
        F.col(doc_id), F.col(order).cast("long").alias("insert_ord"), status.alias("status"),
        indexed_text(present, null_token).alias("text"))


def tokenised(
    corpus: DataFrame, columns: list[str] | None = None, doc_id: str = "chunk_id", order: str = "insert_ord", null_token: str = "None",
) -> DataFrame:
    """(doc id, insert_ord, status, tokens) of every chunk."""
    whole = searchable(corpus, columns, doc_id, order, null_token)
    return whole.withColumn("tokens", tokens(F.col("text"))).drop("text")


def merged(*parts: DataFrame) -> DataFrame:
    """Statistics of several corpora as one; differences may be negative.  The null token counts documents and words."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy("token").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_length").alias("total_length"))
    return sums.filter((F.col("n_docs") != 0) | F.col("token").isNull())


def difference(left: DataFrame | None = None, came: DataFrame | None = None) -> DataFrame:
    """What statistics change by when the tokenised documents ``left`` go and ``came`` come.

    Only the changed documents are read.  A token both sides hold in as many
    documents cancels out and is no row.
    """
    parts = []
    if left is not None:
        parts.append(document_frequencies(left).select(
            "token", (-F.col("n_docs")).alias("n_docs"), (-F.col("total_length")).alias("total_length")))
    if came is not None:
        parts.append(document_frequencies(came))
    return merged(*parts)


def replaced(store: DataFrame, batch: DataFrame, doc_id: str = "chunk_id") -> DataFrame:
    """Difference of an upsert: documents of the (tokenised) store whose id the batch brings again go, the batch comes.

    Batch ids are unique, as ``index.upsert`` leaves them.
    """
    gone = store.join(batch.select(doc_id), doc_id, "left_semi")
    return difference(gone, batch)


def weights_of(statistics: DataFrame) -> tuple[DataFrame, int, float]:
    """Weight (token, idf) of every token, the number of documents and their mean length."""
    head = statistics.filter(F.col("token").isNull()).first()
    n, total = (head["n_docs"], head["total_length"] or 0) if head else (0, 0)
    raw = statistics.filter(F.col("token").isNotNull()).select(
        "token", (F.log(F.lit(n) - F.col("n_docs") + 0.5) - F.log(F.col("n_docs") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * BM25_EPSILON).alias("floor")).scalar()
    return raw.select("token", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), n, total / n if n else 0.0


# ---- the index ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Postings:
    """An index on disk: ``blocks`` (token, segment, max_tf, min_len, postings) and ``statistics``."""

    blocks: DataFrame
    statistics: DataFrame
    doc_id: str


def write_postings(
    corpus: DataFrame, path: str, columns: list[str] | None = None, doc_id: str = "chunk_id", order: str = "insert_ord",
    null_token: str = "None", segment: int = SEGMENT,
) -> Postings:
    """Index every chunk of ``corpus`` under ``path``; ``insert_ord`` must be unique, so that segments are bounded."""
    docs = tokenised(corpus, columns, doc_id, order, null_token)
    # The one shuffle: by segment, as text.  Every grouping below is inside a segment.
    parts = tasks_for(corpus, WRITE_TASK_BYTES, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = searchable(corpus, columns, doc_id, order, null_token)
    by_segment = whole.withColumn("segment", F.floor(F.col("insert_ord") / segment)).repartition(parts, "segment")
    counts = by_segment.withColumn("tokens", tokens(F.col("text"))).select(
        "segment", doc_id, "insert_ord", "status", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("token")
    ).groupBy("segment", "token", doc_id, "insert_ord", "status", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    posting = F.struct("insert_ord", F.col(doc_id).alias("doc"), "status", "tf", "len")
    blocks = counts.groupBy("segment", "token").agg(
        F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(posting).alias("postings"))
    # Within a file blocks lie by token, so that a reader's row groups are told apart by it.
    blocks.sortWithinPartitions("token", "segment").write.parquet(f"{path}/blocks")
    # The statistics of tokens follow from the blocks.
    written = corpus.sparkSession.read.parquet(f"{path}/blocks")
    size = F.size("postings").cast("long")
    lengths = F.aggregate("postings", F.lit(0).cast("long"), lambda n, p: n + p["tf"])
    sums = written.groupBy("token").agg(F.sum(size).alias("n_docs"), F.sum(lengths).alias("words"))
    named = sums.filter(F.col("token").isNotNull()).select("token", "n_docs", F.lit(None).cast("long").alias("total_length"))
    # Documents without a token are in no block, so documents are counted on their own.
    parts = docs.select(F.lit(1).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("total_length")).unionByName(
        sums.filter(F.col("token").isNotNull()).select(F.lit(0).cast("long").alias("n_docs"), F.col("words").alias("total_length")))
    head = parts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total_length"), F.lit(0)).alias("total_length"))
    head = head.select(F.lit(None).cast("string").alias("token"), "n_docs", "total_length")
    named.unionByName(head).write.parquet(f"{path}/statistics")
    return open_postings(corpus.sparkSession, path, doc_id)


def open_postings(spark: SparkSession, path: str, doc_id: str = "chunk_id") -> Postings:
    return Postings(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/statistics"), doc_id)


def _saturated(tf: Column, length: Column, mean: float) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(mean)))


@dataclass(frozen=True)
class Search:
    """``top``: (query id, doc id, insert_ord, score, rank).  ``bounds``: (query id, segment, most, n_blocks, read)."""

    top: DataFrame
    bounds: DataFrame


def search_postings(
    queries: DataFrame, index: Postings, k: int, text: str = "query", query_id: str = "query_id", status: str | None = "current",
    statistics: DataFrame | None = None, starts: int = STARTS,
) -> Search:
    """The k best documents of each query with a positive score, from the blocks that can hold one.

    Repeated query words count repeatedly.  ``statistics`` replaces those written
    with the index (after an upsert, say); bounds hold for any.
    """
    weights, _, mean = weights_of(index.statistics if statistics is None else statistics)
    words = queries.select(F.col(query_id), F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    asked = words.groupBy(query_id, "token").agg(F.count(F.lit(1)).alias("qtf")).join(weights, "token").select(
        query_id, "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    asked = cut_lineage(asked)
    by_token = small_side(asked)
    bound = F.greatest(F.col("weight") * _saturated(F.col("max_tf"), F.col("min_len"), mean or 1.0), F.lit(0.0))
    bounds = index.blocks.select("token", "segment", "max_tf", "min_len").join(by_token, "token").groupBy(query_id, "segment").agg(
        F.sum(bound).alias("most"), F.count(F.lit(1)).alias("n_blocks"))

    def scored(pairs: DataFrame) -> DataFrame:
        wanted, blocks = pairs.select(query_id, "segment"), index.blocks.select("token", "segment", "postings")
        if fits(asked) and fits(wanted, HELD_PAIRS):
            met = blocks.join(by_token, "token").join(F.broadcast(wanted), [query_id, "segment"])
        else:
            met = blocks.join(wanted.join(asked, query_id), ["token", "segment"])
        rows = met.select(query_id, "weight", F.inline("postings"))
        if status is not None:
            rows = rows.filter(F.col("status") == status)
        value = F.col("weight") * _saturated(F.col("tf"), F.col("len"), mean or 1.0)
        sums = rows.groupBy(query_id, F.col("doc").alias(index.doc_id), "insert_ord").agg(F.round(F.sum(value), SCORE_DIGITS).alias("score"))
        return best(sums.filter(F.col("score") > 0))

    def best(rows: DataFrame) -> DataFrame:
        order = W.partitionBy(query_id).orderBy(F.desc("score"), "insert_ord")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    placed = cut_lineage(bounds.withColumn(
        "place", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("most"), "segment"))))
    first = cut_lineage(scored(placed.filter(F.col("place") <= starts)))
    least = first.filter(F.col("rank") == k).select(query_id, F.col("score").alias("least"))
    # A bound is compared with room for the rounding of sums.
    open_ = F.col("least").isNull() | (F.col("most") * (1 + 1e-9) + 1e-8 >= F.col("least"))
    is_first = F.col("place") <= starts
    marked = cut_lineage(placed.join(least, query_id, "left").select(
        query_id, "segment", "most", "n_blocks", is_first.alias("is_first"), (is_first | open_).alias("read")))
    rest = scored(marked.filter(F.col("read") & ~F.col("is_first")))
    columns = [query_id, index.doc_id, "insert_ord", "score"]
    top = best(first.select(columns).unionByName(rest.select(columns)))
    return Search(top, marked.drop("is_first"))
