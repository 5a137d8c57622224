"""Benchmark decontamination by winnowing.

Of every window of ``w`` consecutive ``k``-word grams the one with the least
hash is kept as a fingerprint.  Two texts that share ``k + w - 1`` words in a
row keep the same gram inside that span, so no shared span of that length is
missed (``k + w - 1`` is the window of the rule: 13).  Fingerprints of documents
and items meet in a join; each carries the hashes of the words around it, and
the hit is extended over them in both directions.

Documents hold far more fingerprints than items do, so a bitmap of fixed size
(``FILTER_BITS``) over the items' fingerprints is sent to the tasks and only
documents' fingerprints it contains are shuffled.  A full bitmap costs time,
never a hit.

Items with fewer words than the window are one window each: for every such
length that occurs (at most 12) documents are winnowed at that length too.

Results: null or wordless texts have no words, no hits and are clean; a null or
wordless item never matches.  Rows that share a doc_id are judged each by its
own text.  Repeated items count once per item_id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import WordHashes, cut_lineage, gram_hashes, packed, stirred, text_key, unpacked

WINDOW = 13
GRAM = 6
FILTER_BITS = 1 << 23
BUCKET_BITS = 32768
PAD_DOC, PAD_ITEM = np.uint64(0), np.uint64(1)
# Word characters: digits, letters and everything beyond ASCII; A-Z become a-z.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def gram_size(window: int, gram: int = GRAM) -> int:
    return min(window, gram)


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Whether x[i] is the least value of some window of ``w`` neighbours (ties: all of them)."""
    if w <= 1 or len(x) <= 1:
        return np.ones(len(x), bool)
    w = min(w, len(x))
    view = np.lib.stride_tricks.sliding_window_view
    low = view(x, w).min(axis=1) if w < 4 else _running(x, w, np.minimum)
    edge = np.zeros(w - 1, x.dtype)
    return _running(np.concatenate([edge, low, edge]), w, np.maximum) == x


def _running(x: np.ndarray, w: int, best) -> np.ndarray:
    """Best of every ``w`` neighbours, by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out, have = best(out[:-have], out[have:]), have * 2
    return best(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


def fingerprints(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and word positions of the grams that winnowing keeps."""
    k = gram_size(window)
    grams = gram_hashes(words, k)
    at = np.flatnonzero(least_in_windows(grams, window - k + 1))
    return stirred(grams[at] + np.uint64(window)), at


def around(words: np.ndarray, at: np.ndarray, window: int, pad: np.uint64) -> np.ndarray:
    """The word hashes a window that holds the gram can reach, padded at the ends of the text."""
    reach = window - gram_size(window)
    wide = np.concatenate([np.full(reach, pad), words, np.full(reach, pad)])
    return wide[at[:, None] + np.arange(gram_size(window) + 2 * reach)]


def _lists(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(flat))


def item_fingerprints(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, window, print, ctx) of every item; items of fewer words are one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = cache.of(words_of(text))
                if not len(words):
                    continue
                size = min(window, len(words))
                value, at = fingerprints(words, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(at), pa.string()), pa.array(np.full(len(at), size, np.int32)),
                    pa.array(value.view(np.int64)), _lists(around(words, at, size, PAD_ITEM))], ["item", "window", "print", "ctx"])

    ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return items.select(ids.alias("item"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "item string, window int, print long, ctx array<long>")


def print_filter(prints: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the fingerprints: at most ``bits`` / 8 bytes, however many there are."""
    place = F.pmod("print", F.lit(bits))
    rows = prints.select(place.alias("p")).groupBy(F.floor(F.col("p") / BUCKET_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("p") % BUCKET_BITS).alias("bitmap")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["bucket"] * BUCKET_BITS // 8 : (r["bucket"] + 1) * BUCKET_BITS // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def document_candidates(docs: DataFrame, bitmap, sizes: list[int], bits: int) -> DataFrame:
    """One row (doc, text_id, n_words) per row of ``docs`` and one per fingerprint that items may hold."""
    kind = T.StructType([
        T.StructField("doc", docs.schema["doc"].dataType), T.StructField("text_id", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("print", T.LongType()),
        T.StructField("at", T.IntegerType()), T.StructField("ctx", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = WordHashes(), bitmap.value
        for batch in batches:
            n_words, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = cache.of(words_of(text))
                n_words.append(len(words))
                for size in sizes:
                    if len(words) >= size:
                        value, at = fingerprints(words, size)
                        place = value.view(np.int64) % bits
                        here = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                        if here.any():
                            found.append((i, size, value[here], at[here], around(words, at[here], size, PAD_DOC)))
            names = [f.name for f in kind.fields]
            n = len(n_words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names)
            for i, size, value, at, ctx in found:
                pick = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pick), batch.column(1).take(pick), pa.nulls(len(at), pa.int64()),
                    pa.array(np.full(len(at), size, np.int32)), pa.array(value.view(np.int64)), pa.array(at.astype(np.int32)),
                    _lists(ctx)], names)

    return docs.mapInArrow(run, kind)


def extended(pairs: DataFrame) -> DataFrame:
    """Spans (start, stop) of document words that reach a whole window of the item on both sides of a shared gram."""
    kind = T.StructType([pairs.schema["doc"], pairs.schema["text_id"], pairs.schema["item"],
                         T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("window").to_numpy(zero_copy_only=False)
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                k = gram_size(int(size))
                reach = int(size) - k
                own, other = (
                    np.asarray(batch.column(c).take(pa.array(rows)).flatten()).reshape(len(rows), k + 2 * reach)
                    for c in ("ctx", "item_ctx"))
                same = own == other
                left = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(same[:, reach + k :], axis=1).sum(axis=1)
                ok = same[:, reach : reach + k].all(axis=1) & (left + k + right >= size)
                pick = rows[ok]
                start = at[pick] - left[ok]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(pick)) for c in ("doc", "text_id", "item")]
                    + [pa.array(start), pa.array(at[pick] + k + right[ok])], [f.name for f in kind.fields])

    return pairs.mapInArrow(run, kind)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(doc, text_id, n_words, n_hit, spans, items), one row per row of ``docs``: what it shares with the items.

    ``spans`` are disjoint (start, stop) word ranges, ``items`` the sorted ids.
    """
    spark = docs.sparkSession
    prints = cut_lineage(item_fingerprints(items, item_id_col, item_text_col, window))
    sizes = sorted(r[0] for r in prints.select("window").distinct().collect())
    bitmap = spark.sparkContext.broadcast(print_filter(prints, filter_bits))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), text_key(F.col(f"`{text_col}`")).alias("text_id"), F.col(f"`{text_col}`").alias("text"))
    seen = cut_lineage(document_candidates(narrow, bitmap, sizes, filter_bits))
    totals = seen.where(F.col("print").isNull()).select("doc", "text_id", "n_words")
    candidates = seen.where(F.col("print").isNotNull()).drop("n_words")
    pairs = candidates.join(prints.withColumnRenamed("ctx", "item_ctx"), ["print", "window"])
    hits = extended(pairs).groupBy("doc", "text_id").agg(
        F.collect_set(F.struct("start", "stop")).alias("found"), F.sort_array(F.collect_set("item")).alias("items"))
    joined = F.expr("""
        aggregate(sort_array(found), cast(array() AS array<struct<start: bigint, stop: bigint>>),
          (done, s) -> IF(size(done) > 0 AND s.start <= element_at(done, -1).stop,
            concat(slice(done, 1, size(done) - 1),
                   array(struct(element_at(done, -1).start AS start, greatest(element_at(done, -1).stop, s.stop) AS stop))),
            concat(done, array(s))))""")
    hits = hits.select(F.col("doc").alias("hit_doc"), F.col("text_id").alias("hit_text"), joined.alias("spans"), "items")
    both = totals.join(hits, F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("text_id") == F.col("hit_text")), "left")
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return both.select(
        "doc", "text_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() AS array<struct<start: bigint, stop: bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))


def is_contaminated(n_hit, n_words):
    """A document is contaminated when a twentieth of its words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    found = contamination(docs, items, id_col, text_col, **options)
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("doc", "text_id")
    rows = packed(docs, row_doc=F.col(f"`{id_col}`"), row_text_id=text_key(F.col(f"`{text_col}`")))
    on = F.col("row_doc").eqNullSafe(F.col("doc")) & (F.col("row_text_id") == F.col("text_id"))
    return unpacked(rows.join(bad, on, "left_anti"))
