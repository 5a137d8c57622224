"""Line deduplication: range-partitioned line hashes, and one keep bitmap per document.

The text of a document is split once.  Each line with a long enough key becomes
a narrow row (document, position, 128-bit hash of the key).  Those rows are
dealt out by ranges of (hash, document); a hash that a third of all documents
hold simply covers several ranges.  Each range is sorted by hash, document and
position, and passed through once: of every document's run of a hash the first
position goes on.  The range already keeps a run together, so that this takes
no second shuffle, and holding one row of each run takes no memory.  The first
occurrences are summed up per hash and range; one row of each is shuffled again.
Lines to drop go back as sparse bitmaps of 64 positions a word, not as text.

Results: a document is a doc_id.  Null and empty texts are one empty line and
keep it.  Very long texts are split whole, into as many rows as they have lines.
Rows that share a doc_id count as one document, and each is rewritten by its own
text.  A null doc_id is a document smaller than any other.  An empty table gives
an empty one.  Other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.llm.common import ascii_lower, cut_lineage, packed, text_key, unpacked

SPACE = " \t\n\x0b\f\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, text_id, pos, h1, h2) for every line whose key has at least ``min_chars`` code points."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(
        F.col(f"`{id_col}`").alias("doc"), text_key(text).alias("text_id"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.select("doc", "text_id", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars)
    return keys.select("doc", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def first_occurrences(lines: DataFrame) -> DataFrame:
    """The first row of every (hash, document), streamed from ranges sorted by hash, document and position."""
    ranges = lines.repartitionByRange("h1", "h2", "doc")
    run = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    return ranges.withColumn("_at", F.row_number().over(run)).where(F.col("_at") == 1).drop("_at")


def repeated_keys(lines: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, keeper): hashes that at least ``min_documents`` documents hold, and the largest of these documents."""
    held = first_occurrences(lines).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
    return held.where(F.col("n") >= min_documents).select("h1", "h2", "keeper")


def drop_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """(doc, text_id, n_dropped, words): bit ``p % 64`` of ``words[p // 64]`` is set for each dropped line ``p``.

    Words without a dropped line, and documents without one, are left out: what is absent is kept.
    """
    lines = cut_lineage(line_rows(docs, id_col, text_col, min_chars))
    again = cut_lineage(repeated_keys(lines, min_documents))
    lost = lines.join(again, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    bits = lost.groupBy("doc", "text_id", word).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("doc", "text_id").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_text(text: Column, words: Column) -> Column:
    """The lines whose bit is not set, joined again."""
    def stays(_, i):
        bits = F.coalesce(F.try_element_at(words, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, (i % 64).cast("int")) == 0

    return F.array_join(F.filter(lines_of(text), stays), "\n")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, counts: bool = False,
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text (null becomes the empty text).

    ``counts`` adds n_lines (before dropping) and n_dropped.
    """
    text = F.col(f"`{text_col}`")
    maps = drop_bitmaps(docs, id_col, text_col, min_chars, min_documents)
    left = packed(docs, row_doc=F.col(f"`{id_col}`"), row_text_id=text_key(text))
    both = left.join(maps, F.col("row_doc").eqNullSafe(F.col("doc")) & (F.col("row_text_id") == F.col("text_id")), "left")
    body = F.col("row").getField(text_col)
    new = F.when(F.col("words").isNull(), F.coalesce(body, F.lit(""))).otherwise(kept_text(body, F.col("words")))
    extra = {
        "n_lines": F.size(lines_of(body)).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"),
    } if counts else {}
    return unpacked(both, **{text_col: new, **extra})
