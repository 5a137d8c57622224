"""Removal of repeated passages by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words.  A word goes if some window that covers it
also starts in a document with a smaller id.

1. Every window names an anchor, its ``GRAM``-word gram with the least hash (ties: the
   leftmost).  Equal windows name equal anchors, so only stretches of words whose
   windows share an anchor have to meet: a stretch is what one anchor's windows cover,
   ``2 WINDOW - GRAM`` words at most, about one for twenty words.  Anchors of one
   document are left out by a minimum and a maximum per anchor, combined map-side.
2. Equal stretches are one class, known by 128 bits.  In every document but the class's
   first one the whole stretch is one factor.  Classes are minima, combined map-side,
   so a passage that a third of all documents hold is a row per task.
3. An anchor with more than ``MOST`` classes is refined: its stretches are halved, and
   a half meets only those that have the same words in common to all its possible
   windows.  Equal halves are one class again.  A half that ends in another context
   than all others meets nobody and is left out; the last halves are single windows,
   where only one class remains.  So every group gets small, without a pair lost.
4. The classes of a group that has several are the reference blocks.  A task has whole
   groups, in order of the documents.  Each stretch is factored greedily against every
   block of its group indexed so far: a window found in the index is extended word by
   word to the longest factor, and the parse goes on with the window that straddles the
   factor's end.  Windows found nowhere are indexed once the document changes.  A group
   is one task's, which holds ``MOST`` classes of it and those of one more document.

Factors on stretches are spans of documents again, and one join by document brings
them to the texts.  A bitmap of fixed size keeps texts that cannot be concerned out of
the shuffles; a full one costs time, never a span.

Results: null and empty texts have no words; texts of fewer words than a window stay.
Texts of any length are parsed whole.  Repeated rows and rows that share an id are one
document: neither removes the other's words, each is judged by its own text.  Rows
without an id neither remove words nor lose any.  Kept words are joined by one space.
An empty table gives an empty result.  Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelwright.llm.common import WordHashes, cut_lineage, gram_hashes, packed, stirred, text_key, unpacked
from labelwright.llm.winnow import print_filter

WINDOW = 50
GRAM = 12
FILTER_BITS = 1 << 23
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
CLASS = ("anchor", "c1", "c2")
# Classes that a task holds of one group, unless they are of one document.
MOST = 1024


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode().split() if text else []


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1), modulo 2**64."""
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def range_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the word ranges; equal words give equal hashes wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])
    back = powers(pow(base, -1, 2**64), len(words) + 1)
    return stirred((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def stretches(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word and number of words of every stretch of a text."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = gram_hashes(words, gram)
    inside = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = np.arange(len(inside)) + inside.argmin(axis=1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(at)]]) - 1
    return grams[at[first]], first, last - first + window


def all_stretches(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, key, anchor, c1, c2, at, len) of a (doc, key, text) table; c1, c2 name the stretch's words."""
    names = [*CLASS, "at", "len"]
    part = T.StructType([*[T.StructField(c, T.LongType()) for c in CLASS], *[T.StructField(c, T.IntegerType()) for c in names[3:]]])
    kind = T.StructType([docs.schema["doc"], docs.schema["key"], T.StructField("found", T.ArrayType(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows, ends = [[] for _ in names], [0]
            for text in batch.column(2):
                words = cache.of(words_of(text.as_py()))
                anchor, at, size = stretches(words, window, gram)
                hashes = (range_hashes(words, at, at + size, base) for base in BASES)
                for column, values in zip(rows, (anchor, *hashes, at, size)):
                    column.append(values)
                ends.append(ends[-1] + len(at))
            flat = [np.concatenate(c) if c else np.empty(0) for c in rows]
            parts = pa.StructArray.from_arrays(
                [*(pa.array(c.astype(np.uint64).view(np.int64)) for c in flat[:3]), *(pa.array(c.astype(np.int32)) for c in flat[3:])], names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)], ["doc", "key", "found"])

    seen = cut_lineage(docs.where(F.col("doc").isNotNull()).mapInArrow(run, kind))
    return seen.select("doc", "key", F.inline("found"))


def with_words(classes: DataFrame, docs: DataFrame, bits: int) -> DataFrame:
    """(anchor, c1, c2, doc, words) of the classes, read from the text of their first document."""
    sources = cut_lineage(classes.select("src.doc", "src.key", F.struct(*CLASS, "src.at", "src.len").alias("part")).groupBy("doc", "key").agg(
        F.collect_list("part").alias("parts")))
    texts = possible(docs.select(F.col("doc"), F.col("key"), "text"), print_filter(sources.select(F.col("key").alias("print")), bits), bits)
    kind = T.StructType([*[T.StructField(c, T.LongType()) for c in CLASS], docs.schema["doc"], T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, parts) in enumerate(zip(batch.column(1), batch.column(2))):
                words, parts = words_of(text.as_py()), parts.values
                at, size = (parts.field(c).to_numpy() for c in ("at", "len"))
                cut = [b" ".join(words[a : a + n]) for a, n in zip(at.tolist(), size.tolist())]
                same = batch.column(0).take(pa.array(np.full(len(cut), i)))
                yield pa.RecordBatch.from_arrays(
                    [*(parts.field(c) for c in CLASS), same, pa.array(cut, pa.binary())], [f.name for f in kind.fields])

    # Repeated rows have the same id and text; one of them is enough.
    both = texts.join(sources, ["doc", "key"]).select("doc", "text", "parts")
    return both.mapInArrow(run, kind).dropDuplicates(list(CLASS))


def possible(df: DataFrame, bitmap: np.ndarray, bits: int, wanted: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` the bitmap contains (or does not)."""
    held = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def inside(key: pa.Array) -> pa.Array:
        place = np.mod(key.to_numpy(zero_copy_only=False), bits)
        return pa.array(((held.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0) == wanted)

    return df.where(inside("key"))


class Block:
    """The indexed windows of the stretches of one anchor, in order of their documents."""

    def __init__(self) -> None:
        self.index: dict[int, tuple[bytes, int]] = {}
        self.waiting: list[tuple[int, bytes, int]] = []

    def admit(self) -> None:
        """Index what the document that ended has added."""
        for value, stretch, i in self.waiting:
            self.index.setdefault(value, (stretch, i))
        self.waiting.clear()

    def factors(self, stretch: bytes, words: list[bytes], hashes: list[int], window: int) -> tuple[list[tuple[int, int]], list[int]]:
        """Longest factors of at least a window, and the windows that no block holds."""
        spans, unfound, i = [], [], 0
        while i < len(hashes):
            source = self.index.get(hashes[i])
            other, p = (source[0].split(), source[1]) if source else ([], 0)
            if other[p : p + window] != words[i : i + window]:
                unfound.append(i)
                self.waiting.append((hashes[i], stretch, i))
                i += 1
                continue
            n = window
            while i + n < len(words) and p + n < len(other) and words[i + n] == other[p + n]:
                n += 1
            spans.append((i, i + n))
            i += n - window + 1
        return spans, unfound


def halves(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Both halves of every piece, with the group that its words in common name and the hash of its own words in h1, h2.

    A piece's windows have ``low`` to ``high`` words before their anchor, or some of these where another anchor cuts the stretch.
    """
    longs = [*CLASS, "group", "h1", "h2"]
    kind = T.StructType([
        *[T.StructField(c, T.LongType()) for c in longs], pieces.schema["doc"],
        *[T.StructField(c, T.IntegerType()) for c in ("from", "low", "high")], T.StructField("words", T.BinaryType())])
    fields = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows, picked = [], []
            columns = [batch.column(c).to_pylist() for c in (*CLASS, "from", "low", "high", "words")]
            for k, (a, c1, c2, begin, low, high, stretch) in enumerate(zip(*columns)):
                words = stretch.split()
                hashed = cache.of(words)
                # All windows of a stretch have the anchor that its first one names.
                at = int(gram_hashes(hashed[:window], gram).argmin())
                first, last = at, at - (len(words) - window)
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    most, least = min(first, hi), max(last, lo)
                    if lo > hi or most < least:
                        continue
                    start, stop = at - most, at - least + window
                    edges = np.array([at - lo, start]), np.array([at - hi + window, stop])
                    (core, h1), (_, h2) = (range_hashes(hashed, *edges, base).tolist() for base in BASES)
                    group = stirred(np.array([core ^ (lo << 8 | hi)], np.uint64) + np.uint64(a % 2**64)).view(np.int64)[0]
                    own = np.array([h1, h2], np.uint64).view(np.int64).tolist()
                    rows.append((a, c1, c2, int(group), *own, begin + start, lo, hi, b" ".join(words[start:stop])))
                    picked.append(k)
            columns = list(zip(*rows)) if rows else [[]] * (len(fields) - 1)
            docs = batch.column(len(batch.columns) - 1).take(pa.array(picked, pa.int64()))
            made = [pa.array(c, f.type) for c, f in zip(columns, [f for f in fields if f.name != "doc"])]
            yield pa.RecordBatch.from_arrays([*made[: len(longs)], docs, *made[len(longs) :]], fields.names)

    return pieces.select(*CLASS, "from", "low", "high", "words", "doc").mapInArrow(run, kind)


def grouped(blocks: DataFrame, window: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of the stretches in groups of at most ``most`` classes, and the spans that equal halves have told."""
    pieces = blocks.select(*CLASS, F.col("anchor").alias("group"), "doc", F.lit(0).alias("from"), F.lit(0).alias("low"),
                           F.lit(window - gram).alias("high"), "words")
    done = whole = None
    while True:
        sizes = cut_lineage(pieces.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").select("group", "n"))
        # Single windows of one group are equal; their class has been told.
        large = sizes.where(F.col("n") > most)
        over = large.isEmpty()
        few = pieces.join(sizes if over else sizes.where(F.col("n") <= most), "group", "left_semi").select(*CLASS, "group", "doc", "from", "words")
        done = few if done is None else done.union(few)
        if over:
            break
        cut = cut_lineage(halves(pieces.join(large, "group", "left_semi"), window, gram))
        firsts = cut_lineage(cut.groupBy("group", "h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
        equal = firsts.where("first < last").drop("last")
        meeting = firsts.groupBy("group").agg(F.min("first").alias("least"), F.max("last").alias("last")).where("least < last").select("group")
        marked = cut_lineage(cut.join(meeting, "group", "left_semi").join(equal, ["group", "h1", "h2"], "left"))
        told = marked.where(F.col("doc") > F.col("first")).select(
            *CLASS, "doc", F.col("from").cast("long").alias("start"), (F.col("from") + F.size(F.split("words", " "))).cast("long").alias("stop"))
        whole = told if whole is None else whole.union(told)
        # Equal pieces of the first document stay: what it repeats of others holds for all of them.
        pieces = marked.where("first IS NULL OR doc = first").select(*pieces.columns)
    return done, whole


def parsed(blocks: DataFrame, window: int) -> DataFrame:
    """(anchor, c1, c2, doc, start, stop): factors of the pieces of stretches, group by group; ``from`` is a piece's first word."""
    longs = [*CLASS, "start", "stop"]
    kind = T.StructType([*[T.StructField(c, T.LongType()) for c in longs], blocks.schema["doc"]])
    fields = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, block, group, doc = WordHashes(), Block(), None, None
        for batch in batches:
            rows, docs = [], []
            for g, a, c1, c2, d, begin, stretch in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    block, group, doc = Block(), g, d
                elif d != doc:
                    block.admit()
                    doc = d
                words = stretch.split()
                hashed = cache.of(words)
                at = np.arange(len(words) - window + 1)
                spans, _ = block.factors(stretch, words, range_hashes(hashed, at, at + window, BASES[0]).view(np.int64).tolist(), window)
                rows += [(a, c1, c2, begin + s, begin + e) for s, e in spans]
                docs += [d] * len(spans)
            columns = list(zip(*rows)) if rows else [[]] * len(longs)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, docs], fields)], fields.names)

    ordered = blocks.repartition("group").sortWithinPartitions("group", "doc")
    return ordered.select("group", *CLASS, "doc", "from", "words").mapInArrow(run, kind)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS, most: int = MOST) -> DataFrame:
    """(doc, key, spans) of the documents of a (doc, key, text) table that repeat words of a smaller one."""
    every = all_stretches(docs, window, gram)
    shared = every.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    rows = cut_lineage(every.join(shared, "anchor"))
    classes = cut_lineage(rows.groupBy(*CLASS).agg(F.min(F.struct("doc", "key", "at", "len")).alias("src")))
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    blocks = cut_lineage(with_words(classes.join(several, "anchor"), docs, bits))
    pieces, told = grouped(blocks, window, gram, most)
    spans = cut_lineage(parsed(pieces, window))
    spans = spans if told is None else spans.union(told.select(*spans.columns))
    # A class's factors belong to its first document; in later ones the whole stretch is a factor.
    marked = rows.join(classes.select(*CLASS, F.col("src.doc").alias("first")), list(CLASS))
    whole = marked.where(F.col("doc") > F.col("first")).select("doc", "key", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("len")).cast("long").alias("stop"))
    inner = rows.join(spans, [*CLASS, "doc"]).select("doc", "key", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))
    return whole.union(inner).groupBy("doc", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS,
    counts: bool = False, most: int = MOST,
) -> DataFrame:
    """``docs`` with the kept words as text; with ``counts``, n_words and n_removed follow."""
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = cut_lineage(repeated_spans(docs.select(doc.alias("doc"), text_key(text).alias("key"), text.alias("text")), window, gram, bits, most))
    bitmap = print_filter(found.select(F.col("key").alias("print")), bits)
    rows = packed(docs, row_doc=doc, key=text_key(text))
    hit = found.select(F.col("doc").alias("hit_doc"), F.col("key").alias("hit_key"), "spans")
    concerned = possible(rows, bitmap, bits).join(hit, (F.col("row_doc") == F.col("hit_doc")) & (F.col("key") == F.col("hit_key")), "left")
    clean = possible(rows, bitmap, bits, wanted=False)
    none = F.lit(None).cast(found.schema["spans"].dataType)
    both = concerned.select("row", "spans").union(clean.select("row", none.alias("spans")))

    @F.arrow_udf("struct<kept: string, n_words: bigint, n_removed: bigint>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        for value, marks in zip(texts, spans):
            words = words_of(value.as_py())
            n_words.append(len(words))
            if marks.is_valid:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, marks.values.field(0).to_numpy(), 1)
                np.add.at(edges, marks.values.field(1).to_numpy(), -1)
                keep = np.cumsum(edges)[:-1] == 0
                words = [w for w, k in zip(words, keep.tolist()) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept", "n_words", "n_removed"])

    done = both.withColumn("out", cut(F.col("row").getField(text_col), F.col("spans")))
    extra = {"n_words": F.col("out.n_words"), "n_removed": F.col("out.n_removed")} if counts else {}
    return unpacked(done, **{text_col: F.col("out.kept")}, **extra)
