"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

One permutation (sigma) scatters a document's shingles over ``2**20`` places; a
second one (pi), shifted circularly by 0, 1, 2, ... places, gives all
coordinates of the signature: coordinate ``k`` is the least ``pi[(p + k) mod D]``
over the occupied places ``p``.  Two arrays replace a family of hash functions.

28 bands of 5 coordinates: two documents at the threshold of 0.8 share a band
with probability 1 - (1 - 0.8**5)**28 = 1 - 1.5e-5, at 0.9 all but certainly.

Documents with equal shingle sets form one class from the start and only the
class (its least doc_id) takes part in banding.  Documents that share a bucket are
gathered around pivots:

1. The pivot of a bucket is the member that meets most others over all buckets,
   likely the text the others were made from.  A document's home is the foremost
   pivot it meets.  A bucket whose members have one home adds nothing to the
   star around that home; any other belongs to the star around its own pivot,
   where two members with one home elsewhere need no further look.
   Every member of a star is compared with its pivot on the full sets: n pairs
   for n members.  Members that components then join need no further comparison.
2. The members of a star that still holds several components are compared inside
   tasks, without the texts: what x and y lack of the pivot p and add to it (L, A)
   gives |x & y| = |p| - |Lx| - |Ly| + |Lx & Ly| + |Ax & Ay|.  A task takes a star
   whole if it is light (``WEIGHT`` shingles lacked or added); a heavier one is cut
   into blocks, by whether its members are linked with the pivot and by size, and
   every two blocks meet that can hold a link between components: not two of
   members linked with the pivot, nor two whose sizes are too far apart.  Only links
   that join components leave a task, fewer than its members.

No pair that shares a band and could be linked goes unexamined, and pairs are
numbers inside a task, never rows.

Results: a document is linked with those whose sets have a Jaccard similarity of
at least the threshold; component_id is the least doc_id reachable.  Null or
wordless texts have an empty set and are linked with nothing.  Fewer words than
a shingle: the whole sequence is the only shingle.  Rows are judged one by one:
repeated rows are exact copies of each other and share a component.  Null ids
stay alone, with a null component.  Extra columns are passed on or ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import STEP, WordHashes, cut_lineage, gram_hashes, packed, stirred, text_key, unpacked
from labelwright.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
WEIGHT, MEMBER = 1 << 18, 128
COLUMNS = 2048
PLACES = 1 << 20
SEED = 20_240_229


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes know no other case)."""
    return text.encode().lower().split() if text else []


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(gram_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


@lru_cache(maxsize=1)
def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi with its first ``width`` entries repeated at the end: all shifts are slices."""
    rng = np.random.default_rng(SEED)
    sigma = rng.permutation(PLACES).astype(np.int32)
    pi = rng.permutation(PLACES).astype(np.int32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` circulant MinHash coordinates of a set that isn't empty."""
    sigma, shifts = permutations(width)
    places = sigma[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    out = shifts[places[0]].copy()
    for i in range(0, len(places), 1024):
        np.minimum(out, shifts[places[i : i + 1024]].min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for i in range(rows):
        out = stirred(out * STEP + grid[:, i])
    return out


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc, key, n_shingles, k1, k2, bands) of a (doc, key, text) table; k1, k2 name the set and are null when it is empty."""
    kind = T.StructType([
        T.StructField("doc", docs.schema["doc"].dataType), T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(cache.of(words_of(text.as_py())), words)
                n.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), sig.append(None)
                    continue
                k1.append(int(np.bitwise_xor.reduce(stirred(s)).view(np.int64)))
                k2.append(int(np.add.reduce(stirred(s ^ STEP)).view(np.int64)))
                sig.append(band_hashes(signature(s, bands * rows), bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(sig, pa.list_(pa.int64()))], [f.name for f in kind.fields])

    return docs.mapInArrow(run, kind)


def compared(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs (a, b, deep) on their full sets: linked, size of a, shingles b lacks and adds and, if ``deep``, those themselves."""
    kind = T.StructType([
        pairs.schema["a"], pairs.schema["b"], T.StructField("linked", T.BooleanType()), T.StructField("size_a", T.LongType()),
        T.StructField("lacks", T.LongType()), T.StructField("adds", T.LongType()), T.StructField("lacked", T.ArrayType(T.LongType())),
        T.StructField("added", T.ArrayType(T.LongType()))])
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, last_set = WordHashes(), None, None
        for batch in batches:
            linked, size, lacks, adds, lacked, added = [], [], [], [], [], []
            for deep, a, b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                a = a.as_py()
                if a != last:
                    last, last_set = a, shingle_set(cache.of(words_of(a)), words)
                other = shingle_set(cache.of(words_of(b.as_py())), words)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(last_set) + len(other) - both))
                size.append(len(last_set)), lacks.append(len(last_set) - both), adds.append(len(other) - both)
                lacked.append(np.setdiff1d(last_set, other, assume_unique=True).view(np.int64) if deep else None)
                added.append(np.setdiff1d(other, last_set, assume_unique=True).view(np.int64) if deep else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *(pa.array(x, pa.int64()) for x in (size, lacks, adds)),
                 pa.array(lacked, pa.list_(pa.int64())), pa.array(added, pa.list_(pa.int64()))], [f.name for f in kind.fields])

    with_b = pairs.hint("merge").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.hint("merge").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "deep", "text_a", "text_b").mapInArrow(run, kind)


def _stars(members: DataFrame) -> DataFrame:
    """(a, b, home): pivots and the members of their stars, from the (bucket, doc) rows of buckets with several documents."""
    sizes = cut_lineage(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    rows = cut_lineage(members.join(sizes, "bucket").select("bucket", "doc", "n"))
    met = rows.groupBy("doc").agg((-F.sum("n")).alias("met"))
    pivots = cut_lineage(rows.join(met, "doc").groupBy("bucket").agg(F.min(F.struct("met", "doc")).alias("pivot")))
    near = cut_lineage(rows.join(pivots, "bucket").select("bucket", "doc", "pivot"))
    homes = near.groupBy("doc").agg(F.min("pivot").alias("home"))
    near = cut_lineage(near.join(homes, "doc"))
    one_home = near.groupBy("bucket").agg(F.min("home").alias("home"), F.max("home").alias("other")).where("home = other")
    one_home = cut_lineage(one_home.select("bucket", F.col("home.doc").alias("only")))
    stars = near.join(one_home, "bucket", "left").select(
        F.coalesce("only", "pivot.doc").alias("a"), F.col("doc").alias("b"), F.col("home.doc").alias("home"))
    return cut_lineage(stars.where(F.col("a") != F.col("b")).distinct())


def _opened(rows: DataFrame) -> DataFrame:
    """(a) of the stars of (a, b, home, part) rows that hold a pair still to be looked at."""
    sums = rows.groupBy("a").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.min("home").alias("h"), F.max("home").alias("i"),
        F.count_if(F.col("home") == F.col("a")).alias("own"))
    return cut_lineage(sums.where("p <> q AND (h <> i OR own > 1)").select("a"))


def _dealt(stars: DataFrame, percent: int, weight: int) -> DataFrame:
    """``stars`` with the ``meeting`` each row goes to, and the ``side`` it takes there: null for light stars, which meet whole."""
    lacks, adds = F.size("lacked"), F.size("added")
    # Sizes of linked sets differ by a factor of 100 / percent at most, so by a step; the steps are a little wider against rounding.
    width = -1.001 * math.log(min(percent, 99.9) / 100)
    rows = stars.withColumns({
        "near": 100 * (F.col("size_a") - lacks) >= percent * (F.col("size_a") + adds),
        "step": F.floor(F.log((F.col("size_a") - lacks + adds).cast("double")) / width)})
    cells = cut_lineage(rows.groupBy("a", "near", "step").agg(F.sum(lacks + adds + MEMBER).alias("weight")))
    heavy = cells.groupBy("a").agg(F.sum("weight").alias("total")).where(F.col("total") > weight).select("a", F.lit(True).alias("heavy"))
    cells = cut_lineage(cells.join(heavy, "a").withColumn("cuts", F.ceil(F.col("weight") / weight)))
    x, y = (cells.select("a", F.struct("near", "step").alias(f"cell_{c}"), F.col("cuts").alias(f"cuts_{c}")) for c in "xy")
    cell_pairs = x.join(y, "a").where("cell_x <= cell_y AND NOT (cell_x.near AND cell_y.near) AND abs(cell_x.step - cell_y.step) <= 1")
    blocks = cell_pairs.withColumn("cut_x", F.explode(F.expr("sequence(0L, cuts_x - 1)"))).withColumn(
        "cut_y", F.explode(F.expr("sequence(if(cell_x = cell_y, cut_x, 0L), cuts_y - 1)")))
    meeting = F.struct("cell_x", "cut_x", "cell_y", "cut_y").alias("meeting")
    sides = F.expr("filter(array(struct(false AS side, cell_x AS cell, cut_x AS cut), struct(true AS side, cell_y AS cell, cut_y AS cut)),"
                   " z -> NOT z.side OR cell_x <> cell_y OR cut_x <> cut_y)")
    seats = cut_lineage(blocks.select("a", meeting, F.explode(sides).alias("seat")).select(
        "a", "meeting", "seat.side", "seat.cell.near", "seat.cell.step", "seat.cut"))
    cuts = cells.select("a", "near", "step", "cuts")
    placed = rows.join(cuts, ["a", "near", "step"], "left").withColumn(
        "cut", F.coalesce(F.pmod(F.xxhash64("b"), F.col("cuts")), F.lit(0)))
    light = placed.where("cuts IS NULL").select(*stars.columns, F.lit(None).cast(seats.schema["meeting"].dataType).alias("meeting"), F.lit(False).alias("side"))
    dealt = placed.where("cuts IS NOT NULL").join(seats, ["a", "near", "step", "cut"]).select(*stars.columns, "meeting", "side")
    return light.union(dealt)


def _shared(held: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Elements in common of the sets ``first`` and ``second`` name, by products of incidence matrices of some columns at a time."""
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    _, column, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    often = times > 1
    kept, rank = often[column], np.cumsum(often) - 1
    owner, column = owner[kept], rank[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(first), len(second)), np.int32)
    for start in range(0, int(often.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, (start, start + COLUMNS)))
        grid = np.zeros((len(held), COLUMNS), np.float32)
        grid[owner[here], column[here] - start] = 1
        out += (grid[first] @ grid[second].T).astype(np.int32)
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of a symmetric matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            edges += [(i, j) for j in new.tolist()]
            queue += new.tolist()
    return edges


def _within(stars: DataFrame, threshold: float, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b) that join the parts of each star, from what its members lack of the pivot and add to it."""
    kind = T.StructType([T.StructField("a", stars.schema["b"].dataType), T.StructField("b", stars.schema["b"].dataType)])
    percent = round(threshold * 100)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        size, side = rows["size_a"][0].as_py(), rows["side"].to_numpy()
        # What is lacked is the pivot's, what is added is not: one set holds both.
        lacked, added = ([x.values.to_numpy() for x in rows[c]] for c in ("lacked", "added"))
        lacks, adds = (np.array([len(x) for x in c]) for c in (lacked, added))
        part, home = (np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in ("part", "home"))
        own = rows["own"].to_numpy()
        # Two blocks are compared with each other; each has had its own meeting.
        first, second = (np.flatnonzero(side == s) for s in (False, side.any()))
        kept = size - lacks[first][:, None] - lacks[second]
        both = kept + _shared([np.concatenate(h) for h in zip(lacked, added)], first, second)
        total = size + kept + adds[first][:, None] + adds[second]
        found = 100 * both >= percent * (total - both)
        found &= part[first][:, None] != part[second]
        found &= (home[first][:, None] != home[second]) | own[first][:, None]
        linked = np.zeros((len(side), len(side)), bool)
        linked[np.ix_(first, second)] = found
        ends = np.array(_forest(linked | linked.T), np.int64).reshape(-1, 2)
        return pa.table([rows["b"].take(pa.array(ends[:, k])) for k in (0, 1)], ["a", "b"])

    dealt = _dealt(stars.select("a", "b", "home", "part", "size_a", "lacked", "added", (F.col("home") == F.col("a")).alias("own")), percent, weight)
    return dealt.groupBy("a", "meeting").applyInArrow(run, kind)


def linked_classes(members: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, component) of the (bucket, doc) rows; see the module's text for the steps."""
    stars = _stars(members)
    sizes = cut_lineage(stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    deep = stars.join(sizes, "a").select("a", "b", (F.col("n") > 1).alias("deep"))
    told = cut_lineage(compared(deep, texts, words, threshold))
    links = told.where("linked").select("a", "b")
    joined = components(links)
    placed = cut_lineage(stars.join(joined.withColumnRenamed("node", "b"), "b", "left").select(
        "a", "b", "home", F.coalesce("component", "b").alias("part")))
    opened = _opened(placed)
    if opened.isEmpty():
        return joined
    placed = cut_lineage(placed.join(opened, "a").join(told.select("a", "b", "size_a", "lacked", "added"), ["a", "b"]))
    return components(links.union(cut_lineage(_within(placed, threshold))))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc, key, n_shingles, component), one row per row of ``docs``; ``key`` tells rows of one id apart by their text."""
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), text_key(text).alias("key"), text.alias("text"))
    seen = cut_lineage(signatures(narrow, words, bands, rows))
    sets = seen.where(F.col("k1").isNotNull() & F.col("doc").isNotNull())
    classes = sets.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    copied = cut_lineage(classes.where(F.col("n") > 1).select("k1", "k2", "rep"))
    sets = sets.join(copied, ["k1", "k2"], "left").withColumn("rep", F.coalesce("rep", "doc"))
    buckets = sets.where(F.col("rep") == F.col("doc")).select(F.explode("bands").alias("bucket"), "doc")
    several = cut_lineage(buckets.groupBy("bucket").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where(
        F.col("low") != F.col("high")).select("bucket"))
    members = cut_lineage(buckets.join(several, "bucket"))
    involved = members.select("doc").distinct()
    # The same plan at every size: texts are the bulk, and move once by id.
    texts = cut_lineage(narrow.drop("key").join(involved.hint("merge"), "doc", "left_semi"))
    joined = linked_classes(members, texts, words, threshold)

    rep_of = seen.join(copied, ["k1", "k2"], "left").select("doc", "key", "n_shingles", F.coalesce("rep", "doc").alias("rep"))
    to = joined.select(F.col("node").alias("rep"), "component")
    return rep_of.join(to, "rep", "left").select("doc", "key", "n_shingles", F.coalesce("component", "rep").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; all columns as they were."""
    gone = near_duplicates(docs, id_col, text_col, **options).where(F.col("doc") != F.col("component")).select("doc", "key").distinct()
    rows = packed(docs, row_doc=F.col(f"`{id_col}`"), row_key=text_key(F.col(f"`{text_col}`")))
    return unpacked(rows.join(gone, (F.col("row_doc") == F.col("doc")) & (F.col("row_key") == F.col("key")), "left_anti"))
