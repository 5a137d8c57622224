"""Helpers shared by the operators: word hashes, stable samples, small samples brought to the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.session import ensure_checkpoint_dir

BATCH_ROWS = 500
STEP = np.uint64(0x9E3779B97F4A7C15)
STIR_1 = np.uint64(0xFF51AFD7ED558CCD)
STIR_2 = np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """64-bit hash of a word; words seen lately are remembered, in bounded memory."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def stirred(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    x = (x ^ (x >> np.uint64(33))) * STIR_1
    x = (x ^ (x >> np.uint64(29))) * STIR_2
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out = out * STEP + words[i : i + n]
    return stirred(out)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` alone would change other scripts)."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def text_key(c: Column) -> Column:
    """64 bits of a text: with the document's id it tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(c, F.lit("")))


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns in one struct ``row``, beside the named ones: names of the table cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in extra.items()])


def unpacked(df: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``row`` again, in order, with some replaced or added."""
    names = df.schema["row"].dataType.names
    kept = [changed.get(n, F.col("row").getField(n)).alias(n) for n in names]
    return df.select(*kept, *[v.alias(k) for k, v in changed.items() if k not in names])


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """Texts one at a time, so that only the Arrow buffer holds them all."""
    return (x.as_py() for x in column)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started meanwhile give Python ``BATCH_ROWS`` rows at once: ten thousand texts are more than a small executor has room for."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder, and read again.

    A checkpoint would keep what the optimiser knew of its columns and of their
    partitioning; over the turns of a loop that multiplies until planning takes
    longer than the work.  A table is also smaller and read by column.

    Rows hold whole texts, so the work is done in ``small_batches``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of(c: Column | str) -> Column:
    """crc32 of a value written as text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, the same ones every time, spread over the table by a hash of ``keys``.

    Only for fitting a model: ``rows`` is a documented parameter of each caller.
    The order is by hash, so a top-k per task is all that travels.
    """
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def spread_sample(df: DataFrame, rows: int, of: str, *keys: str) -> DataFrame:
    """``bounded_sample`` that takes one row of every value of ``of`` before a second of any.

    So no value is lost while there are at most ``rows`` of them.  The rank is
    cut at ``rows`` by every task before the shuffle, however hot a value is.
    """
    first = Window.partitionBy(of).orderBy(F.xxhash64(*keys), *keys)
    ranked = df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= rows)
    return ranked.orderBy("_rank", F.xxhash64(*keys), *keys).limit(rows).drop("_rank")


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, the first by hash: bounds on keys are bounds on rows then.  Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_one"))
    return chosen.select(*keys, *[F.col("_one").getField(c).alias(c) for c in rest])
