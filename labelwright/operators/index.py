"""Chunk index: upsert, delete, lookup and the filters applied to candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.text import truthy
from labelwright.operators.in_order import rank_in_order
from labelwright.session import cut_lineage, small_side


def unit_vector(v: Column) -> Column:
    """The vector scaled to length one; a zero vector is kept."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(
        F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")),
                    lambda z: F.when(z["n"] > 0, z["x"].cast("double") / z["n"]).otherwise(z["x"].cast("double"))),
        lambda x: x.cast("float"),
    )


def prepare(batch: DataFrame, count: int, order: str = "batch_ord", embedding: str = "embedding") -> DataFrame:
    """Give each document of a batch an id and a place.

    A document without an id gets the number of documents in the store plus its
    position in the batch.  Documents that bring a vector come first.  Equal
    order values are told apart by the documents' content, so that the outcome
    never depends on how the batch is split.
    """
    ids = [truthy(F.col(c).cast("string")) for c in ("chunk_id", "id") if c in batch.columns]
    numbered = rank_in_order(batch, [], [F.col(order), F.xxhash64(*batch.columns)], "_position")
    late = F.col(embedding).isNull() if embedding in batch.columns else F.lit(True)
    return numbered.withColumn("chunk_id", F.coalesce(*ids, (F.col("_position") + count).cast("string"))).withColumn(
        "_place", F.struct(late.alias("late"), F.col("_position").alias("position"))).drop("_position")


def upsert(store: DataFrame, batch: DataFrame, order: str = "batch_ord") -> DataFrame:
    """Store after the batch: same ids replaced in place, new ids appended without gaps.

    Only batch ids travel to the store.  Of documents with one id the last in
    the batch stays, at the place of the first; ``insert_ord`` of a replaced id
    keeps its position.
    """
    count, top = store.agg(F.count(F.lit(1)), F.coalesce(F.max("insert_ord"), F.lit(-1))).first()
    placed = prepare(batch, count, order)
    cols = [c for c in store.columns if c not in ("chunk_id", "insert_ord")]
    newest = cut_lineage(placed.groupBy("chunk_id").agg(
        F.max_by(F.struct(*cols), "_place").alias("_row"), F.min("_place").alias("_first")))
    ids = newest.select("chunk_id")
    places = store.join(ids, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("insert_ord").alias("_old"))
    known = newest.join(places, "chunk_id").select("chunk_id", "_row", F.col("_old").alias("insert_ord"))
    fresh = rank_in_order(newest.join(places, "chunk_id", "left_anti"), [], [F.col("_first")], "_nth")
    fresh = fresh.select("chunk_id", "_row", (F.col("_nth") + top).alias("insert_ord"))
    added = known.unionByName(fresh).select("chunk_id", *[F.col("_row")[c].alias(c) for c in cols], F.col("insert_ord").cast("long"))
    kept = store.join(ids, "chunk_id", "left_anti")
    return kept.select("chunk_id", *cols, F.col("insert_ord").cast("long")).unionByName(added)


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(small_side(ids.select("chunk_id").distinct()), "chunk_id", "left_anti")


def lookup(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata of the requested ids; null columns for an unknown id."""
    return ids.join(store, "chunk_id", "left")


def first_inserted(store: DataFrame, k: int, score: float = 0.88) -> DataFrame:
    """The placeholder search of the first generation: the k oldest rows, constant score."""
    return store.orderBy("insert_ord").limit(k).withColumn("score", F.lit(score))


def with_status(df: DataFrame, status: str | None = "current") -> DataFrame:
    """Rows of one status; a null status never matches."""
    return df if status is None else df.filter(F.col("status") == status)


def matching(df: DataFrame, filters: dict) -> DataFrame:
    """Rows whose columns equal every given value; None matches null, an unknown column is null."""
    def test(name, value) -> Column:
        column = F.col(name) if name in df.columns else F.lit(None)
        return column.eqNullSafe(F.lit(value))

    conditions = [test(k, v) for k, v in filters.items()]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def in_force(df: DataFrame, on: str | Column) -> DataFrame:
    """Provisions in force on a day: not superseded, and inside their dates at both ends."""
    day = F.lit(on) if isinstance(on, str) else on
    starts, ends = truthy(F.col("effective_from")), truthy(F.col("effective_to"))
    return df.filter(
        (F.lower(F.coalesce(F.col("status"), F.lit("current"))) != "superseded")
        & (starts.isNull() | (day >= starts))
        & (ends.isNull() | (day <= ends))
    )
