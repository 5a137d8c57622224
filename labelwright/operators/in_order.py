"""Ranks and column breaks over ordered groups of any size.

A plain window puts a whole group into one task.  Here rows are range-split on
(group, order), so one large group spreads over many tasks; each task works on
its own stretch, and a small summary per (group, stretch) carries the state
from one stretch to the next.  The split is written to the checkpoint folder so
that a lost executor cannot change which stretch a row belongs to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.session import cut_lineage

STRETCH = "_stretch"


def split_in_order(df: DataFrame, keys: list[str], order: list[Column], stretches: int | None = None) -> DataFrame:
    """Range-split ``df`` on (keys, order) and tag each row with its stretch."""
    n = stretches or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(STRETCH, F.spark_partition_id()))


def _with_state(rows: DataFrame, state: DataFrame, place: list[str]) -> DataFrame:
    """Rows with the state of their stretch; a null key is a group like any other."""
    names = {k: f"_of_{i}" for i, k in enumerate(place)}
    renamed = state.withColumnsRenamed(names)
    same = reduce(Column.__and__, [rows[k].eqNullSafe(renamed[n]) for k, n in names.items()])
    return rows.join(renamed, same).drop(*names.values())


def rank_in_order(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", stretches: int | None = None
) -> DataFrame:
    """1, 2, 3, ... within each group in the given order."""
    split = split_in_order(df, keys, order, stretches)
    place = [*keys, STRETCH]
    local = split.withColumn("_local", F.row_number().over(W.partitionBy(*place).orderBy(*order)))
    sizes = split.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*place, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        _with_state(local, offsets, place)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", STRETCH)
    )


def column_breaks(
    df: DataFrame, keys: list[str], start: Column, extent: Column, tie: list[Column], gap: float,
    name: str = "column_id", stretches: int | None = None,
) -> DataFrame:
    """Number the runs of rows whose start lies within ``gap`` of the end of the row before."""
    work = df.withColumn("_start", start).withColumn("_end", start + extent)
    order = [F.col("_start"), *tie]
    split = split_in_order(work, keys, order, stretches)
    place = [*keys, STRETCH]
    run = W.partitionBy(*place).orderBy(*order)
    rows = split.withColumn("_prev", F.lag("_end").over(run)).withColumn(
        "_break", F.coalesce((F.col("_start") - F.col("_prev") > gap).cast("int"), F.lit(0))
    )
    rows = rows.withColumn("_inside", F.sum("_break").over(run.rowsBetween(W.unboundedPreceding, 0)))

    ordering = F.struct(*order)
    summary = rows.groupBy(*place).agg(
        F.min("_start").alias("_head"),
        F.max_by("_end", ordering).alias("_tail"),
        F.sum("_break").alias("_breaks"),
    )
    by_stretch = W.partitionBy(*keys).orderBy(STRETCH)
    summary = summary.withColumn(
        "_head_break",
        F.coalesce((F.col("_head") - F.lag("_tail").over(by_stretch) > gap).cast("int"), F.lit(0)),
    )
    so_far = by_stretch.rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *place,
        (F.col("_head_break") + F.coalesce(F.sum(F.col("_breaks") + F.col("_head_break")).over(so_far), F.lit(0)))
        .alias("_carried"),
    )
    return (
        _with_state(rows, carried, place)
        .withColumn(name, F.col("_inside") + F.col("_carried"))
        .drop("_start", "_end", "_prev", "_break", "_inside", "_carried", STRETCH)
    )
