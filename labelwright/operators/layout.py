"""Layout: zones, numeral heights in pixels, columns and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed import limits as lim
from labelwright.functions.measures import zone
from labelwright.operators.in_order import column_breaks, rank_in_order


def _box(b: Column, default: tuple[float, ...]) -> Column:
    return F.coalesce(b["bbox"], F.array(*[F.lit(float(v)) for v in default]))


def annotate(blocks: Column, image_height: Column | float = lim.DEFAULT_IMAGE_HEIGHT) -> Column:
    """Each block with an id, its height in pixels and its zone."""

    def one(b: Column, i: Column) -> Column:
        box = _box(b, (0, 0, 50, 20))
        return F.struct(
            F.coalesce(b["block_id"], F.format_string("blk_%03d", i + 1)).alias("block_id"),
            b["text"].alias("text"),
            b["confidence"].alias("confidence"),
            b["bbox"].alias("bbox"),
            F.get(box, F.lit(3)).cast("int").alias("font_height_px"),
            zone(F.get(box, F.lit(1)), image_height).alias("layout_position"),
        )

    return F.transform(blocks, one)


def analyze_layout(
    labels: DataFrame, blocks: str = "blocks", gap: float = lim.COLUMN_GAP_PX,
    image_height: Column | float = lim.DEFAULT_IMAGE_HEIGHT,
) -> DataFrame:
    """Blocks of each label annotated and put into reading order, without moving rows.

    One record is one label, so the work stays inside the row; for block tables
    whose groups can be large use ``reading_order``.
    """
    zero = (0, 0, 0, 0)
    by_x = F.sort_array(F.transform(
        annotate(F.col(blocks), image_height),
        lambda b, i: F.struct(
            F.get(_box(b, zero), F.lit(0)).alias("x"), i.alias("ord"),
            F.get(_box(b, zero), F.lit(1)).alias("y"), F.get(_box(b, zero), F.lit(2)).alias("w"),
            b.alias("block"),
        ),
    ))
    start = F.struct(F.lit(0).alias("col"), F.lit(None).cast("double").alias("edge"))

    # Walk the blocks left to right; a wide gap after the previous block opens a column.
    def step(acc: Column, b: Column) -> Column:
        col = acc["at"]["col"] + F.coalesce((b["x"] - acc["at"]["edge"] > gap).cast("int"), F.lit(0))
        return F.struct(
            F.struct(col.alias("col"), (b["x"] + b["w"]).alias("edge")).alias("at"),
            F.concat(acc["cols"], F.array(col)).alias("cols"),
        )

    out = labels.withColumn("_by_x", by_x)
    out = out.withColumn("_cols", F.aggregate(
        F.col("_by_x"),
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("cols")),
        step,
        lambda acc: acc["cols"],
    ))
    placed = F.sort_array(F.transform(
        F.arrays_zip(F.col("_cols"), F.col("_by_x")),
        lambda z: F.struct(
            z["_cols"].alias("col"), z["_by_x"]["y"].alias("y"), z["_by_x"]["x"].alias("x"),
            z["_by_x"]["ord"].alias("ord"), z["_by_x"]["block"].alias("block"),
        ),
    ))
    return out.withColumn(blocks, F.transform(placed, lambda p: p["block"])).drop("_by_x", "_cols")


def column_clusters(
    blocks: DataFrame, keys: list[str], x: Column, width: Column, tie: list[Column], gap: float = lim.COLUMN_GAP_PX
) -> DataFrame:
    """Column number of every block of a block table."""
    return column_breaks(blocks, keys, x, width, tie, gap, "column_id")


def reading_order(
    blocks: DataFrame, keys: list[str], x: Column, y: Column, width: Column, tie: list[Column],
    gap: float = lim.COLUMN_GAP_PX,
) -> DataFrame:
    """Position of every block of a block table: by column, then top to bottom."""
    clustered = column_clusters(blocks, keys, x, width, tie, gap)
    return rank_in_order(clustered, keys, [F.col("column_id"), y, x, *tie], "reading_rank")
