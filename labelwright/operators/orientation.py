"""Which way up an image is, from text probes at four angles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.fixed import limits as lim
from labelwright.functions.measures import label_words, orientation_score


def probe_scores(blocks: DataFrame, image: str = "image_id", angle: str = "angle") -> DataFrame:
    """(image, angle, words, confident, score) of the text blocks read at every angle.

    blocks: image, angle, block_ord, text, confidence; one row per block.  The
    text of a probe is gathered in block order, so a probe is bounded by what a
    thumbnail shows; means and counts combine map-side.
    """
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    ordered = F.sort_array(F.collect_list(F.struct("block_ord", F.coalesce("text", F.lit("")).alias("text"))))
    probes = blocks.groupBy(image, angle).agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text"),
        F.count_if(confidence >= lim.ORIENTATION_CONFIDENT).alias("confident"), F.avg(confidence).alias("mean"))
    return probes.select(
        image, angle, label_words(F.col("text")).alias("words"), "confident",
        orientation_score(F.col("text"), F.col("confident"), F.col("mean")).alias("score"))


def turns(probes: DataFrame, image: str = "image_id", angle: str = "angle") -> DataFrame:
    """(image, turn): degrees clockwise that set each image upright.

    One aggregate over the probe rows; a probe that was not taken or found no
    text scores 0.  The stages decide in order: a probe that reads well as it is
    ends the search, then a quarter turn either way, then, for an image that
    reads badly as it is, a half turn.
    """
    def at(degrees: int, column: str):
        return F.coalesce(F.max(F.when(F.col(angle) == degrees, F.col(column))), F.lit(0))

    sums = probes.groupBy(image).agg(
        at(0, "words").alias("words"), at(0, "confident").alias("confident"), *[at(d, "score").alias(f"s{d}") for d in (0, 90, 180, 270)])
    s0, s90, s180, s270 = (F.col(f"s{d}") for d in (0, 90, 180, 270))
    enough = lim.ORIENTATION_LEAST
    reads = (F.col("words") >= lim.ORIENTATION_WORDS_ENOUGH) & (F.col("confident") >= lim.ORIENTATION_BLOCKS_ENOUGH)
    return sums.select(image, (
        F.when(reads, 0)
        .when((s90 > s0 * lim.ORIENTATION_QUARTER) & (s90 > enough), 90)
        .when((s270 > s0 * lim.ORIENTATION_QUARTER) & (s270 > s90) & (s270 > enough), 270)
        .when((s0 < lim.ORIENTATION_POOR) & (s180 > s0 * lim.ORIENTATION_HALF) & (s180 > enough), 180)
        .otherwise(0)).alias("turn"))
