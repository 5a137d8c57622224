"""Block tables and per-label block arrays: confidence and joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed.limits import MIN_CONFIDENCE
from labelwright.functions.text import half_even


def explode_blocks(labels: DataFrame, blocks: str = "blocks") -> DataFrame:
    """One row per block with its position in the label."""
    others = [c for c in labels.columns if c != blocks]
    return labels.select(*others, F.posexplode(blocks).alias("block_ord", "_b")).select(
        *others, "block_ord", "_b.*"
    )


def keep_confident(blocks: Column, minimum: float = MIN_CONFIDENCE) -> Column:
    """Blocks at or above the minimum; a block without confidence is kept."""
    return F.filter(blocks, lambda b: F.coalesce(b["confidence"], F.lit(1.0)) >= minimum)


def keep_confident_rows(blocks: DataFrame, confidence: str = "confidence", minimum: float = MIN_CONFIDENCE) -> DataFrame:
    return blocks.filter(F.coalesce(F.col(confidence), F.lit(1.0)) >= minimum)


def mean_confidence(blocks: Column) -> Column:
    """Mean confidence of a label's blocks to four places; no blocks give 0."""
    total = F.aggregate(blocks, F.lit(0.0), lambda s, b: s + F.coalesce(b["confidence"], F.lit(0.0)))
    return F.when(F.size(blocks) > 0, half_even(total / F.size(blocks), 4)).otherwise(F.lit(0.0))


def mean_confidence_rows(confidence: Column) -> Column:
    """The same mean as an aggregate over block rows."""
    return F.coalesce(F.round(F.avg(F.coalesce(confidence, F.lit(0.0))), 4), F.lit(0.0))


def joined_text(blocks: Column, separator: str) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), separator)
