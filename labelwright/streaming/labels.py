"""Label scans over a stream of OCR documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.plans.scan import scan_labels
from labelwright.sources.labels import blocks_of_documents
from labelwright.types import OCR_DOCUMENT


def stream_ocr_json(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New OCR documents in a folder, one label per line."""
    raw = spark.readStream.schema(OCR_DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return blocks_of_documents(raw)


def scan_stream(labels: DataFrame) -> DataFrame:
    """The batch scan applied to a stream: it works inside the row, so it keeps no state."""
    return scan_labels(labels)


def status_counts(scanned: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Verdicts per window, closed once the watermark passes."""
    return scanned.withWatermark(time, late).groupBy(F.window(time, window).alias("period"), "overall_status").agg(
        F.count(F.lit(1)).alias("n_labels"))
