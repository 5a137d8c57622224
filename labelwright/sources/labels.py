"""Label sources: OCR documents as JSON, block tables and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.types import OCR_BLOCK_RECORD, OCR_DOCUMENT

_BLOCKS = ["text_blocks", "ocr_blocks", "blocks"]


def blocks_of_documents(documents: DataFrame) -> DataFrame:
    """(image_id, blocks): the first block list that is not empty, unnamed images as ``pkg_scan``."""
    present = [c for c in _BLOCKS if c in documents.columns]
    lists = [F.when(F.size(c) > 0, F.col(c)) for c in present]
    return documents.select(
        F.coalesce("image_id", F.lit("pkg_scan")).alias("image_id"),
        F.coalesce(*lists, F.col(present[-1]), F.array().cast(documents.schema[present[0]].dataType)).alias("blocks"),
    )


def read_ocr_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """OCR documents, one label per record; the schema is given, nothing is inferred."""
    raw = spark.read.schema(OCR_DOCUMENT).option("multiLine", multi_line).json(path)
    return blocks_of_documents(raw)


def read_block_lists(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a bare list of blocks: one unnamed label per file."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"array<struct<{_struct(OCR_BLOCK_RECORD)}>>")
    return whole.select(F.lit("unknown_image").alias("image_id"), parsed.alias("blocks"))


def _struct(ddl: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def blocks_from_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Labels from a block table, one array per label, in block order.

    For label-sized groups: every group becomes one row.  Tables whose groups
    outgrow a row go through ``first_declarations`` and ``reading_order``, which
    never gather a group.
    """
    block = F.struct(order, "block_id", "text", "confidence", "bbox")
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(block)).alias("_b"))
    return grouped.select(F.col(key), F.transform("_b", lambda b: b.dropFields(order)).alias("blocks"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their validity: id, file name, text."""
    files = spark.read.text(path, wholetext=True).withColumn("filepath", F.input_file_name())
    return files.select(
        F.concat(F.lit("doc_"), base_name(F.col("filepath"))).alias("document_id"),
        base_name(F.col("filepath")).alias("filename"), "filepath",
        is_readable(F.col("filepath")).alias("is_valid"),
        F.when(is_readable(F.col("filepath")), F.lit("validated")).otherwise(F.lit("mock_loaded")).alias("status"),
        F.col("value").alias("text"),
    )


def base_name(path):
    return F.element_at(F.split(path, "/"), -1)


def is_readable(path):
    """Text and PDF files are accepted."""
    return F.lower(path).rlike(r"\.(pdf|txt)$")
