"""From page texts to a validated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelwright.operators.checks import validate_catalogue, validation_summary
from labelwright.operators.corpus import chunks_from_pages, enforce_schema, read_pages
from labelwright.operators.report import validation_line


def build_corpus(pages: DataFrame, text: str = "page_text", index: str = "pdf_page_index") -> DataFrame:
    """Chunks of the provisions that the pages bring in, in order of appearance."""
    chunks = chunks_from_pages(read_pages(pages, text, index), text, order=index)
    return enforce_schema(chunks)


def validate(chunks: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Details, summary and Markdown lines of the catalogue validation."""
    details = validate_catalogue(targets, chunks)
    return details, validation_summary(details), details.select("check_id", validation_line(details).alias("line"))
