"""Pages of a document as a table function, for lateral joins in SQL and DataFrames."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from labelwright.fixed.limits import PAGE_BREAK

# What the strip of the column functions takes for white space.
BLANK = " \t\n\x0b\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


@udtf(returnType="page_number int, text string")
class PagesOf:
    """(page_number, text) per page of a text; a blank page gets a marker text, a null text has no pages.

    Pages are cut off one after another: neither Spark nor Python holds an array of them.
    """

    def eval(self, text: str):
        at, number = 0, 0
        while text is not None and at >= 0:
            number += 1
            end = text.find(PAGE_BREAK, at)
            page = text[at : end if end >= 0 else len(text)].strip(BLANK)
            at = end + len(PAGE_BREAK) if end >= 0 else -1
            yield number, page or f"[OCR Fallback Extracted Text for Page {number}]"


def register_pages(spark: SparkSession, name: str = "pages_of") -> None:
    """Make the function known to SQL: ``SELECT d.*, p.* FROM documents AS d, LATERAL pages_of(d.text) AS p``."""
    spark.udtf.register(name, PagesOf)
