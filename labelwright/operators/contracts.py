"""Record contracts: which requirements a record violates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.fixed.limits import COMPLIANCE_STATUSES


def _violations(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def _within(c: Column, low: float, high: float) -> Column:
    return c.between(low, high)


def ocr_violations(image_id: Column, blocks: Column) -> Column:
    """A document needs an id and blocks; a block needs text, a confidence in [0, 1] and a box of four."""
    return _violations([
        ("image_id", image_id.isNotNull()),
        ("text_blocks", blocks.isNotNull()),
        ("text", F.forall(blocks, lambda b: b["text"].isNotNull())),
        ("confidence", F.forall(blocks, lambda b: F.coalesce(_within(b["confidence"], 0.0, 1.0), F.lit(False)))),
        ("bbox", F.forall(blocks, lambda b: F.coalesce(F.size(b["bbox"]) == 4, F.lit(False)))),
    ])


def extraction_violations(image_id: Column, commodity: Column, fields: Column) -> Column:
    return _violations([
        ("image_id", image_id.isNotNull()),
        ("commodity_type", commodity.isNotNull()),
        ("extracted_fields", fields.isNotNull()),
        ("field_name", F.forall(fields, lambda f: f["field_name"].isNotNull())),
        ("raw_text", F.forall(fields, lambda f: f["raw_text"].isNotNull())),
        ("confidence", F.forall(fields, lambda f: F.coalesce(_within(f["confidence"], 0.0, 1.0), F.lit(False)))),
    ])


def check_violations(query: Column) -> Column:
    return _violations([
        (k, query[k].isNotNull()) for k in ("check_id", "domain", "commodity_type", "field", "query_terms")])


def evidence_violations(evidence: Column) -> Column:
    required = ("check_id", "chunk_id", "document", "rule", "text", "retrieval_score", "citation")
    return _violations([
        *[(k, evidence[k].isNotNull()) for k in required],
        ("score_range", _within(evidence["retrieval_score"], 0.0, 1.0)),
        ("citation.document", evidence["citation"]["document"].isNotNull()),
        ("citation.rule", evidence["citation"]["rule"].isNotNull()),
    ])


def status_allowed(status: Column) -> Column:
    return status.isin(*COMPLIANCE_STATUSES)
