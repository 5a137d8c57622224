"""From blocks of a label to its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.config import LayoutConfig
from labelwright.functions.fields import declared_value
from labelwright.functions.text import truthy
from labelwright.operators.blocks import mean_confidence
from labelwright.operators.decide import all_issues, missing_in_row, status_of_fields
from labelwright.operators.extract import extract_fields
from labelwright.operators.layout import analyze_layout
from labelwright.operators.report import VALUE_FIELDS


def value_of(fields: Column, name: str) -> Column:
    """Shown value of one declaration, null when absent."""
    entry = F.get(F.filter(fields, lambda f: f["field_name"] == name), F.lit(0))
    return declared_value(entry["normalized_value"], entry["raw_text"])


def net_quantity_of(fields: Column) -> Column:
    entry = F.get(F.filter(fields, lambda f: f["field_name"] == "net_quantity"), F.lit(0))
    value = declared_value(entry["normalized_value"], entry["raw_text"])
    raw = F.trim(F.concat_ws(" ", value, F.coalesce(entry["unit"], F.lit("None"))))
    return F.when(entry.isNotNull(), F.struct(raw.alias("raw"), value.alias("value"), entry["unit"].alias("unit")))


def listed(fields: Column, name: str) -> Column:
    """A comma list declaration as an array; empty when absent."""
    value = value_of(fields, name)
    return F.coalesce(F.when(truthy(value).isNotNull(), F.split(value, ", ")), F.array().cast("array<string>"))


def scan_labels(labels: DataFrame, blocks: str = "blocks", layout: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Reading order, declarations, missing declarations, issues and verdict of each label.

    Everything is computed inside the label's row, so a scan of any number of
    labels is one pass without a shuffle.
    """
    ordered = analyze_layout(labels, blocks, layout.column_gap, layout.image_height)
    counted = ordered.withColumn("ocr_detections_count", F.size(blocks)).withColumn(
        "mean_confidence", mean_confidence(F.col(blocks)))
    read = extract_fields(counted, blocks)
    fields = F.col("extracted_fields")
    out = read.withColumn("missing_mandatory_fields", missing_in_row(fields)).withColumn(
        "overall_status", status_of_fields(fields))
    return out.withColumn("issues", all_issues(fields, F.col("missing_mandatory_fields"))).withColumn(
        "is_compliant", (F.col("overall_status") == "PASS") & (F.size("missing_mandatory_fields") == 0))


def response(scanned: DataFrame, scan_id: Column) -> DataFrame:
    """Scan results in the shape of the service's answer, with their evidence where the scan found some."""
    fields = F.col("extracted_fields")
    data = F.struct(
        *[(net_quantity_of(fields) if n == "net_quantity" else value_of(fields, n)).alias(n) for n in VALUE_FIELDS],
        listed(fields, "allergens").alias("allergens"),
        listed(fields, "ingredients").alias("ingredients"),
        listed(fields, "ins_additives").alias("additives"),
    )
    compliance = F.struct("is_compliant", "issues", "overall_status")
    payload = ["commodity_type", "extracted_fields", *(c for c in ("evidences",) if c in scanned.columns)]
    return scanned.select(
        scan_id.alias("scan_id"), "ocr_detections_count", data.alias("extracted_data"), "missing_mandatory_fields",
        compliance.alias("compliance"),
        F.struct(*payload).alias("rag_payload"),
    )


def merge_panels(panels: DataFrame, scan_key: str = "scan_id", panel: str = "panel_ord") -> DataFrame:
    """Declarations of a scan taken over several panels: the earliest panel that carries one wins.

    Each declaration combines map-side (``min_by``); the winning panel is kept as provenance.
    """
    rows = panels.select(scan_key, panel, F.explode_outer("extracted_fields").alias("_f"))
    valued = declared_value(F.col("_f.normalized_value"), F.col("_f.raw_text"))
    best = rows.filter(valued.isNotNull()).groupBy(scan_key, F.col("_f.field_name").alias("field_name")).agg(
        F.min_by("_f", panel).alias("field"), F.min(panel).alias("panel_ord"))
    return best.select(scan_key, "field_name", "field", "panel_ord")
