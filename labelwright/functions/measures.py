"""Measures: confidence, numeral height, image quality, boxes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.fixed import limits as lim
from labelwright.fixed.label_patterns import ORIENTATION_WORDS
from labelwright.functions.fields import declared_value
from labelwright.functions.text import half_even


def zone(y: Column, image_height: Column | float = lim.DEFAULT_IMAGE_HEIGHT) -> Column:
    height = image_height if isinstance(image_height, Column) else F.lit(float(image_height))
    ratio = y / F.greatest(F.lit(1.0), height)
    return (
        F.when(ratio < lim.TOP_BELOW, F.lit("top"))
        .when(ratio > lim.BOTTOM_ABOVE, F.lit("bottom"))
        .otherwise(F.lit("middle"))
    )


def numeral_height(quantity: Column, unit: Column, numeral_px: Column, panel_px: Column) -> Column:
    """Minimum numeral height check for a declared net quantity."""
    clean = F.trim(F.lower(unit))
    base = quantity * F.when(clean.isin(*lim.THOUSANDFOLD_UNITS), 1000.0).otherwise(1.0)
    required = F
    for limit, mm in lim.NUMERAL_HEIGHT_TIERS:
        required = required.when(base <= limit, F.lit(mm))
    required = required.otherwise(F.lit(lim.NUMERAL_HEIGHT_ABOVE))
    ratio = numeral_px / F.greatest(F.lit(1), panel_px).cast("double")
    estimated = ratio * F.lit(lim.PANEL_HEIGHT_MM)
    passed = estimated >= required * F.lit(lim.NUMERAL_TOLERANCE)
    return F.struct(
        passed.alias("is_compliant"),
        F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        quantity.alias("net_quantity_val"),
        clean.alias("unit"),
        numeral_px.cast("int").alias("numeral_height_px"),
        half_even(ratio * 100, 2).alias("font_ratio_pdp_pct"),
        half_even(estimated, 1).alias("est_height_mm"),
        required.alias("required_min_mm"),
        F.lit(lim.NUMERAL_REGULATION).alias("regulation_id"),
        F.lit(lim.NUMERAL_PENALTY).alias("penalty_provision"),
        F.concat(
            F.lit("Ensure net quantity numerals are printed with minimum height of "),
            required.cast("string"), F.lit(" mm."),
        ).alias("recommendation"),
    )


def image_quality(width: Column, height: Column, size_bytes: Column) -> Column:
    """Resolution, size and reading quality of an image."""
    megapixels = half_even(width.cast("double") * height / F.lit(1_000_000.0), 2)
    label, colour = F, F
    for floor, text, shade in lim.IMAGE_TIERS:
        label = label.when(megapixels >= floor, F.lit(text))
        colour = colour.when(megapixels >= floor, F.lit(shade))
    return F.struct(
        width.alias("width"),
        height.alias("height"),
        megapixels.alias("megapixels"),
        half_even(size_bytes / F.lit(1024.0), 1).alias("size_kb"),
        label.otherwise(F.lit(lim.IMAGE_TIER_BELOW[0])).alias("quality_label"),
        colour.otherwise(F.lit(lim.IMAGE_TIER_BELOW[1])).alias("quality_color"),
    )


def bounding_box(polygon: Column) -> Column:
    """Upright box [x, y, w, h] of a polygon of [x, y] points; both edges count."""
    xs = F.transform(polygon, lambda p: F.get(p, F.lit(0)).cast("int"))
    ys = F.transform(polygon, lambda p: F.get(p, F.lit(1)).cast("int"))
    box = F.array(
        F.array_min(xs), F.array_min(ys),
        F.array_max(xs) - F.array_min(xs) + 1, F.array_max(ys) - F.array_min(ys) + 1,
    )
    empty = polygon.isNull() | (F.size(polygon) == 0)
    return F.when(empty, F.array(*[F.lit(v) for v in (0, 0, 50, 20)])).otherwise(box)


def orientation_score(joined_text: Column, high_confidence: Column, mean_confidence: Column) -> Column:
    """Score of one orientation probe: label words, confident blocks, mean confidence."""
    lowered = F.lower(joined_text)
    words = F.lit(0)
    for word in ORIENTATION_WORDS:
        words = words + F.contains(lowered, F.lit(word)).cast("int")
    return words * F.lit(10.0) + high_confidence * F.lit(1.0) + mean_confidence * F.lit(5.0)


def label_words(joined_text: Column) -> Column:
    """How many of the words that labels carry a probe's text holds."""
    lowered = F.lower(joined_text)
    return sum((F.contains(lowered, F.lit(word)).cast("int") for word in ORIENTATION_WORDS), F.lit(0))


def field_status(normalized: Column, raw: Column, confidence: Column) -> Column:
    conf = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(declared_value(normalized, raw).isNull() | (conf < lim.FAIL_BELOW), F.lit("FAIL"))
        .when(conf >= lim.PASS_FROM, F.lit("PASS"))
        .otherwise(F.lit("UNCERTAIN"))
    )


def field_reason(field: Column, status: Column, confidence: Column, rule: Column) -> Column:
    quoted = F.concat(F.lit("Field '"), field, F.lit("' "))
    return (
        F.when(status == "FAIL", F.concat(
            quoted, F.lit("is missing or low confidence ("),
            F.coalesce(confidence, F.lit(0.0)).cast("string"), F.lit(").")))
        .when(status == "PASS", F.concat(
            quoted, F.lit("present with sufficient confidence and complies with "),
            F.coalesce(rule, F.lit("None")), F.lit(".")))
        .otherwise(F.concat(quoted, F.lit("extracted but requires manual inspection.")))
    )


def severity(status: Column) -> Column:
    return F.when(status == "FAIL", 2).when(status == "UNCERTAIN", 1).otherwise(0)


def status_of_severity(level: Column) -> Column:
    """Package status of the worst field; a package without fields passes."""
    return F.when(level == 2, F.lit("FAIL")).when(level == 1, F.lit("UNCERTAIN")).otherwise(F.lit("PASS"))


def switched_on(flag: Column) -> Column:
    return F.lower(flag).isin("true", "1", "yes")


def url_with_scheme(url: Column) -> Column:
    """A camera address with a scheme."""
    clean = F.trim(url)
    return F.when((clean == "") | clean.rlike("^(http|https|rtsp)://"), clean).otherwise(F.concat(F.lit("http://"), clean))
