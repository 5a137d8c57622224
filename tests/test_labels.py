"""Labels from blocks to answer: layout, extraction, scan, panels, contracts, report."""

import random

from pyspark.sql import functions as F

from labelwright.operators import blocks as bl
from labelwright.operators import contracts as ct
from labelwright.operators import report as rp
from labelwright.operators.checks import checks_for_fields, route
from labelwright.operators.extract import extract_fields
from labelwright.operators.in_order import column_breaks, rank_in_order
from labelwright.operators.layout import analyze_layout
from labelwright.plans.scan import merge_panels, response, scan_labels

BLOCKS = "array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>"


def labels(spark, *rows):
    return spark.createDataFrame(
        [(i, [(None, t, c, b) for t, c, b in bs]) for i, bs in rows], f"image_id string, blocks {BLOCKS}")


PACKAGE = ("pkg_1", [
    ("MRP Rs. 120.00 (Incl. of all taxes)", 0.96, [10.0, 10.0, 200.0, 20.0]), ("Net Qty: 500 g", 0.98, [10.0, 40.0, 150.0, 20.0]),
    ("Mfg Date: 05/2026", 0.94, [10.0, 70.0, 150.0, 20.0]), ("Mktd by ABC Foods, Mumbai", 0.9, [10.0, 100.0, 300.0, 20.0]),
    ("Consumer care: help@abc.in, 1800-111-222", 0.92, [10.0, 130.0, 300.0, 20.0])])
FOOD = ("food_1", [
    ("FSSAI Lic. No. 10012011000168", 0.95, [0.0, 0.0, 9.0, 9.0]), ("MRP Rs. 14.00", 0.9, [0.0, 30.0, 9.0, 9.0]),
    ("Net Quantity: 70 g", 0.9, [0.0, 60.0, 9.0, 9.0]),
    ("Ingredients: Wheat Flour, Palm Oil, Salt, Acidity Regulator (INS 330). Allergen Note: May contain Milk and Soy.", 0.92,
     [0.0, 90.0, 9.0, 9.0])])


def test_package_label(spark):
    r = scan_labels(labels(spark, PACKAGE)).first()
    fields = [(f.field_name, f.raw_text, f.normalized_value, f.unit, f.confidence) for f in r.extracted_fields]
    assert fields == [("mrp", "MRP Rs. 120.00", "120.0", "INR", 0.96), ("net_quantity", "Net Qty: 500 g", "500.0", "g", 0.98)]
    assert r.commodity_type == "general_commodity" and r.overall_status == "PASS" and not r.is_compliant
    assert r.missing_mandatory_fields == ["mfg_date", "fssai_license", "manufacturer"]
    assert r.ocr_detections_count == 5 and len(r.issues) == 3


def test_food_label(spark):
    r = scan_labels(labels(spark, FOOD)).first()
    got = {f.field_name: f.normalized_value for f in r.extracted_fields}
    assert r.commodity_type == "food"
    assert [f.field_name for f in r.extracted_fields] == ["fssai_license", "mrp", "net_quantity", "ingredients", "allergens", "ins_additives"]
    assert got["ingredients"] == "Wheat Flour, Palm Oil, Salt, Acidity Regulator (INS 330), May contain Milk and Soy"
    assert got["allergens"] == "Wheat, Milk, Soy" and got["ins_additives"] == "INS 330"


def test_empty_label(spark):
    r = scan_labels(labels(spark, ("none", []))).first()
    assert (r.commodity_type, r.extracted_fields, r.overall_status) == ("general_commodity", [], "PASS")
    assert len(r.missing_mandatory_fields) == 5


def test_nested_parentheses(spark):
    text = "INGREDIENTS - x Flour (a, (b; c)), Rice. Sugar  Salt;12345; contains: Egg"
    r = extract_fields(labels(spark, ("n", [(text, 0.9, None)]))).first()
    assert r.extracted_fields[0].normalized_value == "x Flour (a, (b; c)), Rice, Sugar, Salt, Egg"


def test_response_and_report(spark):
    out = response(scan_labels(labels(spark, FOOD)), F.lit("SCAN_1")).first()
    assert out.extracted_data.net_quantity.raw == "70.0 g" and out.extracted_data.allergens == ["Wheat", "Milk", "Soy"]
    assert out.extracted_data.manufacturer is None and out.compliance.overall_status == "PASS"
    s = scan_labels(labels(spark, FOOD))
    rows = rp.declaration_rows({"mrp": F.lit("14.0"), "manufacturer": F.lit("x" * 50)}, F.col("missing_mandatory_fields"))
    audit = {x.field_name: (x.detected_value, x.audit_status) for x in s.select(F.explode(rows).alias("r")).select("r.*").collect()}
    assert audit["mrp"] == ("Rs. 14.0", "DECLARED (OK)") and audit["manufacturer"][0] == "x" * 45 + "..."
    assert audit["mfg_date"] == ("Missing / Not Legible", "NOT DECLARED [VIOLATION]")
    assert audit["consumer_care"][1] == "N/A / Voluntary"
    text = s.select(rp.text_report(F.lit("S"), F.lit("Food"), F.col("is_compliant"), rows, F.col("issues"))).first()[0]
    assert "Inspection Verdict : NON-COMPLIANT (ACTION REQUIRED)" in text and "[Item 2]" in text


def test_reading_order(spark):
    a, b, c = [0.0, 100.0, 100.0, 20.0], [200.0, 10.0, 100.0, 20.0], [0.0, 10.0, 100.0, 20.0]
    near = [140.0, 10.0, 100.0, 20.0]
    df = labels(spark, ("far", [("A", 0.9, a), ("B", 0.9, b), ("C", 0.9, c)]), ("edge", [("A", 0.9, a), ("B", 0.9, near), ("C", 0.9, c)]),
                ("one", [("A", 0.9, [10.0, 10.0, 100.0, 20.0])]))
    got = {r.image_id: [(x.text, x.layout_position, x.font_height_px) for x in r.blocks] for r in analyze_layout(df).collect()}
    assert [t for t, _, _ in got["far"]] == ["C", "A", "B"]
    assert [t for t, _, _ in got["edge"]] == ["C", "B", "A"]  # a gap of exactly 40 stays in the column
    assert got["one"] == [("A", "top", 20)]


def test_ordered_groups_match_plain_windows(spark):
    """One key holds most rows; ranks and columns equal a window over the whole group."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.8 else rng.randint(1, 5), rng.randint(0, 3000), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, x int, i int")
    got = {(r.k, r.i): (r.rank, r.col) for r in column_breaks(
        rank_in_order(df, ["k"], [F.col("x"), F.col("i")], "rank", 7), ["k"], F.col("x").cast("double"), F.lit(1.0),
        [F.col("i")], 2.0, "col", 5).collect()}
    for key in {k for k, _, _ in rows}:
        col, edge = 0, None
        for rank, (x, i) in enumerate(sorted((x, i) for k, x, i in rows if k == key), start=1):
            col += edge is not None and x - edge > 2
            edge = x + 1
            assert got[(key, i)] == (rank, col)


def test_confidence(spark):
    df = labels(spark, ("a", [("x", 0.95, None), ("y", 0.80, None)]), ("b", []), ("c", [("x", None, None), ("y", 0.5, None)]))
    got = {r.image_id: r for r in df.select("image_id", F.size(bl.keep_confident(F.col("blocks"), 0.9)).alias("n"),
                                            bl.mean_confidence(F.col("blocks")).alias("m")).collect()}
    assert (got["a"].n, got["a"].m) == (1, 0.875) and (got["b"].n, got["b"].m) == (0, 0.0)
    assert (got["c"].n, got["c"].m) == (1, 0.25)
    assert bl.explode_blocks(df).count() == 4


def test_panels(spark):
    panels = labels(spark, ("s1", [("Rs. 10", 0.9, None)]), ("s1", [("Rs. 20", 0.9, None), ("5 kg", 0.9, None)])).withColumn(
        "panel_ord", F.when(F.col("blocks")[0]["text"] == "Rs. 10", 2).otherwise(1)).withColumnRenamed("image_id", "scan_id")
    got = {r.field_name: (r.field.normalized_value, r.panel_ord) for r in merge_panels(extract_fields(panels)).collect()}
    assert got == {"mrp": ("20.0", 1), "net_quantity": ("5.0", 1)}


def test_contracts(spark):
    df = labels(spark, ("ok", [("t", 0.5, [0.0, 0.0, 1.0, 1.0])]), (None, [(None, 1.5, [0.0])]))
    got = [r[0] for r in df.select(ct.ocr_violations(F.col("image_id"), F.col("blocks"))).collect()]
    assert sorted(got) == [[], ["image_id", "text", "confidence", "bbox"]]
    e = extract_fields(labels(spark, FOOD))
    assert e.select(ct.extraction_violations(F.col("image_id"), F.col("commodity_type"), F.col("extracted_fields"))).first()[0] == []


def test_checks_and_routing(spark):
    f = spark.createDataFrame([("a", "mrp", "food"), ("a", "batch_number", "food"), ("b", "consumer care", "drugs_cosmetics"), ("b", "", "food")],
                              "pkg string, field_name string, commodity_type string")
    checks = checks_for_fields(f)
    got = {(r.pkg, r.field): (r.check_id, r.query_terms) for r in checks.collect()}
    assert got[("a", "batch_number")] == ("LM_BATCH_NUMBER_001", ["batch_number", "declaration", "pre-packaged commodity"])
    assert got[("a", "mrp")][0] == "LM_MRP_001" and got[("b", "consumer care")][0] == "LM_CARE_001" and len(got) == 3
    domains = sorted((r.pkg, r.field, r.routed_domain) for r in route(checks).collect())
    assert [d for p, n, d in domains if n == "mrp"] == ["fssai", "legal_metrology"]
    assert [d for p, n, d in domains if p == "b"] == ["legal_metrology"]
