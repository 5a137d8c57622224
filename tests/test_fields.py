"""Declarations, measures and text expressions against worked examples."""

import pytest
from pyspark.sql import functions as F

from labelwright.functions import fields as fl
from labelwright.functions import measures as ms
from labelwright.functions import text as tx
from labelwright.operators.decide import judge_fields, package_status

D = fl.DECLARATIONS


@pytest.mark.parametrize("name,cases", [
    ("mrp", [("MRP ₹1,299.00", "1.29"), ("Rs. 45", "45.0"), ("M.R.P. : 120.50/-", "120.5"), ("price 45", None),
             ("Maximum Retail Price 12,50", "12.5"), ("mrp 12000000.5", "12000000.5"), ("", None)]),
    ("net_quantity", [("Net Wt 250 gms", "250.0"), ("1 litre", None), ("NET 1 litre", "1.0"), ("500 ml NET", "500.0"),
                      ("contains 5kg", "5.0"), ("net qty 3 pcs", "3.0"), ("x12 g", None)]),
    ("mfg_date", [("Mfg Date: 05/2026", None), ("PKD 12/05/2026", "12/05/2026"), ("MFD Jan 2024", "Jan 2024"),
                  ("packed 3 March 2024", "3 March 2024")]),
    ("expiry_date", [("Best before 6 months", "6 months"), ("EXP 01-02-27", "01-02-27"), ("use it", None)]),
    ("fssai_license", [("FSSAI Lic. No. 10012011000168", "10012011000168"), ("20012011000168", "20012011000168"),
                       ("30012011000168", None), ("1001201100016", None)]),
    ("batch_number", [("Batch: LT-9/A", "LT-9/A"), ("Lotion 100 ml", "ion"), ("B.No. X1", "X1"), ("Batch No: B1", "No")]),
])
def test_declarations(value_of, name, cases):
    got = value_of(lambda x: D[name].value(D[name].match(x)), [c for c, _ in cases])
    assert got == [w for _, w in cases]


def test_units(value_of):
    got = value_of(lambda x: D["net_quantity"].unit(D["net_quantity"].match(x)),
                   ["Net 1 gm", "Net 1 litres", "5 ltr", "Net 2 Units", "none"])
    assert got == ["g", "l", "l", "units", None]


def test_contacts(value_of):
    texts = ["write to a.b@c-d.co.in now", "Toll Free: 1800-123-4567", "call 9876543210", "nothing"]
    assert value_of(fl.email_of, texts) == ["a.b@c-d.co.in", None, None, None]
    assert value_of(fl.phone_of, texts) == [None, "1800-123-4567", "9876543210", None]


def test_number_text(value_of):
    values = [120.0, 0.0, 1e7, 12345678.25, 1e15, 1e16, 2.5e20, 0.0005, 0.00001]
    assert value_of(tx.python_float_text, values, "double") == [str(v) for v in values]


def test_additives_and_allergens(value_of):
    assert value_of(fl.additive_codes, ["INS 330, E471 (170(i)) INS 330", "the 1200", "none"]) == [
        ["INS 330", "INS 471", "INS 170(i)"], ["INS 1200"], []]
    assert value_of(fl.allergens_in, ["Contains tree nuts, SOY and milkshake"]) == [["Soy", "Tree nuts"]]


def test_commodity(value_of):
    texts = ["FSSAI Lic No. 12345 Nutritional Info", "Plastic Bucket 10L", "shampoo with oil", "lotion, dose of fat", None, ""]
    assert value_of(fl.commodity_of_text, texts) == [
        "food", "general_commodity", "food", "drugs_cosmetics", "general_commodity", "general_commodity"]


def test_literal_stems_are_in_their_patterns():
    from labelwright.fixed import label_patterns as lp
    for p in lp.FOOD_WORDS + lp.DRUG_COSMETIC_WORDS:
        assert fl.literal_stem(p) and fl.literal_stem(p) in p


def test_stem_guards_lose_nothing(spark):
    """The guarded match equals the plain first match of the patterns."""
    import random

    from labelwright.fixed import label_patterns as lp
    from labelwright.functions.text import rx

    rng = random.Random(7)
    bits = ["MRP", "m.R.p.", "Rs", "₹", "12", "1,5", " ", ".", "NET", "wt", "kg", "Lot", "B.", "No", "EXP", "use by", "Mfg",
            "MaX Retail Price", "05/06/2026", "Jan", "10012011000168", "lic", "é", "ſ", "ı", "PKD", "pacKed", "\n", "call", "@x.y", "a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {
        "mrp": lp.MRP, "net_quantity": lp.NET_QUANTITY, "fssai_license": lp.FSSAI_LICENSE, "batch_number": lp.BATCH_NUMBER,
        "mfg_date": lp.MFG_DATE, "expiry_date": lp.EXPIRY_DATE}
    for name, patterns in plain.items():
        want = F.coalesce(*[F.regexp_substr("t", F.lit(rx(p))) for p in patterns])
        bad = df.filter(~want.eqNullSafe(D[name].match(F.col("t"))["raw"])).collect()
        assert not bad, (name, bad[:3])


def test_numeral_height(spark):
    rows = [(150.0, "ml", 35, 1000, "PASS", 2.0, 3.5, 5.3), (500.0, "g", 10, 1000, "FAIL", 4.0, 1.0, 1.5), (50.0, "g", 20, 0, "PASS", 1.0, 2000.0, 3000.0),
            (50.1, "g", 9, 1000, "FAIL", 2.0, 0.9, 1.3), (1.0, "KG ", 30, 1000, "PASS", 4.0, 3.0, 4.5), (1.1, "l", 30, 1000, "FAIL", 6.0, 3.0, 4.5)]
    df = spark.createDataFrame([r[:4] for r in rows], "q double, u string, n int, p int")
    got = df.select(ms.numeral_height(F.col("q"), F.col("u"), F.col("n"), F.col("p")).alias("h")).select("h.*").collect()
    assert [(g.status, g.required_min_mm, g.font_ratio_pdp_pct, g.est_height_mm) for g in got] == [r[4:] for r in rows]


def test_zones(value_of):
    assert value_of(ms.zone, [0.0, 249.0, 250.0, 800.0, 801.0], "double") == ["top", "top", "middle", "middle", "bottom"]


def test_boxes(value_of):
    polys = [[[10, 20], [60, 20], [60, 45], [10, 44]], [], None]
    assert value_of(ms.bounding_box, polys, "array<array<int>>") == [[10, 20, 51, 26], [0, 0, 50, 20], [0, 0, 50, 20]]


def test_flags_and_urls(value_of):
    assert value_of(ms.switched_on, ["TRUE", "1", "Yes", "no", ""]) == [True, True, True, False, False]
    assert value_of(ms.url_with_scheme, [" cam:80 ", "rtsp://x", "  "]) == ["http://cam:80", "rtsp://x", ""]


def test_verdicts(spark):
    rows = [("p1", "mrp", "1", 0.95), ("p1", "net", "1", 0.70), ("p2", "mrp", "1", 0.69), ("p2", "net", "1", 0.9), ("p3", "mrp", "1", 0.50),
            ("p3", "net", "1", 0.49), ("p4", "mrp", "", 0.9), ("p4", "net", "1", 0.9)]
    f = spark.createDataFrame([(a, b, c, "", d) for a, b, c, d in rows],
                              "pkg string, field_name string, normalized_value string, raw_text string, confidence double")
    judged = judge_fields(f, F.lit("Rule 6"))
    assert [r.status for r in judged.orderBy("pkg", "field_name").collect()] == [
        "PASS", "PASS", "UNCERTAIN", "PASS", "UNCERTAIN", "FAIL", "FAIL", "PASS"]
    packages = spark.createDataFrame([(p,) for p in ("p1", "p2", "p3", "p4", "p5")], "pkg string")
    got = {r.pkg: r.overall_status for r in package_status(judged, ["pkg"], packages).collect()}
    assert got == {"p1": "PASS", "p2": "UNCERTAIN", "p3": "FAIL", "p4": "FAIL", "p5": "PASS"}
