"""Scan with evidence: labels keep their own answers, whatever their ids, and labels without declarations get none."""

from pyspark.sql import functions as F

from labelwright.operators.checks import rule_catalogue
from labelwright.operators.corpus import provisions
from labelwright.plans.compliance import food_corpus
from labelwright.plans.evidence_scan import asked_as, scan_with_evidence
from labelwright.plans.scan import response

LABEL = "image_id string, blocks array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>"


def label(*texts):
    return [(None, t, 0.9, [0.0, 50.0 * i, 300.0, 20.0]) for i, t in enumerate(texts)]


def test_answers_stay_with_their_label(spark):
    rows = [("a", label("MRP Rs. 20.00", "Net Wt 100 g")), ("a", label("Net Wt 5 kg", "FSSAI Lic No. 10012345678901")), (None, label("MRP Rs. 7.50")),
            ("none", label("words only")), ("empty", []), ("null", None)]
    scanned = scan_with_evidence(spark.createDataFrame(rows, LABEL), provisions(spark), food_corpus(rule_catalogue(spark, "fssai")), "2024-01-01").cache()
    got = scanned.select("image_id", "field_evidences", "evidences").collect()
    assert len(got) == len(rows)
    clauses = sorted((r.image_id or "", [(e.field_name, [v.clause for v in e.evidences]) for e in r.field_evidences]) for r in got)
    assert clauses[0] == ("", [("mrp", ["6(1)(e)"])])
    assert sorted(clauses[1][1] + clauses[2][1])[2:] == [("net_quantity", ["6(1)(c)"]), ("net_quantity", ["6(1)(c)", None])]
    assert all(e == [] for name, e in clauses if name in ("none", "empty", "null"))
    for r in got:
        assert r.evidences == [v for e in r.field_evidences for v in e.evidences]
        names = [e.field_name for e in r.field_evidences]
        assert len(names) == len(set(names))
    answer = response(scanned, F.col("image_id")).select("rag_payload.evidences")
    assert sorted(len(r[0]) for r in answer.collect()) == sorted(len(r.evidences) for r in got)


def test_lookup_names(value_of):
    words = {"net_quantity": "net quantity"}
    assert value_of(lambda c: asked_as(c, words), ["net_quantity", "mrp", None]) == ["net quantity", "mrp", None]
    assert value_of(asked_as, ["net_quantity"]) == ["net_quantity"]
