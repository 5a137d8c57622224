"""Report lines, query builders, contracts and catalogue files not covered elsewhere."""

import json

from pyspark.sql import functions as F

from cases import all_cases
from labelwright.functions.measures import numeral_height
from labelwright.operators import contracts as ct
from labelwright.operators import evidence as ed
from labelwright.operators import report as rp
from labelwright.operators.checks import structured_query
from labelwright.operators.corpus import provisions
from labelwright.operators.evaluate import main_acceptance
from labelwright.sources import catalogues as files


def test_report_lines(spark):
    h = numeral_height(F.lit(500.0), F.lit("g"), F.lit(10), F.lit(1000))
    row = spark.range(1).select(
        rp.height_finding(h), rp.verdict_text(F.lit(False), F.array(F.lit(1), F.lit(2))), rp.verdict_text(F.lit(True), F.array())).first()
    assert tuple(row) == ("SUB-STANDARD DEFICIT (1.5 mm < 4.0 mm Statutory Min)",
                          "NON-COMPLIANT — ACTION REQUIRED (2 VIOLATIONS)", "PASS — COMPLIANT (CLEARED FOR RETAIL)")


def test_query_builder_and_contracts(spark):
    none = F.lit(None).cast("string")
    q = structured_query(F.lit("C1"), F.lit("mrp"), F.array().cast("array<string>"))
    row = spark.range(1).select(q.alias("q"), ct.check_violations(q).alias("v"), ct.status_allowed(F.lit("PASS")).alias("s")).first()
    assert row.q.query_terms == ["mrp", "pre-packaged commodity", "declaration"] and row.q.check_type == "presence"
    assert row.v == [] and row.s
    e = F.struct(*[F.lit("x").alias(k) for k in ("check_id", "chunk_id", "document", "rule", "text")], F.lit(3.0).alias("retrieval_score"),
                 F.struct(F.lit("d").alias("document"), none.alias("rule")).alias("citation"))
    assert spark.range(1).select(ct.evidence_violations(e)).first()[0] == ["score_range", "citation.rule"]


def test_first_generation(spark):
    hits = spark.createDataFrame([("Rule 6", 1.7)], "rule string, score double")
    got = ed.first_generation_evidence(hits, "doc").first()
    assert got.confidence == 1.0 and got.citation.page == 12


def test_acceptance(spark):
    values = spark.range(1).select(*[main_acceptance(F.lit(a), F.lit(b)) for a, b in ((95.0, 90.0), (95.0, 50.0), (10.0, 100.0))]).first()
    assert tuple(values) == ("FIXED", "PARTIALLY FIXED", "NOT FIXED")


def test_files(spark, tmp_path):
    rows = [dict(zip(("id", "category", "query", "expected_provisions", "expected_schedule"), c)) for c in all_cases()]
    (tmp_path / "cases.json").write_text(json.dumps(rows))
    assert files.read_eval_cases(spark, str(tmp_path / "cases.json")).count() == len(rows)
    check = {"check_id": "C", "domain": "d", "query_terms": ["a"], "legal_sources": [{"document": "D", "rule": "1", "page": 3}]}
    (tmp_path / "checks.json").write_text(json.dumps({"checks": [check]}))
    assert files.read_checks(spark, str(tmp_path / "checks.json")).first().legal_sources[0].page == 3
    (tmp_path / "intents.json").write_text(json.dumps([{"intent_id": "i", "entities": ["x"], "facets": []}]))
    assert files.read_intents(spark, str(tmp_path / "intents.json"))[0]["entities"] == ["x"]
    (tmp_path / "chunks.json").write_text(json.dumps([r.asDict() for r in provisions(spark).drop("insert_ord").collect()]))
    assert files.read_chunks(spark, str(tmp_path / "chunks.json")).agg(F.max("insert_ord")).first()[0] == 37


def test_chunk_corpus_as_lines_and_table(spark, tmp_path):
    chunks = provisions(spark)
    files.write_json(chunks, str(tmp_path / "lines"))
    files.write_chunks(chunks, str(tmp_path / "table"))
    want = {(r.chunk_id, r.insert_ord) for r in chunks.collect()}
    for read, name in ((files.read_chunk_lines, "lines"), (files.read_chunk_table, "table")):
        assert {(r.chunk_id, r.insert_ord) for r in read(spark, str(tmp_path / name)).collect()} == want
