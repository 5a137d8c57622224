"""Pages, provisions, catalogue validation and the index."""

import pytest
from pyspark.sql import functions as F

from cases import TARGETS
from labelwright.fixed.provisions import GROUPS, PROVISIONS
from labelwright.functions.citations import canonical_schedule, provision_name, reference
from labelwright.operators import corpus as cp
from labelwright.operators import index as ix
from labelwright.operators.checks import add_rule, check_by_id, check_catalogue, rule_catalogue, validate_catalogue
from labelwright.plans.corpus_build import build_corpus, validate


@pytest.mark.parametrize("query,want", [
    ("Rule 6(1)(e)", ("6", "6(1)", "6(1)(e)", None, None)), ("Rule 7(2)", ("7", "7(2)", None, None, None)),
    ("Rule 24(a)", ("24", "24(a)", "24(a)", None, None)), ("Rule 27", ("27", None, None, None, None)),
    ("Third Schedule provisions", (None, None, None, None, "III")), ("Schedule 2 sizes", (None, None, None, None, "II")),
    ("Schedule 8", (None, None, None, None, "8")), ("section 18(1)", (None, None, None, "18(1)", None)),
    ("24(a) alone", (None,) * 5), ("24 (a)x", ("24", "24(a)", "24(a)", None, None)), ("", (None,) * 5), (None, (None,) * 5),
    ("RULE  6 ( 1 ) and section 4", ("6", "6(1)", None, "4", None)),
])
def test_references(value_of, query, want):
    r = value_of(reference, [query])[0]
    assert (r.rule, r.sub_rule, r.clause, r.section, r.schedule) == want
    assert r.explicit_provision == any(want)


def test_names(value_of, spark):
    assert value_of(canonical_schedule, ["Third Schedule", "Schedule III", "iii", "Schedule 9", "", None]) == [
        "III", "III", "III", "9", None, None]
    row = spark.range(1).select(
        provision_name(F.lit("6"), F.lit("6(1)"), F.lit(""), F.lit(None).cast("string")),
        provision_name(*[F.lit(None).cast("string")] * 3, F.lit("II")),
        provision_name(*[F.lit(None).cast("string")] * 4, "Unknown Provision")).first()
    assert tuple(row) == ("Rule 6(1)", "Schedule II", "Unknown Provision")


def test_page_numbers(spark):
    rows = [("a\n 12 ", 9), ("7\nx", 9), ("x\ny", 1), ("x", 6), ("", 4)]
    df = spark.createDataFrame(rows, "t string, i int").withColumn("l", cp.page_lines(F.col("t")))
    assert [r[0] for r in df.select(cp.printed_page(F.col("l"), F.col("i"))).collect()] == [12, 7, 1, 5, 3]


def test_pages_and_notes(spark):
    docs = spark.createDataFrame([("d", "Rule 7. x---PAGE_BREAK---  \n---PAGE_BREAK---*Substituted vide GSR 629(E) dated 7, w.e.f. 01.01.2018\nclause omitted")],
                                 "document_id string, text string")
    pages = cp.split_pages(docs).orderBy("page_number")
    assert [r.text for r in pages.collect()][1] == "[OCR Fallback Extracted Text for Page 2]"
    read = cp.read_pages(pages, "text", "page_number").orderBy("page_number").collect()[2]
    note = read.annotations[0]
    assert (note.action, note.gsr_number, note.date, note.effective_from) == ("Substituted", "GSR 629(E)", "7", "01.01.2018")
    assert read.omitted_passages == ["clause omitted"]
    assert [r.rule for r in cp.page_structure(pages).orderBy("page_start").collect()] == ["Rule 7", "Rule 6", "Rule 6"]


def _book(spark):
    """One page per provision, printed on its own page, holding its trigger words."""
    rows = []
    for i, e in enumerate(PROVISIONS):
        words = (e[7].get("words") or [""])[0]
        rows.append((i + 1, f"{GROUPS[e[0]][0][0]} {words}\n{e[5]}"))
    return spark.createDataFrame(rows, "pdf_page_index int, page_text string")


def test_corpus_from_pages(spark):
    chunks = build_corpus(_book(spark))
    ids = {r.chunk_id for r in chunks.collect()}
    assert ids == {r.chunk_id for r in cp.provisions(spark).collect()} and len(ids) == 38
    assert len(chunks.columns) == 22 and chunks.filter("amended_by is null").count() == 0


def test_page_without_triggers_brings_nothing(spark):
    pages = spark.createDataFrame([(1, "plain text\n99")], "pdf_page_index int, page_text string")
    assert build_corpus(pages).count() == 0
    seventeen = spark.createDataFrame([(1, "plain\n17")], "pdf_page_index int, page_text string")
    assert {r.chunk_id for r in build_corpus(seventeen).collect()} == {"chk_lm_7_7(1)_main_17", "chk_lm_7_7(2)_main_17"}


def test_catalogue_validation(spark):
    targets = spark.createDataFrame([t[:6] for t in TARGETS],
                                    "check_id string, requirement_name string, rule string, sub_rule string, clause string, page int")
    details, summary, lines = validate(cp.provisions(spark), targets)
    got = {r.check_id: (r.status, r.matched_chunk_id) for r in details.collect()}
    assert got == {t[0]: ("MATCHED", t[6]) for t in TARGETS}
    assert summary.first().pass_rate == 1.0
    assert lines.filter(F.col("line").startswith("| `LM_MRP_001` | **MATCHED** | `Rule 6, Sub 6(1), Clause 6(1)(e), Pg 12`")).count() == 1
    missing = spark.createDataFrame([("X", "n", "99", None, None, 1)], targets.schema)
    assert validate_catalogue(missing, cp.provisions(spark)).first().status == "NOT_FOUND"


def test_catalogues(spark):
    ids = spark.createDataFrame([("LM_NET_001",), ("nope",)], "check_id string")
    got = {r.check_id: r.requirement_name for r in check_by_id(ids, check_catalogue(spark)).collect()}
    assert got == {"LM_NET_001": "Net Quantity declaration", "nope": None}
    more = add_rule(rule_catalogue(spark), "R9", "n", "Rule 9", False, "d", ["k"])
    assert more.count() == 8 and more.filter("rule_id = 'R9'").first().catalogue_ord == 7


def test_validity(spark):
    rows = [("a", "current", "2011-01-01", None), ("b", "superseded", "1990-01-01", None), ("c", None, "2024-01-01", "2024-01-01"),
            ("d", "current", "2024-01-02", None), ("e", "current", None, "2023-12-31")]
    df = spark.createDataFrame(rows, "id string, status string, effective_from string, effective_to string")
    assert {r.id for r in ix.in_force(df, "2024-01-01").collect()} == {"a", "c"}
    assert {r.id for r in ix.with_status(df).collect()} == {"a", "d", "e"}
    assert {r.id for r in ix.matching(df, {"effective_to": None, "x": None}).collect()} == {"a", "b", "d"}


def test_upsert(spark):
    cols = "chunk_id string, text string, embedding array<float>"
    store = spark.createDataFrame([("a", "old", [1.0], 0), ("b", "old", [1.0], 1)], f"{cols}, insert_ord long")
    batch = spark.createDataFrame([("a", "new", [2.0], 0), (None, "auto", None, 1), ("c", "x", [3.0], 2), ("c", "y", [4.0], 3)], f"{cols}, batch_ord long")
    out = ix.upsert(store, batch).orderBy("insert_ord").collect()
    assert [(r.chunk_id, r.text) for r in out] == [("a", "new"), ("b", "old"), ("c", "y"), ("4", "auto")]
    assert {r.chunk_id for r in ix.delete(store, store.filter("chunk_id = 'a'")).collect()} == {"b"}


def test_hierarchy(spark):
    tree = {(r.chapter[:11], r.rule): [e.chunk_id for e in r.entries] for r in cp.hierarchy_tree(cp.provisions(spark)).collect()}
    assert [c[:12] for c in tree[("Chapter III", "24")]] == ["chk_lm_24_24"] * 3
    split = cp.hierarchy_tree(cp.provisions(spark), leaf_rows=2).filter("rule = '6'")
    assert split.agg(F.max(F.size("entries"))).first()[0] == 2


def test_starter_corpus(spark):
    rows = cp.starter_corpus(spark).orderBy("insert_ord").collect()
    assert [r.chunk_id for r in rows] == [f"chk_legal_metrology_00{i}" for i in range(1, 6)]
    assert rows[0].rule == "Rule 6" and rows[4].schedule == "Schedule II"
