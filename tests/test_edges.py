"""Cases that once lost rows or changed answers: null keys, mixed vector lengths, repeated ids, long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.operators import evaluate as ev
from labelwright.operators import index as ix
from labelwright.operators.dense import dense_topk
from labelwright.operators.extract import extract_fields
from labelwright.operators.in_order import column_breaks, rank_in_order
from labelwright.plans.compliance import dispatch, food_corpus
from labelwright.operators.corpus import provisions
from labelwright.types import BLOCK


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 9), (None, 50)], "k string, x int")
    ranks = {(r.k, r.x): r["rank"] for r in rank_in_order(df, ["k"], [F.col("x")], stretches=3).collect()}
    assert ranks == {(None, 1): 1, (None, 3): 2, (None, 50): 3, ("a", 2): 1, ("a", 9): 2}
    cols = {(r.k, r.x): r.column_id for r in column_breaks(df, ["k"], F.col("x").cast("double"), F.lit(1.0), [F.col("x")], 5.0, stretches=3).collect()}
    assert cols == {(None, 1): 0, (None, 3): 0, (None, 50): 1, ("a", 2): 0, ("a", 9): 1}


@pytest.mark.parametrize("held", [10**6, 40, 6, 1])
def test_dense_with_mixed_lengths(spark, held):
    rng = np.random.default_rng(7)
    vectors = [None, [], *(rng.normal(size=n).tolist() for n in (2, 3, 2, 3, 5, 2))]
    docs = [(f"d{i}", i, v) for i, v in enumerate(vectors)]
    queries = [(f"q{i}", v) for i, v in enumerate([[], None, *(rng.normal(size=n).tolist() for n in (2, 3, 4))])]
    corpus = spark.createDataFrame(docs, "chunk_id string, insert_ord int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, query_vector array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    got = {(r.query_id, r["rank"]): r.chunk_id for r in dense_topk(asked, corpus, 3, held_numbers=held).collect()}
    for q, v in queries:
        want = sorted(docs, key=lambda d: (-cosine(v, d[2]), d[1]))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [d[0] for d in want]
    assert dense_topk(asked.limit(0), corpus, 3, held_numbers=held).count() == 0
    assert dense_topk(asked, corpus.limit(0), 3, held_numbers=held).count() == 0


def test_upsert_is_total_and_gapless(spark):
    cols = "chunk_id string, text string, embedding array<float>"
    store = spark.createDataFrame([("a", "old", [1.0], 0)], f"{cols}, insert_ord long")
    first = spark.createDataFrame([(None, "p", [1.0], 5), ("b", "one", [1.0], 9), ("b", "two", [1.0], 9), ("c", "late", None, 10**13)], f"{cols}, batch_ord long")
    once = ix.upsert(store, first)
    assert sorted((r.chunk_id, r.insert_ord) for r in once.collect()) == [("2", 1), ("a", 0), ("b", 2), ("c", 3)]
    second = spark.createDataFrame([("a", "new", [2.0], 0), (None, "q", None, 1), ("d", "x", [1.0], 2)], f"{cols}, batch_ord long")
    twice = {r.chunk_id: (r.text, r.insert_ord) for r in ix.upsert(once, second).collect()}
    assert twice["a"] == ("new", 0) and twice["d"] == ("x", 4) and twice["6"] == ("q", 5) and len(twice) == 6


def test_ingredients_are_read_to_the_end(spark):
    items = ", ".join(f"Spice {chr(97 + i % 26)}{chr(97 + i // 26)} powder" for i in range(150))
    block = {"block_id": "b", "text": f"Ingredients: {items}, Milk solids (INS 330)", "confidence": 0.9, "bbox": [0.0, 0.0, 1.0, 1.0]}
    label = spark.createDataFrame([("x", [block])], f"image_id string, blocks array<{BLOCK}>")
    found = {f.field_name: f.normalized_value for f in extract_fields(label).first().extracted_fields}
    assert found["ingredients"].count(",") >= 150 and "Milk" in found["allergens"] and "330" in found["ins_additives"]


def test_rank_metrics_stop_at_five(spark):
    cases = spark.createDataFrame([(1, 9, False), (2, 2, False), (3, None, True)], "id int, match_rank int, is_corpus_gap boolean")
    assert ev.retrieval_metrics(cases).first().mrr == pytest.approx((0 + 0.5 + 1) / 3)
    matched = spark.createDataFrame([(1, None, "Rule 6", "exact_provision"), (2, 1, "Rule 7", "x")], "id int, match_rank int, top1 string, category string")
    gaps = spark.createDataFrame([(1,)], "id int")
    assert {r.id: r.top1 for r in ev.diagnose(matched, gaps).collect()} == {1: "CORPUS_GAP", 2: "Rule 7"}


def test_checks_that_differ_in_a_null_have_their_own_evidence(spark):
    rows = [("1", None, "mrp", "food", ["price"], "10"), ("2", "mrp", None, "food", ["price"], "10"), ("3", None, "mrp", "food", ["price"], "99")]
    checks = spark.createDataFrame(rows, "query_id string, check_id string, field string, commodity_type string, query_terms array<string>, field_value string")
    texts = [("F1", "Price", "The mrp shall be shown"), ("F2", "Date", "Show a date"), ("F3", "Name", "Show a name"), ("F4", "Maker", "Show a maker")]
    rules = spark.createDataFrame([(a, i, str(i), b, c) for i, (a, b, c) in enumerate(texts)], "rule_id string, catalogue_ord int, rule_number string, rule_name string, description string")
    out = dispatch(checks, provisions(spark), food_corpus(rules), "2024-01-01").collect()
    assert len(out) == 6 and {r.query_id for r in out} == {"1", "2", "3"}
    assert {r.chunk_id for r in out if r.routed_domain == "fssai" and r.query_id != "2"} == {"chk_f1"}
