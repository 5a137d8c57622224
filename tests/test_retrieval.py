"""Retrieval against brute force and the evaluation sets."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import all_cases
from labelwright.fixed.limits import INTENT_WEIGHTS
from labelwright.fixed.intents import intent_rows
from labelwright.functions.embed import codepoint_embedder, model_embedder, pair_scorer
from labelwright.operators import corpus as cp
from labelwright.operators import evidence as ed
from labelwright.operators.dense import dense_topk
from labelwright.operators.evaluate import acceptance, citation_accuracy, hit_rate, is_hit
from labelwright.operators.exact import exact_matches, ranked_exact
from labelwright.operators.fuse import fuse, fused_rank
from labelwright.operators.intent import normalize_intent
from labelwright.operators.lexical import bm25_topk, build_index
from labelwright.plans.benchmark import evaluate_cases, summary
from labelwright.plans.compliance import dispatch, food_corpus, food_evidence, metrology_evidence
from labelwright.plans.retrieval import query_text, retrieve, search, understand
from labelwright.operators.checks import rule_catalogue
from labelwright.types import EVAL_CASE

WORDS = "the of net price label rule pack unit élan größe wheat 12 mrp".split()


def hashed_model():
    """A small deterministic text model for tests."""
    def encode(texts):
        out = np.zeros((len(texts), 32))
        for row, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                out[row, sum(map(ord, w)) % 32] += 1.0
        return out
    return encode


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    docs = [(i, i, " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, 30))),
             "current" if i % 9 else "superseded") for i in range(120)]
    docs += [(200 + i, 200 + i, docs[3][2], "current") for i in range(6)]  # equal copies tie
    queries = [(f"q{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for i in range(15)] + [("none", "zzz"), ("empty", "")]
    return docs, queries


def brute_bm25(docs, queries, k):
    toks = {d: re.findall(r"\w+", t.lower()) for d, _, t, _ in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = {}
    for q, text in queries:
        scored = []
        for d, o, _, status in docs:
            tf = Counter(toks[d])
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(toks[d]) / mean))
                    for w in re.findall(r"\w+", text.lower()) if w in idf)
            if s > 0 and status == "current":
                scored.append((-round(s, 9), o, d))
        out[q] = [(d, r) for r, (_, _, d) in enumerate(sorted(scored)[:k], start=1)]
    return out


@pytest.mark.parametrize("hold,held", [("corpus", 10 ** 6), ("queries", 10 ** 6), ("queries", 8)])
def test_bm25_equals_brute_force(spark, texts, hold, held):
    docs, queries = texts
    corpus = spark.createDataFrame(docs, "chunk_id int, insert_ord int, text string, status string").repartition(5)
    q = spark.createDataFrame(queries, "query_id string, query string")
    found = bm25_topk(q, build_index(corpus, ["text"]), 7, hold=hold, held_weights=held).collect()
    want = brute_bm25(docs, queries, 7)
    for qid, _ in queries:
        assert sorted(((r.chunk_id, r["rank"]) for r in found if r.query_id == qid), key=lambda x: x[1]) == want[qid], qid


@pytest.mark.parametrize("held", [10 ** 6, 64, 20])
def test_dense_equals_brute_force(spark, held):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[10] = m[4]
    q = rng.normal(size=(5, 8)).astype(np.float32)
    corpus = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)] + [(99, 99, [1.0])],
                                   "chunk_id int, insert_ord int, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, query_vector array<float>")
    got = dense_topk(queries, corpus, 6, held_numbers=held).collect()
    unit = lambda a: a.astype(float) / np.linalg.norm(a.astype(float), axis=1, keepdims=True)
    sims = np.hstack([np.round(unit(q) @ unit(m).T, 9), np.zeros((5, 1))])
    ids = list(range(60)) + [99]
    for i in range(5):
        want = [ids[j] for j in sorted(range(61), key=lambda j: (-sims[i, j], ids[j]))[:6]]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == f"q{i}"), key=lambda r: r["rank"])] == want


def brute_intent(query):
    q = query.lower().strip()
    words, w = set(re.findall(r"\w+", q)), INTENT_WEIGHTS
    from labelwright.fixed.limits import CONTEXT_PHRASES
    context = next((c for c, ps in CONTEXT_PHRASES if any(p in q for p in ps)), "PACKAGE_LABEL")
    best, top = None, 0.0
    for e in intent_rows():
        share = lambda ts: sum(any(t.lower() in x for x in words) for t in set(ts)) / max(len(set(ts)), 1)
        s = (w["entity"] * share(e["entities"]) + w["attribute"] * share(e["attributes"])
             + w["alias"] * any(a in q or q in a for a in e["semantic_aliases"])
             + w["positive"] * any(p in q for p in e["positive_signals"]) + w["context"] * (e["context"] == context)
             - w["negative"] * any(p in q for p in e["negative_signals"]))
        if s > top and s >= 0.25:
            best, top = e["intent_id"], s
    return best, context, min(top, 1.0)


def test_intent_equals_brute_force(spark):
    queries = [c[2] for c in all_cases()] + ["x", "bulk imported goods", "country of origin", "net quantity", "care", "  MRP  "]
    df = normalize_intent(spark.createDataFrame([(q,) for q in queries], "query string"))
    for r in df.collect():
        want = brute_intent(r.query)
        assert (r.intent.intent_id, r.intent.detected_context) == want[:2], r.query
        assert r.intent.confidence == pytest.approx(want[2])
    empty = normalize_intent(spark.createDataFrame([("mrp",)], "query string"), catalogue=[]).first().intent
    assert (empty.intent_id, empty.detected_facets, empty.detected_context) == (None, [], "PACKAGE_LABEL")


def test_fusion_arithmetic(spark):
    def stream(*rows):
        return spark.createDataFrame([("q", *r) for r in rows], "query_id string, chunk_id string, rank int, score double")

    fused = fused_rank(fuse({
        "original_vector": stream(("all", 1, 0.9), ("ve", 2, 0.8)), "intent_vector": stream(("all", 1, 0.7), ("tie2", 2, 0.1)),
        "bm25": stream(("all", 1, 4.0), ("tie1", 2, 3.0)), "exact_provision": stream(("all", 1, 0.0), ("ve", 2, 0.0))}))
    got = {r.chunk_id: r for r in fused.collect()}
    assert got["all"].rrf_score == 1 / 61 + 1 / 61 + 1 / 61 + 2 / 61 and got["ve"].rrf_score == 1 / 62 + 2 / 62
    assert got["all"].retrieval_sources == ["original_vector", "intent_vector", "bm25", "exact_provision"]
    assert [got[c].fused_rank for c in ("all", "ve", "tie2", "tie1")] == [1, 2, 3, 4]
    assert got["tie2"].vector_score == 0.0 and got["all"].bm25_score == 4.0


def test_exact_matches(spark):
    q = understand(spark.createDataFrame([("a", "Rule 6(1)(e)"), ("b", "Rule 24(a)"), ("c", "no reference")], "query_id string, query string"))
    m = exact_matches(q, cp.provisions(spark))
    for spread in (False, True):
        ranked = {(r.query_id, r["rank"]): (r.chunk_id, r.priority) for r in ranked_exact(m, spread=spread).collect()}
        assert ranked[("a", 1)] == ("chk_lm_6_6(1)_6(1)(e)_12", 1) and ranked[("a", 2)][1] == 2
        assert ranked[("b", 1)] == ("chk_lm_24_24(a)_main_35", 2) and not any(k[0] == "c" for k in ranked)
        assert ranked[("a", 9)] == ("chk_lm_6_6(2)_main_13", 5)


def test_evaluation_set(spark):
    """References and schedules are always found first; questions reach at least the published rate."""
    cases = spark.createDataFrame(all_cases(), EVAL_CASE)
    overall, by_category = summary(evaluate_cases(cases, cp.provisions(spark)))
    got = {r.category: r for r in by_category.collect()}
    assert got["exact_provision"].total == 36 and got["exact_provision"].recall_1 == 100.0
    assert got["schedule_query"].recall_1 == 100.0
    assert got["natural_language"].recall_1 >= 65.38
    assert overall.first().false_top1_rate <= 11.67
    assert spark.range(1).select(acceptance(*[F.lit(x) for x in (100.0, 95.0, 100.0, 0.0)])).first()[0] == "FIXED"


def test_search_with_models(spark):
    corpus = cp.provisions(spark)
    embed = model_embedder(hashed_model)
    corpus = corpus.withColumn("embedding", embed(F.col("text")))
    q = spark.createDataFrame([("a", "What must be printed as MRP?"), ("b", "Rule 27"), ("c", "")], "query_id string, query string")
    score = pair_scorer(lambda: lambda pairs: [float("27" in text.split("PROVISION: ")[1][:12]) for _, text in pairs])
    found = search(q, corpus, embed, pair_score=score).collect()
    top = {r.query_id: r for r in found if r.final_rank == 1}
    assert top["a"].clause == "6(1)(e)" and top["b"].rule == "27" and "c" not in top
    assert top["b"].cross_encoder_score == 1.0 and top["a"].intent_rank is not None
    assert any(r.vector_rank is not None for r in found)
    assert max(r.final_rank for r in found) == 5
    assert all(r.status == "current" for r in found)


def test_query_text(spark):
    df = spark.createDataFrame([("raw", "q", ["t"]), ("", "q", ["t"]), (None, "", ["t", "u"]), (None, None, [])], "r string, q string, t array<string>")
    assert [x[0] for x in df.select(query_text(F.col("r"), F.col("q"), F.col("t"))).collect()] == ["raw", "q", "t u", ""]


# Checks of the small set and the reference each must reach.
SMALL_SET = [
    ("LM_MRP_001", "mrp", ["MRP", "maximum retail price", "inclusive of all taxes"], "Rule 6(1)(f)"),
    ("LM_NET_001", "net_quantity", ["Net Quantity", "net weight", "net volume"], "Rule 6(1)(d)"),
    ("LM_MFG_001", "manufacturer_details", ["manufacturer", "packer", "importer", "name and address"], "Rule 6(1)(a)"),
    ("LM_CARE_001", "consumer_care", ["consumer care", "helpline", "email address", "telephone"], "Rule 6(1)(g)"),
    ("LM_SIZE_001", "declaration_height", ["height of numeral", "font size mm", "Schedule II"], "Schedule II"),
]


def test_small_set_hit_rate(spark):
    checks = spark.createDataFrame([(c, c, f, t, e) for c, f, t, e in SMALL_SET],
                                   "query_id string, check_id string, field string, query_terms array<string>, expected string")
    found = metrology_evidence(checks, cp.starter_corpus(spark), "2024-01-01")
    judged = found.join(checks.select("query_id", "expected"), "query_id").withColumn(
        "is_hit", is_hit(F.col("expected"), F.col("rule"), F.col("text"), F.col("schedule")))
    assert hit_rate(judged).first().hit_rate >= 0.8
    assert citation_accuracy(found, F.col("citation.document"), F.col("citation.rule")).first().accuracy == 1.0


def test_dispatch(spark):
    checks = spark.createDataFrame(
        [("1", "LM_MRP_001", "mrp", "food", ["MRP"]), ("2", "LM_MRP_001", "mrp", "general_commodity", ["MRP"]), ("3", "Z", "zzz", "food", ["qqq"])],
        "query_id string, check_id string, field string, commodity_type string, query_terms array<string>")
    got = {(r.query_id, r.routed_domain): r for r in dispatch(
        checks, cp.provisions(spark), food_corpus(rule_catalogue(spark, "fssai")), "2024-01-01").collect()}
    assert set(got) == {("1", "legal_metrology"), ("1", "fssai"), ("2", "legal_metrology"), ("3", "legal_metrology"), ("3", "fssai")}
    assert got[("1", "legal_metrology")].rule == "6" and got[("3", "legal_metrology")].chunk_id == "chk_none"
    assert got[("1", "fssai")].document.startswith("FSSAI") and got[("1", "fssai")].score_in_range <= 1.0
    lone = food_evidence(checks.filter("query_id = '1'"), None).first()
    assert (lone.chunk_id, lone.retrieval_score, lone.relevant_rule) == ("chk_fssai_pkg_2018", 0.95, "FSSAI Regulation")


def test_evidence_defaults(spark):
    df = spark.createDataFrame([("", "q9", None, 0, 3.0)], "check_id string, query_id string, document_title string, page_start int, retrieval_score double")
    e = ed.evidence_items(df).first()
    assert (e.check_id, e.chunk_id, e.rule, e.page, e.retrieval_score, e.score_in_range) == ("q9", "chk_unk", "Rule 6", 1, 3.0, 1.0)


def test_codepoint_embedding(value_of):
    v = value_of(codepoint_embedder(4), ["aé₹😀", ""])
    assert v[0] == pytest.approx([sum(map(ord, "aé₹😀")) % 100 / 100] * 4) and v[1] == [0.0] * 4


def test_retrieve_provenance(spark):
    q = spark.createDataFrame([("a", "Rule 6(2) consumer complaints")], "query_id string, query string")
    rows = {r.chunk_id: r for r in retrieve(q, cp.provisions(spark)).collect()}
    top = rows["chk_lm_6_6(2)_main_13"]
    assert top.retrieval_sources == ["bm25", "exact_provision"] and top.exact_rank == 1
    assert "chk_lm_6_6(1)_6(1)(e)_12_superseded" not in rows
