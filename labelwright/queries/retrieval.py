"""Registered queries: keyword, dense, exact and fused retrieval, reranking, evidence and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.config import RetrievalConfig
from labelwright.fixed import limits as lim
from labelwright.fixed import provisions as pv
from labelwright.fixed.intents import intent_rows
from labelwright.functions.citations import reference
from labelwright.operators import corpus as cp
from labelwright.operators import evaluate as ev
from labelwright.operators import evidence as ed
from labelwright.operators.checks import checks_for_fields, rule_catalogue
from labelwright.operators.dense import dense_topk
from labelwright.operators.exact import exact_matches, ranked_exact
from labelwright.operators.fuse import fuse, fused_rank
from labelwright.operators.index import matching
from labelwright.operators.intent import INTENT_RESULT, _entry, normalize_intent
from labelwright.operators import postings as ps
from labelwright.operators.lexical import bm25_topk, build_index, document_frequencies
from labelwright.operators.rerank import rerank
from labelwright.functions.text import tokens
from labelwright.plans.compliance import dispatch, food_corpus
from labelwright.plans.evidence_scan import scan_with_evidence
from labelwright.plans.retrieval import search
from labelwright.plans.scan import scan_labels
from labelwright.queries.labels import part_labels
from labelwright.queries.tables import case, new_folder, table, text
from labelwright.session import cut_lineage, dealt


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents", even=True).select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("insert_ord"), "text")


def _benchmark(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("insert_ord"), "embedding", "label")


def _centroids(spark, d) -> DataFrame:
    """Mean vector of each label: one row per (label, position) after the map-side sum."""
    long = table(spark, d, "embeddings").select("label", F.posexplode_outer("embedding").alias("at", "v"))
    means = long.groupBy("label", "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("p"))
    return packed.select(F.col("label").alias("query_id"), F.transform("p", lambda x: x["v"]).alias("query_vector"))


def token_document_frequency(spark, d):
    docs = table(spark, d, "documents", even=True).select(tokens(F.col("text")).alias("tokens"))
    freq = document_frequencies(docs).filter(F.col("token").isNotNull())
    return freq.select("token", F.col("n_docs"))


def _searched(spark, d) -> ps.Search:
    index = ps.write_postings(_documents(spark, d), new_folder(spark, "postings"), ["text"])
    return ps.search_postings(_benchmark(spark, d), index, 20)


def bm25_documents(spark, d):
    """Benchmark passages searched in the written index of the documents."""
    return _searched(spark, d).top.select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def bm25_blocks(spark, d):
    """Postings blocks each of these searches meets."""
    return _searched(spark, d).bounds.groupBy("query_id").agg(F.sum("n_blocks").alias("n_blocks"), F.count(F.lit(1)).alias("n_segments"))


def _changed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents; a batch that rewrites the labelled ones of good quality and adds the benchmark; the ids of toxic ones, which go."""
    labels = table(spark, d, "labels")
    docs = _documents(spark, d)
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    again = docs.join(good, "chunk_id", "left_semi").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" revised edition")))
    added = _benchmark(spark, d).select(
        (-1 - F.col("query_id")).alias("chunk_id"), (-1 - F.col("query_id")).alias("insert_ord"), F.col("query").alias("text"))
    return docs, again.unionByName(added), labels.filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))


def bm25_weights_kept(spark, d):
    """Token weights after an upsert and a deletion, from differences alone."""
    docs, batch, gone = _changed(spark, d)
    before, batch = ps.tokenised(docs, ["text"]), ps.tokenised(batch, ["text"])
    after_upsert = ps.merged(document_frequencies(before), ps.replaced(before, batch))
    store = before.join(batch, "chunk_id", "left_anti").unionByName(batch)
    statistics = ps.merged(after_upsert, ps.difference(left=store.join(gone, "chunk_id", "left_semi")))
    weights, n, mean = ps.weights_of(cut_lineage(statistics))
    return weights.select("token", F.round("idf", 6).alias("idf"), F.lit(n).cast("long").alias("n"), F.round(F.lit(mean), 6).alias("mean"))


def bm25_provisions(spark, d):
    """Conversation turns searched in the provisions; the corpus is held, the turns stream."""
    turns = _turns(spark, d)
    index = build_index(cp.provisions(spark))
    return bm25_topk(turns, index, 5).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def dense_topk_query(spark, d):
    return dense_topk(_centroids(spark, d), _vectors(spark, d), 20).select(
        "query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def dense_topk_streamed(spark, d):
    """The same search with the label vectors held and the corpus streaming past."""
    return dense_topk(_centroids(spark, d), _vectors(spark, d), 20, held_numbers=1000).select(
        "query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def dense_topk_filtered(spark, d):
    kept = matching(_vectors(spark, d), {"label": 3})
    return dense_topk(_centroids(spark, d), kept, 5).select(
        "query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def dense_topk_mixed(spark, d):
    """Odd labels and odd vectors are cut to half their length: only equal lengths compare."""
    def cut(df, key, vector):
        return df.withColumn(vector, F.when(F.col(key) % 2 == 1, F.slice(vector, 1, 32)).otherwise(F.col(vector)))

    return dense_topk(cut(_centroids(spark, d), "query_id", "query_vector"), cut(_vectors(spark, d), "chunk_id", "embedding"), 20).select(
        "query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def exact_provisions(spark, d):
    """References named by order lines, matched to part chunks; every match is ranked."""
    n = (F.col("l_quantity")).cast("int")
    words = case(
        F.col("l_linenumber") % 4, text("Rule ", n, "(", F.col("l_linenumber"), ")(a)"), text("rule ", n, "(b)"),
        text("Schedule ", F.col("l_linenumber")), text("rule ", n))
    # The same reference repeats over all lines, so each is looked up once.
    asked = table(spark, d, "lineitem").select(words.alias("query_id")).distinct().withColumn(
        "reference", reference(F.col("query_id")))
    key, size = F.col("p_partkey"), F.col("p_size")
    sub = F.when(key % 5 == 0, text(size, "(b)")).otherwise(text(size, "(", key % 6, ")"))
    chunks = table(spark, d, "part").select(
        key.alias("chunk_id"), key.alias("insert_ord"), size.cast("string").alias("rule"), sub.alias("sub_rule"),
        F.when(key % 7 == 0, text(sub, "(A)")).alias("clause"),
        F.when(key % 11 == 0, F.lit("iv")).alias("schedule"),
        F.when(key % 13 == 0, F.lit("superseded")).when(key % 2 == 0, F.lit("current")).alias("status"))
    found = ranked_exact(exact_matches(asked, chunks), spread=True)
    return found.select("query_id", "chunk_id", "priority", F.col("rank").cast("bigint").alias("rank"))


# Phrases added to conversation turns so that every part of the catalogue is asked for.
_PHRASES = [
    "", "What must be printed as MRP?", "advertisement font height", "wholesale package declarations",
    "Country of origin labeling for imported goods", "clear space surrounding net quantity",
    "multi-pack net quantity", "consumer care telephone number", "visibility through transparent wrapper",
    "Rule 24(a) bulk", "si units", "best before, e-mail and tare", "Schedule III commodities when packed",
]


def _turns(spark, d) -> DataFrame:
    n = (F.col("conv_id") * 7 + F.col("turn")) % len(_PHRASES)
    return table(spark, d, "conversations", even=True).select(
        text(F.col("conv_id"), "-", F.col("turn")).alias("query_id"),
        F.concat_ws(" ", case(n, *[F.lit(p) for p in _PHRASES]), F.col("text")).alias("query"))


def intent_normalise(spark, d):
    out = normalize_intent(_turns(spark, d)).select("query_id", "intent.*")
    blank = F.lit("")
    return out.select(
        "query_id", F.coalesce("intent_id", blank).alias("intent_id"), F.coalesce("matched_rule", blank).alias("matched_rule"),
        F.array_join("matched_concepts", "|").alias("concepts"),
        F.array_join(F.sort_array("detected_facets"), "|").alias("facets"), "detected_context",
        F.length("canonical_expansion").alias("expansion_length"), F.round("confidence", 6).alias("confidence"))


def _streams(spark, d) -> dict[str, DataFrame]:
    centroids = _centroids(spark, d).withColumnRenamed("query_id", "label")
    items = _benchmark(spark, d).withColumn("label", (F.col("query_id") % 10).cast("int"))
    queries = items.join(centroids, "label").select("query_id", "query_vector")
    vectors = _vectors(spark, d).join(_documents(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    index = build_index(_documents(spark, d), ["text"])
    return {
        "original_vector": dense_topk(queries, vectors, 20),
        "bm25": bm25_topk(_benchmark(spark, d), index, 20, hold="queries"),
    }


def hybrid_fusion(spark, d):
    fused = fused_rank(fuse(_streams(spark, d)))
    return fused.filter("fused_rank <= 10").select(
        "query_id", "chunk_id", "fused_rank", "vector_rank", "bm25_rank", F.round("rrf_score", 6).alias("rrf_score"),
        F.array_join("retrieval_sources", ",").alias("sources"))


# Chunk references and query readings used by the rerank query.
_REFS = [("6", "6(1)", "6(1)(c)"), ("7", "7(2)", None), ("8", "8(1)", None), ("9", "9(2)", None), ("11", "11(1)", None),
         ("13", "13(6)", None), ("24", "24(a)", None), ("31", "31(2)", None)]
_ASKED = [("Rule 6(1)(c)", "WHOLESALE_PACKAGE", ["font_size"], "Rule 6(1)(c)", 0.5),
          ("where is it placed", "PACKAGE_LABEL", ["spacing", "multipack"], "Rule 8(1)", 0.3),
          ("font size", "ADVERTISEMENT", ["font_size"], "Rule 31(2)", 1.0), ("Schedule III", "PACKAGE_LABEL", [], None, 0.0),
          ("rule 24(a)", "WHOLESALE_PACKAGE", ["wrapper_exclusion"], None, 0.0),
          ("clear view", "PACKAGE_LABEL", ["wrapper_visibility", "wrapper_exclusion", "font_size"], "Rule 9", 0.8)]


def rerank_composite(spark, d):
    key = F.col("p_partkey")
    at = F.substring("p_brand", 7, 3).cast("int") % len(_ASKED)
    none = F.lit(None).cast("string")
    words = F.array().cast("array<string>")

    def ref(i):
        return case(key % 8, *[F.lit(r[i]) if r[i] else none for r in _REFS])

    reading = F.struct(
        none.alias("intent_id"), none.alias("requirement_name"),
        case(at, *[F.lit(a[3]) if a[3] else none for a in _ASKED]).alias("matched_rule"), words.alias("matched_concepts"),
        none.alias("detected_object"),
        case(at, *[F.array(*[F.lit(f) for f in a[2]]).cast("array<string>") for a in _ASKED]).alias("detected_facets"),
        case(at, *[F.lit(a[1]) for a in _ASKED]).alias("detected_context"), F.lit("").alias("canonical_expansion"),
        case(at, *[F.lit(a[4]) for a in _ASKED]).alias("confidence")).cast(INTENT_RESULT)
    candidates = table(spark, d, "part").select(
        F.col("p_brand").alias("query_id"), key.alias("chunk_id"), ref(0).alias("rule"), ref(1).alias("sub_rule"),
        ref(2).alias("clause"), F.when(key % 3 == 0, F.lit("iii")).alias("schedule"),
        F.when(F.col("p_size") % 5 == 0, F.lit("Chapter on Wholesale Packages")).otherwise(F.lit("General")).alias("chapter"),
        (F.lit(1.0) / (F.lit(60) + F.col("p_size"))).alias("rrf_score"), (F.col("p_size") / F.lit(100.0)).alias("vector_score"),
        reference(case(at, *[F.lit(a[0]) for a in _ASKED])).alias("reference"), reading.alias("intent"))
    best = rerank(candidates, 5, order=[F.col("chunk_id")])
    return best.select(
        "query_id", "chunk_id", "final_rank", "meta_match_type", "hierarchy_boost", "intent_boost", "facet_boost",
        "context_boost", "contradiction_penalty", F.round("final_score", 5).alias("final_score"))


def evidence_citation(spark, d):
    key = F.col("p_partkey")
    hits = table(spark, d, "part").select(
        F.when(key % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("check_id"), key.cast("string").alias("query_id"),
        text("chk_", key).alias("chunk_id"),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.col("p_type")).alias("document_title"), F.col("p_size").cast("string").alias("rule"),
        (key % 5).cast("int").alias("page_start"), F.lit("t").alias("text"),
        F.when(key % 2 == 0, F.col("p_size") / F.lit(25.0) - 0.5).alias("retrieval_score"))
    e = ed.evidence_items(hits)
    return e.select("check_id", "chunk_id", "document", "rule", "page", F.round("retrieval_score", 6).alias("retrieval_score"),
                    F.round("score_in_range", 6).alias("score_in_range"), F.col("citation.document").alias("cited_document"),
                    F.col("citation.page").alias("cited_page"))


def citation_accuracy(spark, d):
    key = F.col("p_partkey")
    document = F.when(key % 4 == 0, F.lit("")).otherwise(F.col("p_type"))
    rule = F.when(key % 6 != 0, F.col("p_size").cast("string"))
    return ev.citation_accuracy(table(spark, d, "part"), document, rule).withColumn("accuracy", F.round("accuracy", 6))


def hit_rate(spark, d):
    key = F.col("p_partkey")
    hit = ev.is_hit(
        F.lit("Rule 7"), text("rule ", F.col("p_size")), F.when(key % 3 == 0, F.lit("see RULE 7 there")),
        F.when(key % 5 == 0, F.lit("x")))
    return ev.hit_rate(table(spark, d, "part").withColumn("is_hit", hit)).withColumn("hit_rate", F.round("hit_rate", 6))


def _cases(spark, d):
    """Neighbours of every label's mean vector; one of the same label with a positive first number is relevant."""
    near = dense_topk(_centroids(spark, d), _vectors(spark, d), 5)
    labels = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "label", (F.col("embedding")[0] > 0).alias("positive"))
    hits = near.join(labels, "chunk_id").groupBy("query_id").agg(
        F.min(F.when((F.col("label") == F.col("query_id")) & F.col("positive"), F.col("rank"))).alias("match_rank"))
    cases = hits.select(
        F.col("query_id").alias("id"), "match_rank", (F.col("query_id") == 7).alias("is_corpus_gap"),
        F.when(F.col("query_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("category"))
    return cases


def failure_classes(spark, d):
    """What became of every label's case, by category."""
    matched = _cases(spark, d).drop("is_corpus_gap", "category").withColumn(
        "category", case(F.col("id") % 3, F.lit("exact_provision"), F.lit("schedule_query"), F.lit("natural_language"))).withColumn(
        "top1", F.lit("Rule 6"))
    out = ev.diagnose(matched, matched.filter("id = 7").select("id"))
    return out.select("id", "category", "result", F.coalesce("failure_class", F.lit("")).alias("failure_class"), "top1")


def retrieval_metrics(spark, d):
    out = ev.retrieval_metrics(_cases(spark, d), ["category"])
    return out.select("category", "total", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr", "false_top1_rate")])


def corpus_gap(spark, d):
    key = F.col("n_nationkey")
    cases = table(spark, d, "nation").select(
        F.col("n_name").alias("id"), F.when(key % 4 == 0, F.array(F.lit("Rule 6"))).alias("expected_provisions"),
        case(key % 5, F.lit("building"), F.lit("Machinery"), F.lit("XII"), F.lit(""), F.lit("AUTOMOBILE PARTS")).alias("expected_schedule"))
    corpus = table(spark, d, "customer").select(F.col("c_mktsegment").alias("schedule"))
    return ev.corpus_gaps(cases, corpus)


def provision_search(spark, d):
    """Hybrid search of every conversation turn in the provisions, reranked."""
    found = search(_turns(spark, d), cp.provisions(spark), None, RetrievalConfig(rerank_k=3))
    return found.select("query_id", "chunk_id", "final_rank", "meta_match_type", F.round("final_score", 5).alias("final_score"))


def compliance_evidence(spark, d):
    """Labels scanned, their declarations mapped to checks, evidence found once per check and joined back."""
    scanned = scan_labels(part_labels(dealt(table(spark, d, "part"))))
    fields = scanned.select("p_partkey", "commodity_type", F.explode_outer("extracted_fields").alias("f")).select(
        "p_partkey", "commodity_type", F.col("f.field_name").alias("field")).filter("field is not null")
    checks = checks_for_fields(cut_lineage(fields)).withColumn("query_id", F.concat_ws("-", "p_partkey", "field", "check_id"))
    found = dispatch(checks, cp.provisions(spark), None, "2024-01-01")
    return found.groupBy("field", "routed_domain", "chunk_id", "rule").agg(F.count(F.lit(1)).alias("n_labels"))


def scan_evidence(spark, d):
    """Labels scanned with evidence from both domains: how often each declaration is answered by which chunk."""
    labels = part_labels(dealt(table(spark, d, "part")))
    food = food_corpus(rule_catalogue(spark, "fssai"))
    scanned = scan_with_evidence(labels, cp.provisions(spark), food, "2024-01-01")
    rows = scanned.select("commodity_type", F.posexplode("field_evidences").alias("field_ord", "e")).select(
        "commodity_type", "e.field_name", F.posexplode("e.evidences").alias("evidence_ord", "v"))
    return rows.groupBy("commodity_type", "field_name", "evidence_ord", "v.check_id", "v.chunk_id", "v.rule").agg(F.count(F.lit(1)).alias("n_labels"))


QUERIES = {
    "token_document_frequency": token_document_frequency,
    "bm25_documents": bm25_documents,
    "bm25_blocks": bm25_blocks,
    "bm25_weights_kept": bm25_weights_kept,
    "bm25_provisions": bm25_provisions,
    "dense_topk": dense_topk_query,
    "dense_topk_streamed": dense_topk_streamed,
    "dense_topk_filtered": dense_topk_filtered,
    "dense_topk_mixed": dense_topk_mixed,
    "exact_provisions": exact_provisions,
    "intent_normalise": intent_normalise,
    "hybrid_fusion": hybrid_fusion,
    "rerank_composite": rerank_composite,
    "evidence_citation": evidence_citation,
    "citation_accuracy": citation_accuracy,
    "hit_rate": hit_rate,
    "retrieval_metrics": retrieval_metrics,
    "failure_classes": failure_classes,
    "corpus_gap": corpus_gap,
    "provision_search": provision_search,
    "compliance_evidence": compliance_evidence,
    "scan_evidence": scan_evidence,
}

# ---------------------------------------------------------------- expected results in SQL


def _quote(s) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_CENTROID = """
  cen AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
  cn AS (SELECT label, i, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM cen),
  en0 AS (SELECT vec_id, label AS own, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
  en AS (SELECT vec_id, own, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM en0),
  sim AS (SELECT cn.label AS query_id, vec_id AS chunk_id, own, round(sum(cn.v * en.v), 9) AS score FROM cn JOIN en USING (i) GROUP BY 1, 2, 3)
"""


def _bm25(docs: str, queries: str, k: int) -> str:
    """BM25 over docs(chunk_id, ord, text, live) and queries(query_id, query)."""
    return f"""
      docs AS (SELECT chunk_id, ord, live, {_TOKENS.format('text')} AS toks FROM ({docs})),
      st AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM docs),
      tok AS (SELECT chunk_id, ord, live, len(toks) AS dl, unnest(toks) AS token FROM docs),
      tf AS (SELECT chunk_id, ord, live, dl, token, count(*) AS tf FROM tok GROUP BY ALL),
      df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
      raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
      fl AS (SELECT 0.25 * avg(idf) AS fl FROM raw),
      idf AS (SELECT token, CASE WHEN idf < 0 THEN fl ELSE idf END AS idf FROM raw, fl),
      q AS (SELECT query_id, unnest({_TOKENS.format('query')}) AS token FROM ({queries})),
      qt AS (SELECT query_id, token, count(*) AS qtf FROM q GROUP BY ALL),
      sc AS (SELECT query_id, chunk_id, ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score
             FROM qt JOIN idf USING (token) JOIN tf USING (token), st WHERE live GROUP BY 1, 2, 3),
      bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM sc WHERE score > 0
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) <= {k})
    """


_DOCS = "SELECT doc_id AS chunk_id, doc_id AS ord, text, true AS live FROM documents"
_ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _chapter(rule: str) -> str:
    return next((f"{n}: {t}" for n, t, a, b in pv.CHAPTERS if a <= int(rule) <= b), "General")


def _provision_docs() -> str:
    rows = []
    for i, (_, rule, sub, clause, sched, first, _, extra, body) in enumerate(pv.PROVISIONS):
        status = extra.get("status", "current")
        cid = f"chk_lm_{rule}_{sub or 'main'}_{clause or 'main'}_{first}" + ("_superseded" if status == "superseded" else "")
        words = " ".join([body, rule, sub or "None", clause or "None", _chapter(rule), sched or "None"])
        rows.append(f"({_quote(cid)}, {i}, {_quote(words)}, {str(status == 'current').lower()})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(chunk_id, ord, text, live)"


_TURNS = (f"SELECT conv_id || '-' || turn AS query_id, concat_ws(' ', [{', '.join(_quote(p) for p in _PHRASES)}]"
          f"[(conv_id * 7 + turn) % {len(_PHRASES)} + 1], text) AS query FROM conversations")


def _intent_sql() -> str:
    entries = [_entry(e) for e in intent_rows()]
    terms, meta, facets = [], [], []
    for i, e in enumerate(entries):
        for kind in ("entities", "attributes", "positive", "negative", "aliases"):
            terms += [f"({i}, '{kind}', {_quote(t)})" for t in e[kind]]
        meta.append(f"({i}, {_quote(e['intent_id'])}, {_quote(e['rule_target'])}, {_quote(e['context'])}, {e['n_entities']}, "
                    f"{e['n_attributes']}, {len(e['expansion'])})")
        facets += [f"({i}, {_quote(f)})" for f in e["facets"]]

    def anyof(words):
        return "(" + " OR ".join(f"contains(s, {_quote(w)})" for w in words) + ")"

    context = "CASE " + " ".join(f"WHEN {anyof(p)} THEN '{c}'" for c, p in lim.CONTEXT_PHRASES) + " ELSE 'PACKAGE_LABEL' END"
    own = " UNION ALL ".join(
        f"SELECT query_id, '{f}' AS facet FROM q WHERE {anyof(p)}" for fs, p in lim.FACET_PHRASES for f in fs)
    return rf"""
      WITH q0 AS ({_TURNS}),
      q AS (SELECT query_id, regexp_replace(lower(query), '^\s+|\s+$', '', 'g') AS s FROM q0),
      qc AS (SELECT query_id, s, {context} AS ctx FROM q),
      t AS (SELECT * FROM (VALUES {', '.join(terms)}) AS t(i, kind, term)),
      m AS (SELECT * FROM (VALUES {', '.join(meta)}) AS m(i, intent_id, rule, context, ne, na, elen)),
      h AS (SELECT query_id, i, kind, term FROM qc JOIN t ON contains(s, term) OR (kind = 'aliases' AND contains(term, s))),
      g AS (SELECT query_id, i, count(*) FILTER (kind = 'entities') AS e, count(*) FILTER (kind = 'attributes') AS a,
              count(*) FILTER (kind = 'aliases') > 0 AS al, count(*) FILTER (kind = 'positive') > 0 AS po, count(*) FILTER (kind = 'negative') > 0 AS ng
            FROM h GROUP BY 1, 2),
      s AS (SELECT qc.query_id, ctx, m.*, CAST(0.4 AS DOUBLE) * (coalesce(e, 0) / CAST(ne AS DOUBLE)) + CAST(0.2 AS DOUBLE) * (coalesce(a, 0) / CAST(na AS DOUBLE))
              + CASE WHEN al THEN CAST(0.6 AS DOUBLE) ELSE 0 END + CASE WHEN po THEN CAST(0.3 AS DOUBLE) ELSE 0 END
              + CASE WHEN context = ctx THEN CAST(0.2 AS DOUBLE) ELSE 0 END - CASE WHEN ng THEN CAST(0.4 AS DOUBLE) ELSE 0 END AS score
            FROM qc CROSS JOIN m LEFT JOIN g ON g.query_id = qc.query_id AND g.i = m.i),
      b AS (SELECT * FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) = 1),
      f AS (SELECT query_id, facet FROM b JOIN (VALUES {', '.join(facets)}) AS f(i, facet) USING (i) UNION SELECT query_id, facet FROM ({own})),
      fa AS (SELECT query_id, string_agg(facet, '|' ORDER BY facet) AS facets FROM f GROUP BY 1),
      c AS (SELECT query_id, string_agg(term, '|' ORDER BY term) AS concepts FROM
            (SELECT DISTINCT h.query_id, term FROM h JOIN b ON h.query_id = b.query_id AND h.i = b.i WHERE kind IN ('entities', 'attributes')) GROUP BY 1)
      SELECT qc.query_id, coalesce(intent_id, '') AS intent_id, coalesce(rule, '') AS matched_rule, coalesce(concepts, '') AS concepts,
        coalesce(facets, '') AS facets, qc.ctx AS detected_context, coalesce(elen, 0) AS expansion_length,
        round(least(coalesce(score, 0.0), 1.0), 6) AS confidence
      FROM qc LEFT JOIN b ON b.query_id = qc.query_id LEFT JOIN fa ON fa.query_id = qc.query_id LEFT JOIN c ON c.query_id = qc.query_id"""


def _pick(at: str, values) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in enumerate(values)) + " END"


_RERANK = f"""
  WITH p AS (SELECT p_brand AS query_id, p_partkey AS chunk_id, CAST(p_brand[7:] AS INT) % {len(_ASKED)} AS kk, p_size,
      {_pick('p_partkey % 8', [r[0] for r in _REFS])} AS rule, {_pick('p_partkey % 8', [r[1] for r in _REFS])} AS sub,
      {_pick('p_partkey % 8', [r[2] for r in _REFS])} AS clause, p_partkey % 3 = 0 AS in_schedule, p_size % 5 = 0 AS wholesale FROM part),
  s AS (SELECT *,
      CASE kk WHEN 0 THEN CASE WHEN clause = '6(1)(c)' THEN 15.0 WHEN rule = '6' THEN 5.0 ELSE 0.0 END
              WHEN 3 THEN CASE WHEN in_schedule THEN 15.0 ELSE -20.0 END
              WHEN 4 THEN CASE WHEN sub = '24(a)' THEN 5.0 ELSE 0.0 END ELSE 0.0 END AS hierarchy_boost,
      CASE WHEN kk = 0 AND clause = '6(1)(c)' THEN 2.5 WHEN kk = 2 AND sub = '31(2)' THEN 5.0 WHEN kk = 5 AND sub LIKE '9%' THEN 4.0 ELSE 0.0 END AS intent_boost,
      CASE WHEN kk = 1 AND sub = '8(1)' THEN 5.0 WHEN kk = 1 AND sub = '13(6)' THEN 5.0 WHEN kk = 2 AND sub = '31(2)' THEN 5.0
           WHEN kk = 4 AND sub = '11(1)' THEN 5.0 WHEN kk = 5 AND sub IN ('9(2)', '11(1)', '7(2)') THEN 5.0 ELSE 0.0 END AS facet_boost,
      CASE WHEN kk IN (0, 4) AND (rule = '24' OR wholesale) THEN 3.0 WHEN kk = 2 AND rule = '31' THEN 3.0 ELSE 0.0 END AS context_boost,
      CASE WHEN kk IN (0, 4) AND sub = '13(6)' AND NOT wholesale THEN -15.0 WHEN kk IN (1, 3, 5) AND rule = '31' THEN -15.0 ELSE 0.0 END
        + CASE WHEN kk = 1 AND clause = '6(1)(c)' THEN -3.0 WHEN kk = 1 AND sub = '11(1)' THEN -5.0 ELSE 0.0 END AS contradiction_penalty,
      CASE WHEN kk = 3 THEN CASE WHEN in_schedule THEN 'EXACT_SCHEDULE' ELSE 'SCHEDULE_MISMATCH' END
           WHEN kk = 0 AND clause = '6(1)(c)' THEN 'EXACT_CLAUSE' WHEN kk = 4 AND sub = '24(a)' THEN 'PARENT_RULE'
           WHEN kk = 2 AND sub = '31(2)' THEN 'INTENT_MATCH' WHEN kk = 5 AND sub LIKE '9%' THEN 'INTENT_MATCH' ELSE 'NO_MATCH' END AS meta_match_type
    FROM p),
  r AS (SELECT *, CAST(hierarchy_boost + intent_boost + facet_boost + context_boost + contradiction_penalty AS DOUBLE)
      + CAST(1.0 AS DOUBLE) / (60 + p_size) * 10 + p_size / CAST(100 AS DOUBLE) * 2 AS final_score FROM s)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS final_rank, meta_match_type,
    hierarchy_boost, intent_boost, facet_boost, context_boost, contradiction_penalty, round(final_score, 5) AS final_score
  FROM r QUALIFY final_rank <= 5
"""

_EXACT = """
  WITH a AS (SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'Rule ' || n || '(' || l_linenumber || ')(a)' WHEN 1 THEN 'rule ' || n || '(b)'
        WHEN 2 THEN 'Schedule ' || l_linenumber ELSE 'rule ' || n END AS query_id,
      CASE WHEN l_linenumber % 4 <> 2 THEN CAST(n AS VARCHAR) END AS rule,
      CASE l_linenumber % 4 WHEN 0 THEN n || '(' || l_linenumber || ')' WHEN 1 THEN n || '(b)' END AS sub,
      CASE l_linenumber % 4 WHEN 0 THEN n || '(' || l_linenumber || ')(a)' WHEN 1 THEN n || '(b)' END AS clause,
      CASE WHEN l_linenumber % 4 = 2 THEN ['i','ii','iii','iv','v','vi','vii'][l_linenumber] END AS sched
    FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS n FROM lineitem)),
  c AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS rule, CASE WHEN p_partkey % 5 = 0 THEN p_size || '(b)' ELSE p_size || '(' || (p_partkey % 6) || ')' END AS sub,
      CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN p_size || '(b)' ELSE p_size || '(' || (p_partkey % 6) || ')' END || '(a)' END AS clause,
      CASE WHEN p_partkey % 11 = 0 THEN 'iv' END AS sched FROM part WHERE p_partkey % 13 <> 0),
  m AS (SELECT query_id, p_partkey AS chunk_id, CASE WHEN a.clause = c.clause THEN 1 WHEN a.sub = c.sub THEN 2 WHEN a.sched = c.sched THEN 3
        WHEN a.rule = c.rule THEN 5 END AS priority FROM a JOIN c ON a.rule = c.rule OR a.sched = c.sched)
  SELECT query_id, chunk_id, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, chunk_id) AS rank FROM m
"""

_TOP = "SELECT query_id, chunk_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim {0} QUALIFY rank <= {1}"

ORACLE = {
    # The answers of the packaged corpora are stated; which label asks for which of them is computed.
    "scan_evidence": """
        WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 7 <> 0 THEN 'food' ELSE 'general_commodity' END AS commodity_type FROM part),
        a(field_name, lacking_every, check_id, chunk_id) AS (VALUES
          ('mrp', 2, 'LM_MRP_001', 'chk_lm_6_6(1)_6(1)(e)_12'), ('net_quantity', NULL, 'LM_NET_001', 'chk_lm_6_6(1)_6(1)(c)_11'),
          ('mfg_date', 5, 'LM_DATE_001', 'chk_lm_6_6(1)_6(1)(d)_11'), ('fssai_license', 7, 'LM_FSSAI_LICENSE_001', 'chk_lm_6_6(1)_6(1)(d)_11'),
          ('ingredients', 3, 'LM_INGREDIENTS_001', 'chk_lm_6_6(1)_6(1)(d)_11'), ('allergens', 3, 'LM_ALLERGENS_001', 'chk_lm_6_6(1)_6(1)(d)_11'),
          ('ins_additives', 3, 'LM_INS_ADDITIVES_001', 'chk_lm_6_6(1)_6(1)(d)_11')),
        f AS (SELECT * FROM l JOIN a ON lacking_every IS NULL OR k % lacking_every <> 0)
        SELECT commodity_type, field_name, 0 AS evidence_ord, check_id, chunk_id, '6' AS rule, count(*) AS n_labels FROM f GROUP BY ALL
        UNION ALL
        SELECT commodity_type, field_name, 1, check_id, 'chk_fssai_lic_01', 'FSSAI Labelling Regulation 2.2.1', count(*) FROM f
        WHERE commodity_type = 'food' GROUP BY ALL""",
    "token_document_frequency": rf"""
        SELECT token, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token""",
    "bm25_documents": f"WITH {_bm25(_DOCS, _ITEMS, 20)} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM bm",
    "bm25_blocks": rf"""
        WITH tok AS (SELECT DISTINCT doc_id // {ps.SEGMENT} AS segment, unnest({_TOKENS.format('text')}) AS token FROM documents),
        q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark)
        SELECT query_id, count(*) AS n_blocks, count(DISTINCT segment) AS n_segments FROM q JOIN tok USING (token) GROUP BY query_id""",
    "bm25_weights_kept": rf"""
        WITH docs AS (
          SELECT {_TOKENS.format("coalesce(text, '') || CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN ' revised edition' ELSE '' END")} AS toks
          FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
          UNION ALL SELECT {_TOKENS.format('text')} FROM benchmark),
        st AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM docs),
        df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS token FROM docs) GROUP BY token),
        raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
        fl AS (SELECT 0.25 * avg(idf) AS fl FROM raw)
        SELECT token, round(CASE WHEN idf < 0 THEN fl ELSE idf END, 6) AS idf, n, round(mean, 6) AS mean FROM raw, fl, st""",
    "bm25_provisions": f"WITH {_bm25(_provision_docs(), _TURNS, 5)} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM bm",
    "dense_topk": f"WITH {_CENTROID} {_TOP.format('', 20)}",
    "dense_topk_streamed": f"WITH {_CENTROID} {_TOP.format('', 20)}",
    "dense_topk_filtered": f"WITH {_CENTROID} {_TOP.format('WHERE own = 3', 5)}",
    "dense_topk_mixed": f"""
        WITH cen AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
        cn AS (SELECT label, i, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM cen WHERE label % 2 = 0 OR i <= 32),
        en0 AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 2 = 0 OR i <= 32),
        en AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM en0),
        sim AS (SELECT cn.label AS query_id, vec_id AS chunk_id, round(sum(CASE WHEN cn.label % 2 = vec_id % 2 THEN cn.v * en.v ELSE 0 END), 9) AS score
                FROM cn JOIN en USING (i) GROUP BY 1, 2)
        {_TOP.format('', 20)}""",
    "exact_provisions": _EXACT,
    "intent_normalise": _intent_sql(),
    "hybrid_fusion": f"""
        WITH {_CENTROID}, {_bm25(_DOCS, _ITEMS, 20)},
        dn AS (SELECT item_id AS query_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank
               FROM sim JOIN benchmark ON sim.query_id = item_id % 10 WHERE chunk_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 20),
        fu AS (SELECT coalesce(dn.query_id, bm.query_id) AS query_id, coalesce(dn.chunk_id, bm.chunk_id) AS chunk_id, dn.rank AS vector_rank, bm.rank AS bm25_rank,
               coalesce(CAST(1.0 AS DOUBLE) / (60 + dn.rank), 0.0) + coalesce(CAST(1.0 AS DOUBLE) / (60 + bm.rank), 0.0) AS s
               FROM dn FULL JOIN bm ON dn.query_id = bm.query_id AND dn.chunk_id = bm.chunk_id)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CASE WHEN vector_rank IS NULL THEN 1 ELSE 0 END, coalesce(vector_rank, bm25_rank)) AS fused_rank,
          vector_rank, bm25_rank, round(s, 6) AS rrf_score, concat_ws(',', CASE WHEN vector_rank IS NOT NULL THEN 'original_vector' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END) AS sources
        FROM fu QUALIFY fused_rank <= 10""",
    "rerank_composite": _RERANK,
    "evidence_citation": """
        WITH p AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 'Legal Metrology (Packaged Commodities) Rules, 2011' ELSE p_type END AS doc,
            CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE p_partkey % 5 END AS pg,
            CASE WHEN p_partkey % 2 = 0 THEN p_size / CAST(25.0 AS DOUBLE) - 0.5 ELSE 0.85 END AS sc FROM part)
        SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS check_id, 'chk_' || p_partkey AS chunk_id, doc AS document,
          CAST(p_size AS VARCHAR) AS rule, pg AS page, round(sc, 6) AS retrieval_score, round(greatest(0.0, least(1.0, sc)), 6) AS score_in_range,
          doc AS cited_document, pg AS cited_page FROM p""",
    "citation_accuracy": """
        SELECT count(*) AS total_items, count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 6 <> 0) AS valid_citations,
          round(count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 6 <> 0) / count(*), 6) AS accuracy FROM part""",
    "hit_rate": """
        SELECT count(*) AS total_test_cases, count(*) FILTER (CAST(p_size AS VARCHAR) LIKE '7%' OR p_partkey % 3 = 0) AS hits,
          round(count(*) FILTER (CAST(p_size AS VARCHAR) LIKE '7%' OR p_partkey % 3 = 0) / count(*), 6) AS hit_rate FROM part""",
    "failure_classes": f"""
        WITH {_CENTROID}, top AS (SELECT query_id, chunk_id, own, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim QUALIFY rank <= 5),
        c AS (SELECT query_id AS id, query_id = 7 AS gap, ['exact_provision', 'schedule_query', 'natural_language'][query_id % 3 + 1] AS category,
                min(CASE WHEN own = query_id AND chunk_id IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0) THEN rank END) AS r FROM top GROUP BY query_id),
        f AS (SELECT *, gap OR coalesce(r = 1, false) AS first FROM c)
        SELECT id, category, CASE WHEN first THEN 'PASS' WHEN r IS NOT NULL THEN 'PASS_R' || r ELSE 'FAIL' END AS result,
          CASE WHEN first THEN '' WHEN category = 'exact_provision' THEN 'EXACT_REFERENCE_ERROR' WHEN category = 'schedule_query' THEN 'SCHEDULE_MISMATCH_ERROR'
               ELSE 'SEMANTIC_CONFUSION' END AS failure_class, CASE WHEN gap THEN 'CORPUS_GAP' ELSE 'Rule 6' END AS top1 FROM f""",
    "retrieval_metrics": f"""
        WITH {_CENTROID}, top AS (SELECT query_id, chunk_id, own, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim QUALIFY rank <= 5),
        c AS (SELECT query_id, query_id = 7 AS gap, min(CASE WHEN own = query_id AND chunk_id IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0) THEN rank END) AS r FROM top GROUP BY query_id)
        SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) AS total,
          round(count(*) FILTER (gap OR r = 1) * 100.0 / count(*), 6) AS recall_1, round(count(*) FILTER (gap OR r <= 5) * 100.0 / count(*), 6) AS recall_5,
          round(sum(CASE WHEN gap THEN 1.0 ELSE coalesce(CAST(1.0 AS DOUBLE) / r, 0.0) END) / count(*), 6) AS mrr,
          round((count(*) - count(*) FILTER (gap OR r = 1)) * 100.0 / count(*), 6) AS false_top1_rate
        FROM c GROUP BY 1""",
    "corpus_gap": """
        WITH n AS (SELECT n_name AS id, n_nationkey % 4 = 0 AS has, ['building', 'Machinery', 'XII', '', 'AUTOMOBILE PARTS'][n_nationkey % 5 + 1] AS s FROM nation)
        SELECT id FROM n WHERE NOT has AND s <> '' AND lower(s) NOT IN (SELECT DISTINCT lower(c_mktsegment) FROM customer)""",
}
