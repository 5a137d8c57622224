"""Evidence for compliance checks, per domain, and the routed whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.config import RetrievalConfig
from labelwright.fixed.limits import DOMAIN_RERANK_TOP_K
from labelwright.functions.embed import Embedder
from labelwright.operators.checks import route
from labelwright.operators.evidence import domain_evidence, evidence_items, first_evidence
from labelwright.operators.fuse import fused_rank
from labelwright.operators.index import in_force
from labelwright.operators.rerank import rerank
from labelwright.plans.retrieval import retrieve, understand
from labelwright.session import cut_lineage, small_side

EVIDENCE = [
    "check_id", "chunk_id", "document", "rule", "sub_rule", "clause", "schedule", "page", "text",
    "retrieval_score", "score_in_range", "citation",
]


def metrology_evidence(
    checks: DataFrame, corpus: DataFrame, as_of: str, embed: Embedder | None = None,
    config: RetrievalConfig = RetrievalConfig(rerank_k=DOMAIN_RERANK_TOP_K),
) -> DataFrame:
    """Best evidence of each check: retrieve by field and terms, keep provisions in force, rerank by terms."""
    terms = F.when(F.size("query_terms") > 0, F.col("query_terms")).otherwise(F.array("field"))
    asked = checks.select(
        "query_id", "check_id", F.concat(F.coalesce("field", F.lit("")), F.lit(" "), F.array_join(terms, " ")).alias("query"),
        F.array_join(terms, " ").alias("_terms"))
    found = in_force(retrieve(asked.select("query_id", "query"), corpus, embed, config), as_of)
    # Reranking looks at the terms alone.
    by_terms = understand(asked.select("query_id", "check_id", F.col("_terms").alias("terms")), "terms")
    best = rerank(found.drop("reference", "intent", "query").join(by_terms, "query_id"), config.rerank_k)
    return first_evidence(asked, evidence_items(best, keep=["query_id", "final_rank"]))


def food_evidence(
    checks: DataFrame, corpus: DataFrame | None, embed: Embedder | None = None,
    config: RetrievalConfig = RetrievalConfig(),
) -> DataFrame:
    """Evidence of the food domain: best fused chunk of its corpus, else the domain's literal chunk."""
    value = F.coalesce(F.col("field_value"), F.lit("")) if "field_value" in checks.columns else F.lit("")
    asked = checks.select("query_id", "check_id", F.concat(
        F.lit("FSSAI food regulation "), F.coalesce("field", F.lit("")), F.lit(" "), value).alias("query"))
    if corpus is None:
        best = checks.sparkSession.createDataFrame(
            [], f"query_id {checks.schema['query_id'].dataType.simpleString()}, check_id string, chunk_id string, "
                "rule string, text string, score double, document_title string")
    else:
        best = fused_rank(retrieve(asked.select("query_id", "query"), corpus, embed, config)).filter("fused_rank = 1")
        best = best.withColumn("check_id", F.lit(None).cast("string"))
    return domain_evidence(asked, best, "fssai")


def food_corpus(rules: DataFrame) -> DataFrame:
    """Chunks of the food domain made from its rule catalogue."""
    none = F.lit(None).cast("string")
    return rules.select(
        F.lower(F.concat(F.lit("chk_"), "rule_id")).alias("chunk_id"),
        F.col("catalogue_ord").cast("long").alias("insert_ord"),
        F.lit("FSSAI Food Safety & Standards Regulations, 2018").alias("document_title"),
        F.col("rule_number").alias("rule"), none.alias("sub_rule"), none.alias("clause"), none.alias("schedule"),
        none.alias("chapter"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        none.alias("effective_from"), none.alias("effective_to"), F.lit("current").alias("status"),
        F.concat_ws(". ", "rule_name", "description").alias("text"),
    )


def dispatch(
    checks: DataFrame, metrology: DataFrame, food: DataFrame | None, as_of: str, embed: Embedder | None = None,
) -> DataFrame:
    """Evidence of every check from every domain its commodity calls for.

    checks: query_id, check_id, field, commodity_type, query_terms and, if known, field_value.  The same
    check repeats over all packages, so evidence is retrieved once per distinct
    check and domain and joined back.
    """
    routed = route(checks)
    # Only the food domain asks with the value; elsewhere it would only multiply the questions.
    value = F.col("field_value") if "field_value" in routed.columns else F.lit(None).cast("string")
    asked = routed.withColumn("_value", F.when(F.col("routed_domain") == "fssai", value))
    # Told apart by the columns themselves: hash aggregation combines repeats map-side, and no row is hashed as text.
    names = {"check_id": "_id", "field": "_field", "query_terms": "_terms", "_value": "_given", "routed_domain": "_domain"}
    known = cut_lineage(asked.select(*names).distinct().withColumn("_key", F.monotonically_increasing_id()))
    distinct = known.withColumnsRenamed({"_key": "query_id", "_value": "field_value"})
    lm = metrology_evidence(distinct.filter("routed_domain = 'legal_metrology'"), metrology, as_of, embed)
    fs = food_evidence(distinct.filter("routed_domain = 'fssai'"), food, embed)
    found = lm.select("query_id", F.lit("legal_metrology").alias("routed_domain"), *EVIDENCE).unionByName(
        fs.select("query_id", F.lit("fssai").alias("routed_domain"), *EVIDENCE))
    best = found.withColumnRenamed("query_id", "_key").drop("check_id", "routed_domain")
    answers = cut_lineage(known.withColumnsRenamed(names).join(best, "_key").drop("_key"))
    same = reduce(Column.__and__, [asked[c].eqNullSafe(answers[n]) for c, n in names.items()])
    return asked.join(small_side(answers), same).drop(*names.values(), "_value")
