"""Evidence and citations built from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed.provisions import DOCUMENT_TITLE, FSSAI_FALLBACK, NO_EVIDENCE
from labelwright.functions.text import first_truthy

_DEFAULT_SCORE = 0.85


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _page(df: DataFrame) -> Column:
    """First page of the chunk; page 0 counts as none."""
    start, page = _column(df, "page_start", "int"), _column(df, "page", "int")
    return F.coalesce(F.nullif(start, F.lit(0)), page, F.lit(1) if "page" not in df.columns else F.lit(None).cast("int"))


def citation(df: DataFrame, default_document: str = DOCUMENT_TITLE) -> Column:
    """Where a chunk comes from."""
    rule = F.col("rule") if "rule" in df.columns else F.lit("Rule 6")
    return F.struct(
        first_truthy(_column(df, "document_title"), _column(df, "document"), F.lit(default_document)).alias("document"),
        rule.alias("rule"),
        _column(df, "sub_rule").alias("sub_rule"),
        _column(df, "clause").alias("clause"),
        _column(df, "schedule").alias("schedule"),
        _page(df).alias("page"),
    )


def evidence_items(candidates: DataFrame, default_document: str = DOCUMENT_TITLE, keep: list[str] | None = None) -> DataFrame:
    """One evidence row per retrieved chunk, with its citation and a score limited to [0, 1]."""
    cite = citation(candidates, default_document)
    ids = [_column(candidates, c) for c in ("check_id", "query_id")]
    score = F.coalesce(_column(candidates, "retrieval_score", "double"), _column(candidates, "score", "double"),
                       F.lit(_DEFAULT_SCORE)).cast("double")
    out = candidates.withColumn("_c", cite).withColumn("_s", score)
    return out.select(
        *(keep or []),
        first_truthy(*[i.cast("string") for i in ids], F.lit("LM_CHECK_UNK")).alias("check_id"),
        F.coalesce(_column(candidates, "chunk_id"), F.lit("chk_unk")).alias("chunk_id"),
        F.col("_c.document").alias("document"), F.col("_c.rule").alias("rule"),
        F.col("_c.sub_rule").alias("sub_rule"), F.col("_c.clause").alias("clause"),
        F.col("_c.schedule").alias("schedule"), F.col("_c.page").alias("page"),
        F.coalesce(_column(candidates, "text"), F.lit("")).alias("text"),
        F.col("_s").alias("retrieval_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s"))).alias("score_in_range"),
        F.col("_c").alias("citation"),
    )


def first_evidence(queries: DataFrame, items: DataFrame, rank: str = "final_rank", query_id: str = "query_id") -> DataFrame:
    """Top evidence of each query; a query without any gets the no-evidence row."""
    top = items.filter(F.col(rank) == 1).drop(rank, "check_id")
    joined = queries.select(query_id, F.col("check_id")).join(top, query_id, "left")
    missing = F.col("chunk_id").isNull()

    def or_default(name: str, default) -> Column:
        return F.when(missing, F.lit(default)).otherwise(F.col(name)).alias(name)

    none = F.lit(None)
    bare = F.struct(
        F.lit(DOCUMENT_TITLE).alias("document"), F.lit(NO_EVIDENCE["rule"]).alias("rule"),
        none.cast("string").alias("sub_rule"), none.cast("string").alias("clause"),
        none.cast("string").alias("schedule"), none.cast("int").alias("page"),
    )
    return joined.select(
        query_id,
        first_truthy(F.col("check_id"), F.col(query_id).cast("string"), F.lit("LM_UNK")).alias("check_id"),
        F.when(missing, F.lit(NO_EVIDENCE["text"])).otherwise(F.col("text")).alias("text"),
        or_default("document", DOCUMENT_TITLE), or_default("rule", NO_EVIDENCE["rule"]),
        "sub_rule", "clause", "schedule", "page",
        or_default("retrieval_score", NO_EVIDENCE["score"]), or_default("score_in_range", NO_EVIDENCE["score"]),
        F.when(missing, bare).otherwise(F.col("citation")).alias("citation"),
        F.when(missing, F.lit(NO_EVIDENCE["chunk_id"])).otherwise(F.col("chunk_id")).alias("chunk_id"),
    )


def domain_evidence(queries: DataFrame, best: DataFrame, domain: str, query_id: str = "query_id") -> DataFrame:
    """Evidence of a domain without its own corpus: best chunk or the domain's literal fallback."""
    joined = queries.select(query_id, "check_id").join(best.drop("check_id"), query_id, "left")
    fb = FSSAI_FALLBACK
    filled = joined.withColumn("_missing", F.col("chunk_id").isNull())
    missing = F.col("_missing")
    for name in ("chunk_id", "rule", "text"):
        filled = filled.withColumn(name, F.when(missing, F.lit(fb[name])).otherwise(F.col(name)))
    filled = filled.withColumn("score", F.when(missing, F.lit(fb["score"])).otherwise(F.col("score")))
    if domain == "fssai":
        filled = filled.withColumn("document_title", F.lit(fb["document_title"]))
    return evidence_items(filled, keep=[query_id]).withColumn(
        "relevant_rule", F.lit(f"{domain.upper()} Regulation")).withColumn("domain", F.lit(domain))


def first_generation_evidence(hits: DataFrame, document: str, page: int = 12) -> DataFrame:
    """Evidence in the first layout: confidence clamped to [0, 1], a constant page."""
    return hits.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).withColumn(
        "citation", F.struct(F.lit(document).alias("document"), F.col("rule").alias("rule"), F.lit(page).alias("page")))
