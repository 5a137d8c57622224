"""Reranking of fused candidates by reference, intent, context and facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.fixed.limits import INTENT_USE, RERANK_TOP_K
from labelwright.functions.citations import provision_name, same
from labelwright.functions.text import truthy
from labelwright.operators.fuse import fused_order


@dataclass(frozen=True)
class Nudge:
    """Fixed value: points for a provision when a facet or context is asked for."""

    facet: tuple[str, ...] = ()
    context: str | None = None
    rule: str | None = None
    sub_rule: str | None = None
    clause: str | None = None
    chapter_word: str | None = None
    points: float = 0.0
    # Used only when the entry before it did not apply.
    otherwise: bool = False


# Context points and contradictions.
CONTEXT_NUDGES = [
    Nudge(context="WHOLESALE_PACKAGE", rule="24", chapter_word="wholesale", points=3.0),
    Nudge(context="WHOLESALE_PACKAGE", rule="13", sub_rule="13(6)", points=-15.0, otherwise=True),
    Nudge(context="ADVERTISEMENT", rule="31", points=3.0),
    Nudge(context="PACKAGE_LABEL", rule="31", points=-15.0),
]

# Facet points and contradictions.
FACET_NUDGES = [
    Nudge(facet=("spacing", "placement"), rule="8", sub_rule="8(1)", points=5.0),
    Nudge(facet=("spacing", "placement"), rule="6", clause="6(1)(c)", points=-3.0, otherwise=True),
    Nudge(facet=("font_size",), context="PACKAGE_LABEL", rule="7", sub_rule="7(2)", points=5.0),
    Nudge(facet=("font_size",), context="ADVERTISEMENT", rule="31", sub_rule="31(2)", points=5.0),
    Nudge(facet=("wrapper_visibility",), rule="9", sub_rule="9(2)", points=5.0),
    Nudge(facet=("multipack",), rule="13", sub_rule="13(6)", points=5.0),
    Nudge(facet=("multipack",), rule="11", sub_rule="11(1)", points=-5.0, otherwise=True),
    Nudge(facet=("wrapper_exclusion",), rule="11", sub_rule="11(1)", points=5.0),
]

# Points for an explicitly named provision.
EXACT_POINTS, PARENT_POINTS, SCHEDULE_MISMATCH_POINTS, INTENT_POINTS = 15.0, 5.0, -20.0, 5.0
RRF_WEIGHT, VECTOR_WEIGHT = 10.0, 2.0

COMPONENTS = [
    ("vector", "vector_score"), ("bm25", "bm25_score"), ("rrf", "rrf_score"),
    ("cross_encoder", "cross_encoder_score"), ("intent_match", "intent_boost"), ("facet_match", "facet_boost"),
    ("context_match", "context_boost"), ("contradiction_penalty", "contradiction_penalty"),
    ("hierarchy", "hierarchy_boost"), ("final", "final_score"),
]


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column).cast("string") == value, F.lit(False))


def _applies(n: Nudge, facets: Column, context: Column) -> Column:
    test = F.lit(True)
    if n.facet:
        asked = F.lit(False)
        for f in n.facet:
            asked = asked | F.array_contains(facets, f)
        test = test & asked
    if n.context:
        test = test & (context == n.context)
    where = F.lit(True)
    for column, value in (("rule", n.rule), ("sub_rule", n.sub_rule), ("clause", n.clause)):
        if value:
            where = where & _is(column, value)
    if n.chapter_word:
        where = where | F.contains(F.lower(F.coalesce(F.col("chapter"), F.lit(""))), F.lit(n.chapter_word))
    return test & where


def _points(nudges: list[Nudge], facets: Column, context: Column, positive: bool) -> Column:
    total, before = F.lit(0.0), F.lit(False)
    for n in nudges:
        hit = _applies(n, facets, context)
        live = hit & ~before if n.otherwise else hit
        if (n.points > 0) == positive:
            total = total + F.when(live, F.lit(n.points)).otherwise(F.lit(0.0))
        before = hit
    return total


def _reference_match(ref: Column) -> tuple[Column, Column]:
    """(points, match type) of an explicitly named rule, sub-rule, clause or section."""
    clause = same(ref["clause"], F.col("clause"))
    sub = same(ref["sub_rule"], F.col("sub_rule"))
    rule = same(ref["rule"], F.col("rule"))
    section = same(ref["section"], F.col("section"))
    steps = [
        (ref["clause"].isNotNull(), [(clause, EXACT_POINTS, "EXACT_CLAUSE"), (sub | rule, PARENT_POINTS, "PARENT_RULE")]),
        (ref["sub_rule"].isNotNull(), [(sub, EXACT_POINTS, "EXACT_SUBRULE"), (rule, PARENT_POINTS, "PARENT_RULE")]),
        (ref["section"].isNotNull(), [(section, EXACT_POINTS, "EXACT_SECTION")]),
        (ref["rule"].isNotNull(), [(rule, EXACT_POINTS, "EXACT_RULE")]),
    ]
    points, kind = F, F
    for asked, outcomes in steps:
        p, k = F, F
        for hit, value, name in outcomes:
            p, k = p.when(hit, F.lit(value)), k.when(hit, F.lit(name))
        points = points.when(asked, p.otherwise(F.lit(0.0)))
        kind = kind.when(asked, k.otherwise(F.lit("NO_MATCH")))
    return points.otherwise(F.lit(0.0)), kind.otherwise(F.lit("NO_MATCH"))


def score_candidates(candidates: DataFrame, reference: str = "reference", intent: str = "intent") -> DataFrame:
    """Score every candidate row; it must carry its chunk, its query's reference and intent."""
    df = candidates
    for name in ("section", "chapter", "schedule"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    for name in ("cross_encoder_score", "vector_score", "bm25_score", "rrf_score"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0.0))
    ref, why = F.col(reference), F.col(intent)
    explicit = ref["explicit_provision"]
    base, kind = _reference_match(ref)
    asked_schedule = explicit & ref["schedule"].isNotNull()
    schedule_hit = asked_schedule & same(ref["schedule"], F.col("schedule"))
    schedule_points = (
        F.when(schedule_hit, F.lit(EXACT_POINTS))
        .when(asked_schedule, F.lit(SCHEDULE_MISMATCH_POINTS))
        .otherwise(F.lit(0.0))
    )
    name = provision_name(F.col("rule"), F.col("sub_rule"), F.col("clause"), F.col("schedule"))
    by_intent = F.coalesce(
        (why["confidence"] >= INTENT_USE)
        & F.contains(F.lower(name), F.lower(truthy(why["matched_rule"]))), F.lit(False))
    matched = (
        F.when(schedule_hit, F.lit("EXACT_SCHEDULE"))
        .when(asked_schedule, F.lit("SCHEDULE_MISMATCH"))
        .when(explicit, kind)
        .otherwise(F.lit("NO_MATCH"))
    )
    facets, context = why["detected_facets"], why["detected_context"]
    df = (
        df.withColumn("hierarchy_boost", F.when(explicit, base).otherwise(F.lit(0.0)) + schedule_points)
        .withColumn("intent_boost", F.when(by_intent, F.lit(INTENT_POINTS) * why["confidence"]).otherwise(F.lit(0.0)))
        .withColumn("facet_boost", _points(FACET_NUDGES, facets, context, True))
        .withColumn("context_boost", _points(CONTEXT_NUDGES, facets, context, True))
        .withColumn("contradiction_penalty",
                    _points(CONTEXT_NUDGES, facets, context, False) + _points(FACET_NUDGES, facets, context, False))
        .withColumn("meta_match_type", F.when((matched == "NO_MATCH") & by_intent, F.lit("INTENT_MATCH")).otherwise(matched))
    )
    final = (
        F.col("cross_encoder_score") + F.col("hierarchy_boost") + F.col("intent_boost") + F.col("facet_boost")
        + F.col("context_boost") + F.col("contradiction_penalty")
        + F.col("rrf_score") * RRF_WEIGHT + F.col("vector_score") * VECTOR_WEIGHT
    )
    df = df.withColumn("final_score", final).withColumn("retrieval_score", F.col("final_score"))
    return df.withColumn("score_components", F.struct(*[F.col(c).alias(n) for n, c in COMPONENTS]))


def rerank(
    candidates: DataFrame, k: int = RERANK_TOP_K, query_id: str = "query_id", order: list[Column] | None = None,
    reference: str = "reference", intent: str = "intent",
) -> DataFrame:
    """The k best candidates of each query; equal scores keep the candidate order."""
    scored = score_candidates(candidates, reference, intent)
    by = [F.desc("final_score"), *(order or fused_order())]
    ranked = scored.withColumn("final_rank", F.row_number().over(W.partitionBy(query_id).orderBy(*by)))
    return ranked.filter(F.col("final_rank") <= k)
