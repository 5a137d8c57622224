"""Retrieval quality: hit rate, citation accuracy, recall, MRR and failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.citations import provision_name
from labelwright.functions.text import truthy


# Ranks that count.
TOP = 5
# What a case shows as its first answer when the corpus cannot hold one.
GAP_ANSWER = "CORPUS_GAP"


def is_hit(expected: Column, rule: Column, text: Column, schedule: Column) -> Column:
    """Whether the expected reference appears in the evidence's rule, text or schedule."""
    low = F.lower(expected)
    found = F.lit(False)
    for c in (rule, text, schedule):
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), low)
    return found


def hit_rate(cases: DataFrame, hit: str = "is_hit") -> DataFrame:
    n = F.count(F.lit(1))
    hits = F.count_if(F.col(hit))
    return cases.agg(
        n.alias("total_test_cases"), hits.alias("hits"),
        F.when(n > 0, hits / n).otherwise(F.lit(0.0)).alias("hit_rate"))


def citation_accuracy(evidence: DataFrame, document: Column, rule: Column) -> DataFrame:
    """Share of evidence whose citation names a document and a rule."""
    n = F.count(F.lit(1))
    valid = F.count_if(truthy(document).isNotNull() & truthy(rule).isNotNull())
    return evidence.agg(
        n.alias("total_items"), valid.alias("valid_citations"),
        F.when(n > 0, valid / n).otherwise(F.lit(0.0)).alias("accuracy"))


def corpus_gaps(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cases that ask for a schedule the corpus does not hold and expect nothing else."""
    schedules = corpus.select(F.lower(truthy(F.col("schedule"))).alias("_s")).filter(F.col("_s").isNotNull()).distinct()
    asked = cases.filter(truthy(F.col("expected_schedule")).isNotNull() & (
        F.coalesce(F.size("expected_provisions"), F.lit(0)) <= 0))
    return asked.join(schedules, F.lower("expected_schedule") == F.col("_s"), "left_anti").select("id")


def match_ranks(cases: DataFrame, ranked: DataFrame, case_id: str = "id", rank: str = "final_rank") -> DataFrame:
    """First rank at which a case finds an expected provision or schedule (null when it never does)."""
    name = provision_name(F.col("rule"), F.col("sub_rule"), F.col("clause"), F.col("schedule"), "Unknown Provision")
    seen = ranked.select(
        F.col("query_id").alias(case_id), F.col(rank).alias("_rank"), name.alias("_name"),
        F.col("schedule").alias("_sched"))
    wanted = cases.select(case_id, "expected_provisions", "expected_schedule")
    joined = seen.join(wanted, case_id)
    hit = (
        F.coalesce(F.array_contains("expected_provisions", F.col("_name")), F.lit(False))
        | F.coalesce(F.lower(truthy(F.col("_sched"))) == F.lower(truthy(F.col("expected_schedule"))), F.lit(False)))
    best = joined.groupBy(case_id).agg(
        F.min(F.when(hit, F.col("_rank"))).alias("match_rank"),
        F.min_by("_name", "_rank").alias("top1"))
    return cases.join(best, case_id, "left")


def diagnose(matched: DataFrame, gaps: DataFrame, case_id: str = "id") -> DataFrame:
    """Result, failure class and corpus-gap flag of every case."""
    flagged = matched.join(gaps.withColumn("is_corpus_gap", F.lit(True)), case_id, "left").withColumn(
        "is_corpus_gap", F.coalesce("is_corpus_gap", F.lit(False)))
    if "top1" in matched.columns:
        flagged = flagged.withColumn("top1", F.when(F.col("is_corpus_gap"), F.lit(GAP_ANSWER)).otherwise(F.col("top1")))
    first = (F.col("match_rank") == 1) | F.col("is_corpus_gap")
    missed = ~F.coalesce(first, F.lit(False))
    return flagged.withColumn(
        "result",
        F.when(F.coalesce(first, F.lit(False)), F.lit("PASS"))
        .when(F.col("match_rank").isNotNull(), F.concat(F.lit("PASS_R"), F.col("match_rank").cast("string")))
        .otherwise(F.lit("FAIL")),
    ).withColumn(
        "failure_class",
        F.when(missed & (F.col("category") == "exact_provision"), F.lit("EXACT_REFERENCE_ERROR"))
        .when(missed & (F.col("category") == "schedule_query"), F.lit("SCHEDULE_MISMATCH_ERROR"))
        .when(missed, F.lit("SEMANTIC_CONFUSION")))


def retrieval_metrics(diagnosed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall@1, recall@5, MRR over the first five and false top-1 rate; a corpus gap counts as found first."""
    n = F.count(F.lit(1))
    gap, rank = F.col("is_corpus_gap"), F.col("match_rank")
    top1 = F.count_if(gap | F.coalesce(rank == 1, F.lit(False)))
    top5 = F.count_if(gap | F.coalesce(rank <= TOP, F.lit(False)))
    gain = F.when(gap, F.lit(1.0)).otherwise(F.coalesce(F.when(rank <= TOP, F.lit(1.0) / rank), F.lit(0.0)))

    def share(x: Column) -> Column:
        return F.when(n > 0, x / n * 100.0).otherwise(F.lit(0.0))

    aggregates = [
        n.alias("total"), share(top1).alias("recall_1"), share(top5).alias("recall_5"),
        F.when(n > 0, F.sum(gain) / n).otherwise(F.lit(0.0)).alias("mrr"),
        share(n - top1).alias("false_top1_rate"),
    ]
    return diagnosed.groupBy(*by).agg(*aggregates) if by else diagnosed.agg(*aggregates)


def acceptance(exact: Column, natural: Column, schedule: Column, false_top1: Column) -> Column:
    """The full benchmark's acceptance bar."""
    met = (exact == 100.0) & (natural >= 95.0) & (schedule == 100.0) & (false_top1 == 0.0)
    return F.when(met, F.lit("FIXED")).otherwise(F.lit("PARTIALLY FIXED"))


def main_acceptance(recall_1: Column, schedule: Column) -> Column:
    """The main benchmark's acceptance bar."""
    return (
        F.when((recall_1 >= 95.0) & (schedule >= 90.0), F.lit("FIXED"))
        .when(recall_1 >= 80.0, F.lit("PARTIALLY FIXED"))
        .otherwise(F.lit("NOT FIXED")))
