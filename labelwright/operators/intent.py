"""Intent of a query: context, facets and the best catalogue entry."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed import limits as lim
from labelwright.fixed.intents import intent_rows
from labelwright.functions.text import contains_any, let, strip, tokens

INTENT_RESULT = (
    "struct<intent_id:string,requirement_name:string,matched_rule:string,matched_concepts:array<string>,"
    "detected_object:string,detected_facets:array<string>,detected_context:string,"
    "canonical_expansion:string,confidence:double>"
)

_ENTRY = (
    "intent_id:string,requirement_name:string,rule_target:string,object:string,facets:array<string>,context:string,"
    "entities:array<string>,n_entities:double,attributes:array<string>,n_attributes:double,"
    "positive:array<string>,negative:array<string>,aliases:array<string>,expansion:string"
)


def query_context(lowered: Column) -> Column:
    out = F
    for context, phrases in lim.CONTEXT_PHRASES:
        out = out.when(contains_any(lowered, phrases), F.lit(context))
    return out.otherwise(F.lit(lim.DEFAULT_CONTEXT))


def query_facets(lowered: Column) -> Column:
    found = [
        F.when(contains_any(lowered, phrases), F.array(*[F.lit(f) for f in facets]))
        for facets, phrases in lim.FACET_PHRASES
    ]
    return F.flatten(F.array_compact(F.array(*found)))


def _distinct(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))


def _words(terms: list[str]) -> list[str]:
    """Terms that can hit: a hit lies inside one word of the query, so a term of several words has none."""
    return [t for t in _distinct(terms) if re.fullmatch(r"\w+", t)]


def _seen_terms(lowered: Column, terms: list[str]) -> Column:
    """Catalogue terms contained in the text.

    The longest word of a term lies inside one word of any text that contains
    the term.  So the text's distinct words are searched for those longest
    words first, and whole terms are looked up only where that succeeds.
    """
    by_probe: dict[str, list[str]] = {}
    for t in terms:
        parts = re.findall(r"\w+", t)
        by_probe.setdefault(max(parts, key=len) if parts else "", []).append(t)
    table = F.from_json(
        F.lit(json.dumps([{"probe": p, "terms": ts} for p, ts in sorted(by_probe.items())])),
        "array<struct<probe:string,terms:array<string>>>")

    def search(words: Column) -> Column:
        likely = F.filter(table, lambda e: F.contains(words, e["probe"]))
        return F.flatten(F.transform(
            likely, lambda e: F.filter(e["terms"], lambda t: F.contains(lowered, t))))

    return let(F.array_join(F.array_distinct(tokens(lowered)), " "), search)


def _entry(e: dict) -> dict:
    return {
        "intent_id": e["intent_id"], "requirement_name": e["requirement_name"], "rule_target": e["rule_target"],
        "object": e["object"], "facets": e["facets"], "context": e.get("context") or lim.DEFAULT_CONTEXT,
        "entities": _words(e["entities"]), "n_entities": float(max(len(_distinct(e["entities"])), 1)),
        "attributes": _words(e["attributes"]), "n_attributes": float(max(len(_distinct(e["attributes"])), 1)),
        "positive": _distinct(e["positive_signals"]), "negative": _distinct(e["negative_signals"]),
        "aliases": _distinct(e["semantic_aliases"]),
        "expansion": " ".join([e["requirement_name"], " ".join(e["attributes"]), " ".join(e["entities"])]),
    }


def _score(e: Column, seen: Column, lowered: Column, context: Column, longest_alias: int) -> Column:
    """Score of one catalogue entry, given the catalogue terms seen in the query."""
    w = lim.INTENT_WEIGHTS

    def share(terms: Column, n: Column) -> Column:
        return F.size(F.array_intersect(terms, seen)) / n

    def worth(flag: Column, weight: float) -> Column:
        return F.when(flag, F.lit(weight)).otherwise(F.lit(0.0))

    inside_alias = (F.length(lowered) <= longest_alias) & F.exists(e["aliases"], lambda a: F.contains(a, lowered))
    return (
        F.lit(w["entity"]) * share(e["entities"], e["n_entities"])
        + F.lit(w["attribute"]) * share(e["attributes"], e["n_attributes"])
        + worth(F.arrays_overlap(e["aliases"], seen) | inside_alias, w["alias"])
        + worth(F.arrays_overlap(e["positive"], seen), w["positive"])
        + worth(e["context"] == context, w["context"])
        - worth(F.arrays_overlap(e["negative"], seen), w["negative"])
    )


def normalize_intent(
    queries: DataFrame, text: str = "query", out: str = "intent", catalogue: list[dict] | None = None
) -> DataFrame:
    """Add the intent of each query.

    The catalogue travels as one constant array, so every query is scored
    against every entry inside its own row: no join and no shuffle.  Of equal scores
    the earlier entry wins.
    """
    entries = [_entry(e) for e in (intent_rows() if catalogue is None else catalogue)]
    groups = ("entities", "attributes", "positive", "negative", "aliases")
    terms = sorted({t for e in entries for g in groups for t in e[g]})
    longest = max((len(a) for e in entries for a in e["aliases"]), default=0)
    table = F.from_json(F.lit(json.dumps(entries)), f"array<struct<{_ENTRY}>>")
    no_words = F.array().cast("array<string>")

    given = F.coalesce(F.col(text), F.lit(""))
    asked = (given != "") & F.lit(bool(entries))
    df = queries.withColumn("_q", strip(F.lower(given))).withColumn("_asked", asked)
    df = df.withColumn("_ctx", F.when(asked, query_context(F.col("_q"))).otherwise(F.lit(lim.DEFAULT_CONTEXT)))
    df = df.withColumn("_seen", _seen_terms(F.col("_q"), terms))
    scored = F.transform(table, lambda e, i: F.struct(
        _score(e, F.col("_seen"), F.col("_q"), F.col("_ctx"), longest).alias("score"), (-i).alias("nord")))
    df = df.withColumn("_best", F.array_max(scored))
    score = F.col("_best.score")
    taken = F.col("_asked") & (score > 0) & (score >= lim.INTENT_ACCEPT)
    df = df.withColumn("_hit", F.when(taken, F.get(table, -F.col("_best.nord"))))
    hit = F.col("_hit")
    facets = F.when(F.col("_asked"), query_facets(F.col("_q"))).otherwise(no_words)
    result = F.struct(
        hit["intent_id"].alias("intent_id"),
        hit["requirement_name"].alias("requirement_name"),
        hit["rule_target"].alias("matched_rule"),
        F.coalesce(F.sort_array(F.array_intersect(
            F.array_union(hit["entities"], hit["attributes"]), F.col("_seen"))), no_words).alias("matched_concepts"),
        hit["object"].alias("detected_object"),
        F.coalesce(F.sort_array(F.array_union(hit["facets"], facets)), facets).alias("detected_facets"),
        F.col("_ctx").alias("detected_context"),
        F.coalesce(hit["expansion"], F.lit("")).alias("canonical_expansion"),
        F.when(hit.isNotNull(), F.least(score, F.lit(1.0))).otherwise(F.lit(0.0)).alias("confidence"),
    )
    return df.withColumn(out, result.cast(INTENT_RESULT)).drop("_q", "_asked", "_ctx", "_seen", "_best", "_hit")
