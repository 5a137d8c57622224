"""Quality rules as a short-circuit cascade, in SQL expressions only.

Counts every rule needs (words, symbols, repeated lines and windows) are taken
once per text.  The rules are then asked one after another and the first that
rejects ends the work for that text.  Their order comes from a sample: each rule
is timed on it, the combinations of verdicts are counted, and the rule that
rejects most of what is still there per unit of cost goes first.  The order
changes the cost and the named reason, never which texts are kept.

Results: null texts have no words and fail; empty texts likewise.  Rows are
judged one by one, repeated or not.  Extra columns are passed on, whatever their
names.  The sample (``SAMPLE_ROWS`` expected rows) serves only the order.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut_lineage, packed

SPACE = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
REPEATED_PERCENT = 50
SAMPLE_ROWS = 2000
EMPTY = "cast(array() AS array<string>)"

# Rules beyond the base: SQL over the counts and the text; true rejects.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "capitals": "2 * regexp_count(text, '[A-Z]{2}') > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "n_dup_lines >= 4 AND 10 * n_dup_lines > 6 * n_full_lines",
}


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, n_words, word_chars, n_symbols, n_full_lines, n_dup_lines, n_repeat_words), whole texts.

    Windows of three words are compared by 64-bit hashes.  A text whose hashes
    are all different has no repeated window; only the others are sorted.
    """
    df = packed(docs, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.select("*", F.btrim("text", F.lit(SPACE)).alias("body"))
    df = df.select("*", F.when(F.col("body") == "", F.expr(EMPTY)).otherwise(F.split("body", GAP, -1)).alias("words"))
    # A literal of its own: in SQL text, \f would be read as the letter f.
    df = df.select("*", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"))
    df = df.select(
        "row", "text", F.size("words").alias("n"), F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.expr(f"regexp_count(text, '{SYMBOL}')").alias("n_symbols"), F.size("lines").alias("n_full_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr("slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))").alias("seen"))
    df = df.select("*", F.expr("""
        IF(size(array_distinct(seen)) = size(seen), cast(array() AS array<struct<h: bigint, i: int>>),
           sort_array(transform(seen, (h, i) -> struct(h, i))))""").alias("ordered"))
    df = df.select("*", F.expr("""
        array_sort(filter(transform(ordered, (e, j) -> IF(e.h = get(ordered, j - 1).h OR e.h = get(ordered, j + 1).h, e.i, NULL)),
                          p -> p IS NOT NULL))""").alias("again"))
    covered = F.expr("aggregate(transform(again, (p, j) -> least(3, coalesce(get(again, j + 1) - p, 3))), 0, (n, x) -> n + x)")
    found = F.struct(*[F.col(c).cast("long").alias(a) for c, a in (
        ("n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_full_lines", "n_full_lines"),
        ("n_dup_lines", "n_dup_lines"))], covered.cast("long").alias("n_repeat_words"))
    # Unfolded from one struct, the counts are values: a filter on them is not rewritten into the work above.
    return df.select("row", "text", F.array(found).alias("found")).select("row", "text", F.inline_outer("found"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def measured_order(docs: DataFrame, rules: dict[str, str] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, by what each rejects of the texts left over per second of its cost."""
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)
    sample = cut_lineage(counts(docs.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, sample_rows / total), seed=1)).drop("row"))

    def seconds(test: Column) -> float:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(test)).collect()
            best.append(time.perf_counter() - began)
        return min(best)

    nothing = seconds(F.col("n_words") < 0)
    cost = {name: max(seconds(F.expr(rule)) - nothing, 1e-4) for name, rule in rules.items()}
    passed = sample.where(~base_failed()).groupBy(*[F.expr(f"coalesce({r}, false)").alias(n) for n, r in rules.items()]).count().collect()
    order, left = [], [r.asDict() for r in passed]
    while len(order) < len(rules):
        rest = [n for n in rules if n not in order]
        best = max(rest, key=lambda n: sum(r["count"] for r in left if r[n]) / cost[n])
        order.append(best)
        left = [r for r in left if not r[best]]
    return order


def judged(docs: DataFrame, rules: dict[str, str] = RULES, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``counts`` with base_failed, reason (the first rule that rejects, or null) and kept."""
    order = measured_order(docs, rules, text_col) if order is None else order
    reason = F.when(base_failed(), F.lit("base"))
    for name in order:
        reason = reason.when(F.expr(rules[name]), F.lit(name))
    df = counts(docs, text_col).select("*", base_failed().alias("base_failed"), reason.alias("reason"))
    return df.select("*", F.col("reason").isNull().alias("kept"))
