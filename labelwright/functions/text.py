"""Text expressions: patterns, tokens, trimming and number formatting."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits of any script, underscore: what counts as part of a word.
WORD_CHARS = r"\p{L}\p{N}_"


def rx(pattern: str) -> str:
    """The pattern with Unicode classes, ignoring case."""
    return "(?iuU)" + pattern


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may refer to it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truthy(c: Column) -> Column:
    """Null for an empty string, else the value."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cols])


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matched(text: Column, pattern: str) -> Column:
    """The first match as a string, null when there is none (patterns here never match empty)."""
    return F.regexp_substr(text, F.lit(pattern))


def group_of(match: Column, pattern: str, group: int) -> Column:
    """A group of ``pattern`` taken from an already cut-out match; null when unset."""
    return truthy(F.regexp_extract(match, pattern, group))


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHARS}]+"), F.lit(0))


def python_float_text(value: Column) -> Column:
    """A double the way ``str`` prints it: plain digits between 1e-4 and 1e16, else an exponent."""

    def show(v: Column) -> Column:
        text, size = v.cast("string"), F.abs(v)
        digits = F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"0+$", "")
        plain = F.regexp_replace(digits, r"\.$", ".0")
        # 1.5E20 -> 1.5e+20, 1.0E-5 -> 1e-05
        exponent = F.regexp_replace(F.regexp_replace(text, r"\.0E|E", "e"), r"e([0-9])", "e+$1")
        exponent = F.regexp_replace(exponent, r"e([+-])([0-9])$", "e$10$2")
        return (
            F.when((size >= 1e-3) & (size < 1e7) | (size == 0), text)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .when(text == "Infinity", F.lit("inf"))
            .otherwise(exponent)
        )

    return let(value, show)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def shorten(text: Column, limit: int) -> Column:
    """Cut a display string to ``limit`` characters and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A repeatable eight-digit id from the given parts."""
    key = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 8))
