"""Declaration expressions: one match and one value per declaration."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.fixed import label_patterns as lp
from labelwright.functions.text import contains_any, group_of, let, matched, python_float_text, rx, strip, truthy


# Plain text that every match of a pattern contains, pattern by pattern; a pattern
# is tried only where one of its stems occurs (None: only a digit is needed).
_STEMS = {
    "mrp": [["mrp", "m.rp", "mr.p", "m.r.p", "max"], ["₹", "rs"]],
    "net_quantity": [["net"], ["net"], None],
    "fssai_license": [["fssai", "lic"], None],
    "batch_number": [["batch", "lot", "no"]],
    "mfg_date": [["mfd", "mfg", "packed", "pkd", "date"]],
    "expiry_date": [["exp", "use", "best"]],
    "consumer_care": [["@"], ["toll", "helpline", "call", "care"]],
}
# What else a text must hold before any pattern of a declaration can match.
_NEEDS = {"batch_number": None, "consumer_care": None, "fssai_license": r"[12]\p{Nd}{13}"}


def folded(text: Column) -> Column:
    """Lower case with the long s and the dotless i folded, as patterns that ignore case do."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ſı", "si")


def _first_match(text: Column, low: Column, name: str, patterns: list[str]) -> Column:
    """Match of the first pattern that occurs, as (raw, value, unit): the match and its groups.

    Later patterns run only when earlier ones fail, and groups are read from
    the short match alone.
    """
    none = F.lit(None).cast("struct<raw:string,value:string,unit:string>")

    def attempt(i: int) -> Column:
        if i == len(patterns):
            return none
        pattern = rx(patterns[i])
        unit = group_of_match(2) if re.compile(patterns[i]).groups > 1 else lambda m, p: F.lit(None).cast("string")
        found = let(
            F.regexp_extract(text, pattern, 0),
            lambda m: F.when(m != "", F.struct(
                m.alias("raw"), group_of(m, pattern, 1).alias("value"), unit(m, pattern).alias("unit"),
            )).otherwise(attempt(i + 1)))
        stems = _STEMS[name][i]
        return found if stems is None else F.when(contains_any(low, stems), found).otherwise(attempt(i + 1))

    need = _NEEDS.get(name, "[0-9]")
    return attempt(0) if need is None else F.when(text.rlike(need), attempt(0))


def group_of_match(group: int) -> Callable[[Column, str], Column]:
    return lambda m, pattern: group_of(m, pattern, group)


@dataclass(frozen=True)
class Declaration:
    """How one declaration is found in a text and shown."""

    name: str
    patterns: list[str]
    value: Callable[[Column], Column]
    unit: Callable[[Column], Column]

    def match(self, text: Column, low: Column | None = None) -> Column:
        """(raw, value, unit) as found in a text; ``low`` is the folded text when it is already at hand."""
        if low is None:
            return let(folded(text), lambda t: _first_match(text, t, self.name, self.patterns))
        return _first_match(text, low, self.name, self.patterns)


def amount(found: Column) -> Column:
    """Price of an MRP match; a comma is read as a decimal point."""
    return F.translate(found["value"], ",", ".").try_cast("double")


def quantity(found: Column) -> Column:
    return found["value"].try_cast("double")


def quantity_unit(found: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in lp.UNIT_ALIASES.items() for x in pair])
    return let(F.lower(found["unit"]), lambda u: F.coalesce(F.try_element_at(aliases, u), u))


def _text_declaration(name: str, patterns: list[str]) -> Declaration:
    return Declaration(name, patterns, lambda found: strip(found["value"]), lambda found: found["unit"])


DECLARATIONS: dict[str, Declaration] = {
    "mrp": Declaration(
        "mrp", lp.MRP,
        lambda found: python_float_text(amount(found)),
        lambda found: F.when(found.isNotNull(), F.lit("INR")),
    ),
    "net_quantity": Declaration(
        "net_quantity", lp.NET_QUANTITY, lambda found: python_float_text(quantity(found)), quantity_unit,
    ),
    "fssai_license": _text_declaration("fssai_license", lp.FSSAI_LICENSE),
    "batch_number": _text_declaration("batch_number", lp.BATCH_NUMBER),
    "mfg_date": _text_declaration("mfg_date", lp.MFG_DATE),
    "expiry_date": _text_declaration("expiry_date", lp.EXPIRY_DATE),
}

# Contact declaration; reported outside the per-block set.
CONSUMER_CARE = _text_declaration("consumer_care", lp.CONSUMER_CARE)


def email_of(text: Column) -> Column:
    return group_of(matched(text, rx(lp.CONSUMER_CARE[0])), rx(lp.CONSUMER_CARE[0]), 1)


def phone_of(text: Column) -> Column:
    return group_of(matched(text, rx(lp.CONSUMER_CARE[1])), rx(lp.CONSUMER_CARE[1]), 1)


def additive_codes(text: Column) -> Column:
    """Additive codes of a text in order of first appearance."""
    found = F.regexp_extract_all(text, F.lit(rx(lp.INS_CODE)), F.lit(1))
    return F.array_distinct(F.transform(found, lambda code: F.concat(F.lit("INS "), code)))


def allergens_in(text: Column) -> Column:
    """Known allergens named in a text, in list order."""
    lowered = F.lower(text)
    named = [
        F.when(
            F.contains(lowered, F.lit(word)) & lowered.rlike(rf"(?U)\b{word}\b"),
            F.lit(word[:1].upper() + word[1:]))
        for word in lp.ALLERGENS
    ]
    return F.array_compact(F.array(*named))


def literal_stem(pattern: str) -> str:
    """Leading plain text that any match of a word pattern contains."""
    body = pattern.removeprefix(r"\b")
    stem = re.match(r"[a-z -]*", body).group()
    return stem[:-1] if body[len(stem):len(stem) + 1] == "?" else stem


def pattern_score(lowered: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur at least once in a lower-case text.

    A plain substring test comes first, so a pattern runs only where its stem occurs.
    """
    score = F.lit(0)
    for p in patterns:
        hit = F.contains(lowered, F.lit(literal_stem(p))) & lowered.rlike(rx(p))
        score = score + hit.cast("int")
    return score


# Every class a text can have.
COMMODITIES = ["food", "drugs_cosmetics", "general_commodity"]


def commodity_class(food: Column, drug: Column) -> Column:
    return (
        F.when((food >= 1) & (food >= drug), F.lit("food"))
        .when(drug >= 1, F.lit("drugs_cosmetics"))
        .otherwise(F.lit("general_commodity"))
    )


def commodity_of_text(text: Column) -> Column:
    """Commodity class of a text; null or empty text is a general commodity."""
    return let(folded(text), lambda t: commodity_class(
        pattern_score(t, lp.FOOD_WORDS), pattern_score(t, lp.DRUG_COSMETIC_WORDS)))


def declared_value(normalized: Column, raw: Column) -> Column:
    """The value shown for a declaration: the normalised one, else the raw text."""
    return F.coalesce(truthy(normalized), truthy(raw))
