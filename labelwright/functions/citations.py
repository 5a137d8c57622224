"""Legal references: parsing, formatting and comparison."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.fixed import legal_patterns as lg
from labelwright.fixed.limits import SCHEDULE_NUMERALS
from labelwright.functions.text import group_of, let, matched, rx, strip, truthy

REFERENCE_TYPE = (
    "struct<rule:string,sub_rule:string,clause:string,section:string,schedule:string,"
    "explicit_provision:boolean,raw_matches:array<string>>"
)


def schedule_numeral(spelling: Column) -> Column:
    """Roman numeral of a schedule spelling; an unknown spelling in capitals."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(SCHEDULE_NUMERALS.items())])
    return F.coalesce(F.try_element_at(table, F.lower(spelling)), F.upper(spelling))


def canonical_schedule(name: Column) -> Column:
    """Numeral of a schedule however it is named: ``Third Schedule``, ``Schedule III`` or ``III``."""
    bare = strip(F.regexp_replace(F.lower(name), r"\bschedule\b", ""))
    return F.when(truthy(bare).isNotNull(), schedule_numeral(bare))


def _joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def reference(query: Column) -> Column:
    """Explicit legal references of a query as one struct."""
    return let(strip(F.lower(F.coalesce(query, F.lit("")))), _reference)


def _reference(text: Column) -> Column:
    # The text is in lower case; each word is looked for before its patterns are tried.
    def found(word: str, pattern: str) -> Column:
        return F.when(F.contains(text, F.lit(word)), matched(text, rx(pattern)))

    sched = found("schedule", lg.SCHEDULE_REF)
    sched_name = F.coalesce(group_of(sched, rx(lg.SCHEDULE_REF), 1), group_of(sched, rx(lg.SCHEDULE_REF), 2))
    full = found("rule", lg.RULE_CLAUSE_REF)
    sub = found("rule", lg.RULE_SUB_REF)
    letter = found("rule", lg.RULE_LETTER_REF)
    plain = found("rule", lg.RULE_REF)
    short = found("(", lg.SHORT_LETTER_REF)
    sec = found("section", lg.SECTION_REF)

    # The first form that occurs decides; a form is tried only when the earlier ones are absent.
    pick = (
        F.when(full.isNotNull(), F.struct(F.lit(1).alias("form"), full.alias("m")))
        .when(sub.isNotNull(), F.struct(F.lit(2).alias("form"), sub.alias("m")))
        .when(letter.isNotNull(), F.struct(F.lit(3).alias("form"), letter.alias("m")))
        .when(plain.isNotNull(), F.struct(F.lit(4).alias("form"), plain.alias("m")))
        .when(short.isNotNull(), F.struct(F.lit(5).alias("form"), short.alias("m")))
    )
    stage = F.struct(pick.alias("pick"), sched.alias("sched"), sched_name.alias("sched_name"), sec.alias("sec"))

    def read(s: Column) -> Column:
        form, m = s["pick"]["form"], s["pick"]["m"]
        number = F.regexp_extract(m, "([0-9]+)", 1)
        inner = F.regexp_extract(m, r"\(\s*([0-9]+)\s*\)", 1)
        small = F.regexp_extract(m, r"\(\s*([a-z]{1,2})\s*\)", 1)
        sub_rule = (
            F.when(form.isin(1, 2), _joined(number, "(", inner, ")"))
            .when(form.isin(3, 5), _joined(number, "(", small, ")"))
        )
        clause = (
            F.when(form == 1, _joined(number, "(", inner, ")(", small, ")"))
            .when(form.isin(3, 5), sub_rule)
        )
        sec_no = group_of(s["sec"], rx(lg.SECTION_REF), 1)
        sec_sub = group_of(s["sec"], rx(lg.SECTION_REF), 2)
        section = F.when(sec_sub.isNotNull(), _joined(sec_no, "(", sec_sub, ")")).otherwise(sec_no)
        schedule = F.when(s["sched_name"].isNotNull(), schedule_numeral(s["sched_name"]))
        return F.struct(
            F.when(form.isNotNull(), number).alias("rule"),
            sub_rule.alias("sub_rule"),
            clause.alias("clause"),
            section.alias("section"),
            schedule.alias("schedule"),
            (form.isNotNull() | section.isNotNull() | schedule.isNotNull()).alias("explicit_provision"),
            F.array_compact(F.array(s["sched"], m, s["sec"])).alias("raw_matches"),
        )

    return let(stage, read)


def provision_name(rule: Column, sub_rule: Column, clause: Column, schedule: Column, unknown: str = "") -> Column:
    """Display name of a provision, by its most specific part."""
    return F.coalesce(
        F.concat(F.lit("Rule "), F.coalesce(truthy(clause), truthy(sub_rule), truthy(rule))),
        F.concat(F.lit("Schedule "), truthy(schedule)),
        F.lit(unknown),
    )


def same(a: Column, b: Column) -> Column:
    """Whether two references are both given and equal, ignoring case."""
    return F.coalesce(F.lower(truthy(a)) == F.lower(truthy(b)), F.lit(False))
