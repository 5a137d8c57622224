"""Declarations read off labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed import label_patterns as lp
from labelwright.functions.fields import DECLARATIONS, additive_codes, allergens_in, commodity_of_text, folded
from labelwright.functions.text import let, rx, strip
from labelwright.operators.blocks import joined_text
from labelwright.types import FIELD

# Read off the joined text, after the declarations of single blocks.
SECTION_FIELDS = ["ingredients", "allergens", "ins_additives"]
# Every name a declaration can have.
DECLARED = [*lp.FIELD_ORDER, *SECTION_FIELDS]
_DEFAULT_CONFIDENCE = 0.90
_DEFAULT_BOX = (0, 0, 100, 20)
_SECTION_BOX = (0, 0, 500, 100)

# Private-use characters standing in for punctuation inside parentheses.
_INSIDE = "\ue000\ue001\ue002"


def _box(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ingredient_section(text: Column) -> Column:
    """Text from the ingredients header to the next section or the end; null without a header."""
    after = F.get(F.split(text, rx(lp.INGREDIENT_HEADER), 2), F.lit(1))
    parts = F.split(after, rx(lp.INGREDIENT_STOP), 2)
    return strip(F.get(parts, F.lit(0)))


def ingredient_items(section: Column) -> Column:
    """Ingredients of a section, split outside parentheses."""
    pieces = F.split(F.regexp_replace(section, r"(?U)^[^\w]+", ""), r"(?=[()])")

    def walk(acc: Column, piece: Column) -> Column:
        depth = (
            F.when(piece.startswith("("), acc["depth"] + 1)
            .when(piece.startswith(")"), F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        shown = F.when(depth > 0, F.translate(piece, ",;.", _INSIDE)).otherwise(piece)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], shown).alias("out"))

    guarded = F.aggregate(
        pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), walk, lambda acc: acc["out"]
    )
    edges = f"^[{lp.INGREDIENT_TRIM}]+|[{lp.INGREDIENT_TRIM}]+$"

    def clean(item: Column) -> Column:
        bare = F.regexp_replace(F.translate(item, _INSIDE, ",;."), edges, "")
        whole = bare.startswith("(") & bare.endswith(")")
        bare = F.when(whole, strip(bare.substr(F.lit(2), F.length(bare) - 2))).otherwise(bare)
        return strip(F.regexp_replace(bare, rx(lp.INGREDIENT_NOISE), ""))

    items = F.transform(F.split(guarded, "(?U)" + lp.INGREDIENT_SEPARATOR), clean)
    return F.filter(
        items, lambda item: (F.length(item) >= lp.INGREDIENT_MIN_CHARS) & ~item.rlike(r"(?U)^\d+$")
    )


def _entry(ord_: Column, place: int, name: str, raw: Column, value: Column, unit: Column, conf: Column, box: Column):
    return F.struct(
        ord_.alias("ord"), F.lit(place).alias("place"),
        F.struct(
            F.lit(name).alias("field_name"), raw.alias("raw_text"), value.alias("normalized_value"),
            unit.alias("unit"), conf.alias("confidence"), box.alias("bbox"),
        ).cast(FIELD).alias("field"),
    )


def _first_hit(hits: Column, name: str) -> Column:
    return F.get(F.filter(hits, lambda h: h[name].isNotNull()), F.lit(0))


def extract_fields(labels: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Commodity class and declarations of each label, read inside the row (no shuffle).

    Every declaration comes from the first block that carries it; ingredients,
    allergens and additives come from the joined text.
    """
    col = F.col(blocks)

    def scan(b: Column, i: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        return let(folded(text), lambda low: F.struct(
            i.alias("ord"),
            F.coalesce(b["confidence"], F.lit(_DEFAULT_CONFIDENCE)).alias("confidence"),
            F.coalesce(b["bbox"], _box(_DEFAULT_BOX)).alias("bbox"),
            *[DECLARATIONS[name].match(text, low).alias(name) for name in lp.FIELD_ORDER],
        ))

    out = labels.withColumn("_hits", F.transform(col, scan))
    out = out.withColumn("_section", ingredient_section(joined_text(col, "\n")))
    for name in lp.FIELD_ORDER:
        out = out.withColumn(f"_{name}", _first_hit(F.col("_hits"), name))
    header = F.filter(col, lambda b: b["text"].rlike(rx(lp.INGREDIENT_HEADER)))
    listed = F.struct(
        F.get(header, F.lit(0)).alias("block"),
        F.array_join(ingredient_items(F.col("_section")), ", ").alias("ingredients"),
        F.array_join(allergens_in(F.col("_section")), ", ").alias("allergens"),
        F.array_join(additive_codes(F.col("_section")), ", ").alias("ins_additives"),
    )
    out = out.withColumn("_listed", F.when(F.col("_section").isNotNull(), listed))

    entries = []
    for place, name in enumerate(lp.FIELD_ORDER):
        hit, d = F.col(f"_{name}"), DECLARATIONS[name]
        entries.append(F.when(hit.isNotNull(), _entry(
            hit["ord"], place, name, hit[name]["raw"], d.value(hit[name]), d.unit(hit[name]),
            hit["confidence"], hit["bbox"],
        )))
    last, none = F.size(col), F.lit(None).cast("string")
    from_section = F.col("_listed")
    conf = F.coalesce(from_section["block"]["confidence"], F.lit(_DEFAULT_CONFIDENCE))
    box = F.coalesce(from_section["block"]["bbox"], _box(_SECTION_BOX))
    place = len(lp.FIELD_ORDER)
    entries.append(F.when(from_section.isNotNull(), _entry(
        last, place, "ingredients", F.col("_section"), from_section["ingredients"], none, conf, box)))
    for extra, name in enumerate(["allergens", "ins_additives"], start=1):
        value = from_section[name]
        entries.append(F.when(value != "", _entry(last, place + extra, name, value, value, none, conf, box)))

    ordered = F.sort_array(F.array_compact(F.array(*entries)))
    keep = [c for c in labels.columns if c != blocks]
    return out.select(
        *keep,
        commodity_of_text(joined_text(col, " ")).alias("commodity_type"),
        F.transform(ordered, lambda e: e["field"]).alias("extracted_fields"),
    )


def first_declarations(
    blocks: DataFrame, keys: list[str], order: list[Column], text: str = "text", names: list[str] | None = None
) -> DataFrame:
    """First match of each declaration per group of a block table.

    ``min_by`` combines map-side, so a group holding most of the rows still
    reaches its task as one row per input partition.
    """
    names = names or lp.FIELD_ORDER
    low = blocks.select(
        *keys, F.struct(*order).alias("_order"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        folded(F.col(text)).alias("_low"))
    scanned = low.select(
        *keys, "_order", *[DECLARATIONS[n].match(F.col("_text"), F.col("_low")).alias(n) for n in names])
    firsts = scanned.groupBy(*keys).agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("_order"))).alias(f"{n}_found") for n in names]
    )
    return firsts.select(*keys, *_shown(names))


def _shown(names: list[str]) -> list[Column]:
    """What was found, and its raw text, value and unit, for each declaration."""
    return [c for n in names for c in (
        F.col(f"{n}_found"), F.col(f"{n}_found.raw").alias(f"{n}_raw"),
        DECLARATIONS[n].value(F.col(f"{n}_found")).alias(f"{n}_value"),
        DECLARATIONS[n].unit(F.col(f"{n}_found")).alias(f"{n}_unit"),
    )]


def declarations_in_text(df: DataFrame, text: str, names: list[str] | None = None) -> DataFrame:
    """Every declaration of a text column, as raw match, value and unit columns."""
    names = names or lp.FIELD_ORDER
    low = df.withColumn("_low", folded(F.col(text)))
    found = low.select(*df.columns, *[
        DECLARATIONS[n].match(F.col(text), F.col("_low")).alias(f"{n}_found") for n in names])
    return found.select(*df.columns, *_shown(names))
