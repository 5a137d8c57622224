"""Check catalogue: mapping fields to checks, routing domains, validating catalogues."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.fixed import catalogues as cat
from labelwright.fixed import limits as lim
from labelwright.functions.text import contains_any, first_truthy, stable_id, strip, truthy
from labelwright.session import small_side
from labelwright.types import CHECK, RULE


def check_catalogue(spark: SparkSession) -> DataFrame:
    """The packaged check catalogue, numbered in catalogue order."""
    return _numbered(spark, cat.check_rows(), CHECK)


def rule_catalogue(spark: SparkSession, domain: str = "legal_metrology") -> DataFrame:
    return _numbered(spark, cat.FSSAI_RULES if domain == "fssai" else cat.RULES, RULE)


def _numbered(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A fixed, short list with the catalogue position of each row."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, catalogue_ord int")


def _constant(catalogue: DataFrame, columns: list[str]) -> Column:
    """A catalogue as one constant array of structs, so that a row meets its entries without a join.

    A catalogue is written by hand: hundreds of entries, never a growing table.
    """
    kinds = {c: catalogue.schema[c].dataType for c in columns}

    def value(v, kind) -> Column:
        return F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)

    rows = catalogue.select("catalogue_ord", *columns).orderBy("catalogue_ord").collect()
    entries = [F.struct(F.lit(r["catalogue_ord"]).alias("catalogue_ord"), *[value(r[c], k).alias(c) for c, k in kinds.items()]) for r in rows]
    kind = ", ".join(f"{c}: {k.simpleString()}" for c, k in kinds.items())
    return F.array(*entries).cast(f"array<struct<catalogue_ord: int, {kind}>>")


def _field_names(fields: DataFrame) -> Column:
    return first_truthy(*[F.col(c) for c in ("field", "field_name") if c in fields.columns])


def checks_for_fields(fields: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Check queries of each field row.

    A field meets every check whose id, name or terms contain it; without one it
    gets a check of its own.  Field names repeat over all labels, so the
    substring test runs once per distinct name, against the catalogue as a
    constant, and the result is joined back.
    """
    spark = fields.sparkSession
    checks = check_catalogue(spark) if catalogue is None else catalogue
    named = fields.withColumn("field", _field_names(fields)).filter(truthy(F.col("field")).isNotNull())
    names = named.select("field").distinct()
    low = F.lower(F.col("field"))

    def test(c: Column) -> Column:
        return (
            F.contains(F.lower(c["check_id"]), low) | F.contains(F.lower(c["requirement_name"]), low)
            | F.exists(c["query_terms"], lambda t: F.contains(F.lower(t), low)))

    entries = _constant(checks, ["check_id", "requirement_name", "check_type", "query_terms"])
    hits = names.select("field", F.explode_outer(F.filter(entries, test)).alias("_c")).select("field", "_c.*")
    found = F.col("check_id").isNotNull()
    mapped = hits.select(
        "field",
        F.when(found, F.col("check_id")).otherwise(F.concat(F.lit("LM_"), F.upper("field"), F.lit("_001"))).alias("check_id"),
        F.lit("legal_metrology").alias("domain"),
        F.when(found, F.coalesce("check_type", F.lit("presence"))).otherwise(F.lit("presence")).alias("check_type"),
        F.when(found, F.coalesce("query_terms", F.array("field"))).otherwise(
            F.array("field", F.lit("declaration"), F.lit("pre-packaged commodity"))).alias("query_terms"),
        F.coalesce("catalogue_ord", F.lit(0)).alias("catalogue_ord"),
    )
    if "commodity_type" not in named.columns:
        named = named.withColumn("commodity_type", F.lit("pre_packaged_commodity"))
    return named.join(mapped, "field")


def structured_query(check_id: Column, field: Column, query_terms: Column, commodity: Column | None = None,
                     check_type: Column | None = None) -> Column:
    """One structured compliance query with its defaults."""
    return F.struct(
        check_id.alias("check_id"),
        F.lit("legal_metrology").alias("domain"),
        F.coalesce(commodity if commodity is not None else F.lit(None), F.lit("pre_packaged_commodity")).alias("commodity_type"),
        field.alias("field"),
        F.coalesce(check_type if check_type is not None else F.lit(None), F.lit("presence")).alias("check_type"),
        F.when(F.size(query_terms) > 0, query_terms).otherwise(
            F.array(field, F.lit("pre-packaged commodity"), F.lit("declaration"))).alias("query_terms"),
    )


def field_queries(fields: DataFrame, keys: list[str], prefix: str = "chk_") -> DataFrame:
    """Field queries in the first layout: id, field, value; fields without a name or value are skipped."""
    value = first_truthy(*[F.col(c) for c in ("normalized_value", "raw_text") if c in fields.columns])
    named = fields.withColumn("field_name", _field_names(fields)).withColumn("field_value", value)
    kept = named.filter(truthy(F.col("field_name")).isNotNull() & F.col("field_value").isNotNull())
    ident = stable_id(prefix, *[F.col(k) for k in keys], F.col("field_name"))
    return kept.select(*keys, ident.alias("query_id"), "commodity_type", "field_name", "field_value")


def fssai_queries(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Food-domain field queries; the value is a constant placeholder."""
    named = fields.withColumn("field_name", _field_names(fields)).filter(truthy(F.col("field_name")).isNotNull())
    ident = stable_id("fssai_", *[F.col(k) for k in keys], F.col("field_name"))
    return named.select(
        *keys, ident.alias("query_id"), F.coalesce("commodity_type", F.lit("food")).alias("commodity_type"),
        "field_name", F.lit("val").alias("field_value"), F.lit("fssai").alias("domain"))


def rules_for_fields(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose id or a keyword contains the field name."""
    low = F.lower(F.col("field_name"))

    def test(r: Column) -> Column:
        return F.contains(F.lower(r["rule_id"]), low) | F.exists(r["keywords"], lambda k: F.contains(F.lower(k), low))

    entries = _constant(rules, [c for c in rules.columns if c != "catalogue_ord"])
    names = fields.select("field_name").distinct()
    hits = names.select("field_name", F.explode(F.filter(entries, test)).alias("_r"))
    return fields.join(hits.select("field_name", *[F.col(f"_r.{c}").alias(c) for c in rules.columns]), "field_name")


def check_by_id(ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The first catalogue entry of each id, or nulls."""
    first = catalogue.groupBy("check_id").agg(
        F.min_by(F.struct(*[c for c in catalogue.columns if c != "check_id"]), "catalogue_ord").alias("_c"))
    return ids.join(small_side(first), "check_id", "left").select(*ids.columns, "_c.*")


def add_rule(rules: DataFrame, rule_id: str, rule_name: str, rule_number: str, mandatory: bool, description: str,
             keywords: list[str]) -> DataFrame:
    row = rules.sparkSession.createDataFrame(
        [(rule_id, rule_name, rule_number, mandatory, description, keywords)], RULE)
    at = rules.agg(F.coalesce(F.max("catalogue_ord") + 1, F.lit(0)).alias("at")).scalar()
    return rules.unionByName(row.withColumn("catalogue_ord", at.cast("int")))


def domains_of(commodity: Column) -> Column:
    """Domains consulted for a commodity, in order."""
    return F.array_compact(F.array(*[
        F.lit(d) if c is None else F.when(commodity == c, F.lit(d)) for d, c in lim.DOMAIN_ROUTES]))


def route(queries: DataFrame, commodity: str = "commodity_type") -> DataFrame:
    """One row per query and consulted domain, unfolded inside the row."""
    return queries.select("*", F.posexplode(domains_of(F.col(commodity))).alias("domain_ord", "routed_domain"))


# ---------------------------------------------------------------- catalogue checks


def has_keys(entry: Column, keys: list[str]) -> Column:
    """Whether a map entry carries every required key."""
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), F.map_keys(entry))) == 0


def valid_rule(entry: Column) -> Column:
    return has_keys(entry, cat.RULE_KEYS)


def valid_check(entry: Column, sources: Column) -> Column:
    """A check needs its keys and at least one complete legal source."""
    complete = F.forall(sources, lambda s: has_keys(s, cat.CHECK_SOURCE_KEYS))
    return has_keys(entry, cat.CHECK_KEYS) & F.coalesce((F.size(sources) > 0) & complete, F.lit(False))


def every_valid(flag: Column) -> Column:
    return F.coalesce(F.bool_and(flag), F.lit(True))


def content_consistent(text: Column, requirement: Column) -> Column:
    """Whether a chunk's text speaks about a requirement; any longer text also counts."""
    low, req = F.lower(text), F.lower(requirement)
    pairs = [F.contains(req, F.lit(word)) & contains_any(low, confirm) for word, confirm in lim.CONSISTENCY_WORDS]
    return reduce(lambda a, b: a | b, pairs) | (F.length(text) > lim.CONSISTENCY_MIN_CHARS)


def _inside_each_other(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | F.contains(a, b) | F.contains(b, a)


_PART = ("sub_rule", "clause")


def _inner(c: Column, longest: Column) -> Column:
    """Every part of a string, up to a length."""
    starts = F.sequence(F.lit(1), F.char_length(c))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(longest, F.char_length(c) - i + 1)), lambda n: F.substring(c, i, n)))))


def _marked(mark: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(mark), x))


def _chunk_keys(c: Column, longest: int) -> Column:
    """Keys of a chunk's part: all targets without one, itself, and whatever lies inside it."""
    whole = F.array(F.lit("*"), F.concat(F.lit("="), c))
    return F.when(c.isNull(), F.array(F.lit("*"), F.lit("0"))).otherwise(F.concat(whole, _marked("<", _inner(c, F.lit(longest)))))


def _target_keys(c: Column) -> Column:
    """Keys a target's part looks under: chunks without one, chunks it lies inside of, and chunks inside it."""
    whole = F.array(F.lit("0"), F.concat(F.lit("<"), c))
    return F.when(c.isNull(), F.array(F.lit("*"))).otherwise(F.concat(whole, _marked("=", _inner(c, F.char_length(c)))))


def _unfolded(df: DataFrame, **keys: Column) -> DataFrame:
    for name, values in keys.items():
        df = df.withColumn(name, F.explode(values))
    return df


def _first_without_rule(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """First chunk of every target without a rule: (check_id, ord).

    Such a target meets chunks of every rule.  Chunk classes are filed under
    the keys they can be asked by, the first one per key stays (a ``min``,
    combined map-side), and targets look their keys up: no pair of a target
    and a chunk is ever formed.
    """
    lengths = [F.max(F.char_length(f"t_{c}")).alias(c) for c in _PART]
    longest = targets.agg(*lengths).head()
    tolerance = lim.PAGE_TOLERANCE
    start, end, page = F.col("page_start"), F.col("page_end"), F.col("page")
    around = F.sequence(start - tolerance, start + tolerance)
    pages = F.when(end >= start, F.array_union(F.sequence(start, end), around)).otherwise(around)
    on_pages = F.when(F.coalesce(start, F.lit(0)) == 0, F.array(F.lit("*"), F.lit("0"))).otherwise(
        F.concat(F.array(F.lit("*")), F.transform(pages, lambda p: F.concat(F.lit("p"), p.cast("string")))))
    asked_pages = F.when(F.coalesce(page, F.lit(0)) == 0, F.array(F.lit("*"))).otherwise(
        F.array(F.lit("0"), F.concat(F.lit("p"), page.cast("string"))))
    names = ["_sub", "_clause", "_page"]
    filed = _unfolded(classes.groupBy("c_sub_rule", "c_clause", "page_start", "page_end").agg(F.min("ord").alias("ord")),
                      _sub=_chunk_keys(F.col("c_sub_rule"), longest["sub_rule"] or 0),
                      _clause=_chunk_keys(F.col("c_clause"), longest["clause"] or 0), _page=on_pages)
    asked = _unfolded(targets, _sub=_target_keys(F.col("t_sub_rule")), _clause=_target_keys(F.col("t_clause")), _page=asked_pages)
    first = filed.groupBy(*names).agg(F.min("ord").alias("ord"))
    return first.join(small_side(asked.select("check_id", *names)), names).groupBy("check_id").agg(F.min("ord").alias("ord"))


def validate_catalogue(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Match each target citation with the first fitting chunk.

    targets: check_id, requirement_name, rule, sub_rule, clause, page.
    chunks: chunk_id, insert_ord, rule, sub_rule, clause, page_start, page_end, text.
    Strict fit first (rule, compatible sub-rule and clause, page within two),
    else the first chunk of the same rule.  A target without a rule fits chunks
    of every rule and has no second try.

    Chunks that agree in rule, sub-rule, clause and pages are one class with its
    first place, so what is joined and compared are classes, and both tries are
    decided on places.  Texts are read for the chosen chunks alone.
    """
    wanted = targets.select(
        *[c for c in targets.columns if c not in ("rule", "sub_rule", "clause")],
        *[truthy(strip(F.col(c).cast("string"))).alias(f"t_{c}") for c in ("rule", "sub_rule", "clause")])
    filed = chunks.select(
        "chunk_id", "insert_ord", "text", "page_start", "page_end",
        *[truthy(strip(F.col(c).cast("string"))).alias(f"c_{c}") for c in ("rule", "sub_rule", "clause")])
    classes = filed.groupBy("c_rule", "c_sub_rule", "c_clause", "page_start", "page_end").agg(
        F.min(F.struct("insert_ord", "chunk_id")).alias("ord"))
    start, end, page = F.col("page_start"), F.col("page_end"), F.col("page")
    no_page = F.coalesce(page, F.lit(0)).eqNullSafe(F.lit(0)) | F.coalesce(start, F.lit(0)).eqNullSafe(F.lit(0))
    near = no_page | F.coalesce(page.between(start, end), F.lit(False)) | (F.abs(start - page) <= lim.PAGE_TOLERANCE)
    strict = (
        _inside_each_other(F.col("t_sub_rule"), F.col("c_sub_rule"))
        & _inside_each_other(F.col("t_clause"), F.col("c_clause")) & near)
    pairs = small_side(wanted).join(classes, F.col("t_rule") == F.col("c_rule"))
    ruled = pairs.groupBy("check_id").agg(F.min(F.struct(F.when(strict, F.lit(1)).otherwise(F.lit(2)).alias("tier"), "ord")).alias("_b"))
    free = _first_without_rule(wanted.where("t_rule IS NULL"), classes).select(
        "check_id", F.struct(F.lit(1).alias("tier"), "ord").alias("_b"))
    chosen = ruled.unionByName(free).groupBy("check_id").agg(F.min("_b").alias("_b")).select(
        "check_id", "_b.tier", "_b.ord.insert_ord", "_b.ord.chunk_id")
    read = filed.select("insert_ord", "chunk_id", "text").join(small_side(chosen), ["insert_ord", "chunk_id"])
    best = read.groupBy("check_id").agg(F.min(F.struct("chunk_id", "tier", "text")).alias("_m"))
    out = wanted.join(best, "check_id", "left")
    found = F.col("_m").isNotNull()
    agrees = content_consistent(F.lower(F.col("_m.text")), F.col("requirement_name"))
    return out.select(
        "check_id", "requirement_name",
        F.col("t_rule").alias("rule"), F.col("t_sub_rule").alias("sub_rule"), F.col("t_clause").alias("clause"), "page",
        F.when(~found, F.lit("NOT_FOUND")).when(agrees, F.lit("MATCHED")).otherwise(F.lit("MISMATCH")).alias("status"),
        F.col("_m.chunk_id").alias("matched_chunk_id"),
        F.col("_m.tier").alias("tier"),
        F.when(~found, F.concat(
            F.lit("No chunk found matching Rule "), F.coalesce("t_rule", F.lit("None")),
            F.lit(", Sub "), F.coalesce("t_sub_rule", F.lit("None")),
            F.lit(", Clause "), F.coalesce("t_clause", F.lit("None")),
            F.lit(", Page "), F.coalesce(page.cast("string"), F.lit("None"))))
        .when(agrees, F.lit("Metadata and requirement text content are fully consistent"))
        .otherwise(F.concat(
            F.lit("Chunk metadata matched but content '"), F.substring(F.lower(F.col("_m.text")), 1, 100),
            F.lit("...' is inconsistent with requirement '"), F.col("requirement_name"), F.lit("'"))).alias("reason"),
    )


def validation_summary(details: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    matched = F.count_if(F.col("status") == "MATCHED")
    return details.agg(
        n.alias("total_checks"), matched.alias("matched"),
        F.count_if(F.col("status") == "MISMATCH").alias("mismatch"),
        F.count_if(F.col("status") == "NOT_FOUND").alias("not_found"),
        F.when(n > 0, matched / n).otherwise(F.lit(0.0)).alias("pass_rate"),
    )
