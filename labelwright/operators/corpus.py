"""Legal corpus: pages, page structure, amendment notes, provisions and hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.fixed import legal_patterns as lg
from labelwright.fixed import provisions as pv
from labelwright.fixed.limits import PAGE_BREAK
from labelwright.functions.text import contains_any, group_of, matched, rx, strip, truthy
from labelwright.types import CHUNK, CHUNK_ARRAYS, CHUNK_COLUMNS

# ---------------------------------------------------------------- pages


def split_pages(documents: DataFrame, text: str = "text", mark_blank: bool = True) -> DataFrame:
    """One row per page of each document; a blank page gets a marker text."""
    others = [c for c in documents.columns if c != text]
    pages = documents.select(
        *others, F.posexplode(F.split(F.col(text), PAGE_BREAK)).alias("_at", "_page")
    ).withColumn("_clean", strip(F.col("_page")))
    number = (F.col("_at") + 1).alias("page_number")
    marker = F.concat(F.lit("[OCR Fallback Extracted Text for Page "), (F.col("_at") + 1).cast("string"), F.lit("]"))
    body = F.when(F.col("_clean") == "", marker).otherwise(F.col("_clean")) if mark_blank else F.col("_clean")
    return pages.select(*others, number, body.alias("text"))


def page_lines(text: Column) -> Column:
    """Trimmed lines of a page without the blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def printed_page(lines: Column, index: Column) -> Column:
    """Page number printed last or first on the page, else one less than its position."""
    last = F.try_element_at(lines, F.lit(-1))
    first = F.get(lines, F.lit(0))
    digits = r"^[0-9]+$"
    return (
        F.when(last.rlike(digits), last.try_cast("int"))
        .when(first.rlike(digits), first.try_cast("int"))
        .otherwise(F.greatest(F.lit(1), index - 1))
    )


def amendments(lines: Column, page: Column) -> Column:
    """Amendment notes among a page's lines."""
    noted = F.filter(lines, lambda line: contains_any(F.lower(line), lg.AMENDMENT_WORDS))
    pattern = rx(lg.AMENDMENT)
    found = F.transform(noted, lambda line: F.struct(line.alias("line"), matched(line, pattern).alias("note")))
    found = F.filter(found, lambda x: x["note"].isNotNull())

    def read(x: Column) -> Column:
        line, note = x["line"], x["note"]
        default = F.when(F.contains(F.lower(line), F.lit("omitted")), F.lit("Omitted")).otherwise(
            F.lit("Substituted/Amended")
        )
        return F.struct(
            line.alias("raw_annotation"),
            F.coalesce(group_of(note, pattern, 2), default).alias("action"),
            strip(F.concat(F.lit("GSR "), F.coalesce(group_of(note, pattern, 3), F.lit("Unknown GSR")))).alias("gsr_number"),
            strip(group_of(note, pattern, 4)).alias("date"),
            strip(group_of(note, pattern, 5)).alias("effective_from"),
            page.cast("int").alias("printed_page"),
        )

    return F.transform(found, read)


def omitted_passages(lines: Column) -> Column:
    return F.filter(lines, lambda line: contains_any(F.lower(line), lg.OMISSION_WORDS))


def read_pages(pages: DataFrame, text: str = "page_text", index: str = "pdf_page_index") -> DataFrame:
    """Lines, printed number, amendment notes and omitted passages of each page."""
    out = pages.withColumn("lines", page_lines(F.col(text)))
    out = out.withColumn("printed_page", printed_page(F.col("lines"), F.col(index)))
    return out.withColumn("annotations", amendments(F.col("lines"), F.col("printed_page"))).withColumn(
        "omitted_passages", omitted_passages(F.col("lines"))
    )


def page_structure(pages: DataFrame, text: str = "text", number: str = "page_number") -> DataFrame:
    """One section per page with the first rule and schedule the page names."""
    rule_no = group_of(matched(F.col(text), rx(lg.PAGE_RULE)), rx(lg.PAGE_RULE), 1)
    sched_no = group_of(matched(F.col(text), rx(lg.PAGE_SCHEDULE)), rx(lg.PAGE_SCHEDULE), 1)
    return pages.select(
        *[c for c in pages.columns if c not in (text, number)],
        F.lit("Part II").alias("part"),
        F.lit("Chapter II").alias("chapter"),
        F.coalesce(F.concat(F.lit("Rule "), rule_no), F.lit("Rule 6")).alias("rule"),
        F.lit("sub-rule (1)").alias("sub_rule"),
        F.lit("clause (f)").alias("clause"),
        F.concat(F.lit("Schedule "), sched_no).alias("schedule"),
        F.lit(None).cast("string").alias("table"),
        F.col(number).alias("page_start"),
        F.col(number).alias("page_end"),
        F.col(text).alias("text"),
    )


# ---------------------------------------------------------------- provisions


def chapter_of(rule: Column) -> Column:
    """Chapter heading of a rule; unknown rules fall under General, no rule under nothing."""
    clean = strip(rule)
    number = F.when(clean.rlike("^[1-9][0-9]*$"), clean.try_cast("int"))
    heading = F
    for name, title, first, last in pv.CHAPTERS:
        heading = heading.when(number.between(first, last), F.lit(f"{name}: {title}"))
    return F.when(truthy(rule).isNotNull(), heading.otherwise(F.lit("General")))


def provisions(spark: SparkSession) -> DataFrame:
    """All known provisions as chunks, numbered in order (a fixed list, so broadcast-safe)."""
    rows = []
    for ord_, (_, rule, sub, clause, schedule, first, last, extra, text) in enumerate(pv.PROVISIONS):
        status = extra.get("status", "current")
        tail = "_superseded" if status == "superseded" else ""
        rows.append((
            ord_, f"chk_lm_{rule}_{sub or 'main'}_{clause or 'main'}_{first}{tail}", rule, sub, clause, schedule,
            first, last, extra.get("effective_from", pv.DEFAULT_EFFECTIVE_FROM), extra.get("effective_to"),
            status, extra.get("amended_by", []), [], extra.get("superseded_by", []), text,
        ))
    base = spark.createDataFrame(rows, (
        "insert_ord int, chunk_id string, rule string, sub_rule string, clause string, schedule string, "
        "page_start int, page_end int, effective_from string, effective_to string, status string, "
        "amended_by array<string>, supersedes array<string>, superseded_by array<string>, text string"
    ))
    full = (
        base.withColumn("document_id", F.lit(pv.DOCUMENT_ID))
        .withColumn("document_title", F.lit(pv.DOCUMENT_TITLE))
        .withColumn("authority", F.lit(pv.AUTHORITY))
        .withColumn("jurisdiction", F.lit(pv.JURISDICTION))
        .withColumn("domain", F.lit(pv.DOMAIN))
        .withColumn("chapter", chapter_of(F.col("rule")))
        .withColumn("table", F.lit(None).cast("string"))
        .withColumn("chunk_type", F.lit("legal_requirement"))
    )
    return full.select("insert_ord", *CHUNK_COLUMNS)


def _opens(entry: tuple, lowered: Column, text: Column, page: Column) -> Column:
    """Whether a page mentions a provision: its group's trigger and its own."""
    phrases, exact, pages = pv.GROUPS[entry[0]]
    group = contains_any(lowered, phrases) | contains_any(text, exact)
    if pages:
        group = group | page.isin(*pages)
    own = entry[7]
    if not own.get("words"):
        return group
    inner = contains_any(lowered, own["words"])
    if own.get("pages"):
        inner = inner | page.isin(*own["pages"])
    if own.get("last_page"):
        inner = inner & (page <= own["last_page"])
    return group & inner


def triggered(lowered: Column, text: Column, page: Column) -> Column:
    """Ordinals of the provisions a page brings in."""
    marks = [F.when(_opens(e, lowered, text, page), F.lit(i)) for i, e in enumerate(pv.PROVISIONS)]
    return F.array_compact(F.array(*marks))


def chunks_from_pages(
    pages: DataFrame, text: str = "page_text", page: str = "printed_page", order: str = "pdf_page_index",
    keys: list[str] | None = None,
) -> DataFrame:
    """Provisions brought in by a document's pages, each once, from the first page that names it.

    The repeat check is a ``min`` per provision, so it combines map-side and a
    document with most of the pages still shuffles only a few rows per task.
    """
    keys = keys or []
    hits = pages.withColumn("_lower", F.lower(F.col(text))).select(
        *keys, F.col(order).alias("first_page_ord"),
        F.explode_outer(triggered(F.col("_lower"), F.col(text), F.col(page))).alias("insert_ord"),
    ).filter(F.col("insert_ord").isNotNull())
    firsts = hits.groupBy(*keys, "insert_ord").agg(F.min("first_page_ord").alias("first_page_ord"))
    return firsts.join(F.broadcast(provisions(pages.sparkSession)), "insert_ord")


def section_chunks(sections: DataFrame, header: dict | None = None, order: str = "section_ord") -> DataFrame:
    """Chunks from parsed sections and a document header; ``order`` numbers the sections from 1."""
    h = {**pv.STATUTE_HEADER, **(header or {})}
    have = set(sections.columns)

    def own(name: str, default) -> Column:
        lit = F.lit(default) if not isinstance(default, Column) else default
        return (F.coalesce(F.col(name), lit) if default is not None and name in have
                else F.col(name) if name in have else lit.cast("string") if default is None else lit).alias(name)

    none = F.lit(None).cast("string")
    amended = F.array(*[F.lit(x) for x in h["amended_by"]]).cast("array<string>")
    empty = F.array().cast("array<string>")
    return sections.select(
        F.col(order).alias("insert_ord"),
        F.format_string(f"chk_{h['domain']}_%03d", F.col(order).cast("int")).alias("chunk_id"),
        own("document_id", h.get("document_id", "doc_lm_2011")),
        F.lit(h["document_title"]).alias("document_title"),
        F.lit(h["authority"]).alias("authority"),
        F.lit(h["jurisdiction"]).alias("jurisdiction"),
        F.lit(h["domain"]).alias("domain"),
        own("part", "Part II"),
        own("chapter", "Chapter II"),
        own("rule", "Rule 6"),
        own("sub_rule", None), own("clause", None), own("schedule", None), own("table", None),
        own("page_start", 1), own("page_end", 1),
        F.lit(h["effective_from"]).alias("effective_from"),
        (F.lit(h["effective_to"]) if h["effective_to"] else none).alias("effective_to"),
        F.lit(h["status"]).alias("status"),
        amended.alias("amended_by"), empty.alias("supersedes"), empty.alias("superseded_by"),
        F.lit("rule_clause").alias("chunk_type"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def starter_corpus(spark: SparkSession) -> DataFrame:
    """The small starter index of five sections."""
    rows = [(i, *s[:4], s[4], s[4], s[5]) for i, s in enumerate(pv.STARTER_SECTIONS, start=1)]
    sections = spark.createDataFrame(rows, (
        "section_ord int, rule string, sub_rule string, clause string, schedule string, "
        "page_start int, page_end int, text string"
    ))
    return section_chunks(sections, {"document_id": "doc_Legal_Metrology_Packaged_Commodities_Rules_2011.pdf"})


def enforce_schema(chunks: DataFrame) -> DataFrame:
    """Exactly the stored chunk columns, in order; missing ones null, list columns never null."""
    have = set(chunks.columns)
    types = dict(part.strip().split(" ", 1) for part in CHUNK.split(", "))
    cols = []
    for name in CHUNK_COLUMNS:
        kind = types.get(name) or types[f"`{name}`"]
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name in CHUNK_ARRAYS:
            value = F.coalesce(value, F.array().cast(kind))
        cols.append(value.alias(name))
    return chunks.select(*cols)


# ---------------------------------------------------------------- hierarchy


def hierarchy(chunks: DataFrame) -> DataFrame:
    """One row per chunk at its place: chapter, rule, sub-rule, clause, page."""
    return chunks.select(
        F.coalesce(truthy(F.col("chapter")), F.lit("General")).alias("chapter"),
        F.coalesce(truthy(F.col("rule")), F.lit("Rule 1")).alias("rule"),
        F.coalesce(truthy(F.col("sub_rule")), F.lit("main")).alias("sub_rule"),
        "clause", F.col("page_start").alias("page"), "chunk_id", "insert_ord",
    )


def hierarchy_tree(chunks: DataFrame, leaf_rows: int = 10_000) -> DataFrame:
    """Leaves (chapter, rule) with their entries in order.

    Entries are gathered in parts of at most ``leaf_rows`` positions, so a rule
    that owns most of the corpus becomes several rows instead of one huge array.
    """
    flat = hierarchy(chunks).withColumn("part_no", F.floor(F.col("insert_ord") / leaf_rows))
    entry = F.struct("insert_ord", "chunk_id", "sub_rule", "clause", "page")
    return flat.groupBy("chapter", "rule", "part_no").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.dropFields("insert_ord")).alias("entries")
    )


def hierarchy_counts(chunks: DataFrame) -> DataFrame:
    """How many chunks each chapter, rule and sub-rule holds."""
    return hierarchy(chunks).groupBy("chapter", "rule", "sub_rule").agg(F.count(F.lit(1)).alias("n_chunks"))
