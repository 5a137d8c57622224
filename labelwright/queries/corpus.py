"""Registered queries: pages, amendment notes, provisions, index upkeep and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.fixed import provisions as pv
from labelwright.fixed.limits import PAGE_BREAK
from labelwright.functions.citations import reference
from labelwright.functions.embed import codepoint_embedder
from labelwright.functions.pages import register_pages
from labelwright.operators import corpus as cp
from labelwright.operators import index as ix
from labelwright.queries.tables import case, table, text


def page_split(spark, d):
    """Every line of a document as a page."""
    docs = table(spark, d, "documents", even=True).select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("---PAGE_BREAK---")).alias("text"))
    pages = cp.split_pages(docs)
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("n_chars"),
        F.count_if(F.col("text").startswith("[OCR Fallback")).alias("n_blank"))


def page_lateral(spark, d):
    """Every sentence of a document as a page, by the table function in a lateral join."""
    register_pages(spark)
    docs = table(spark, d, "documents", even=True).select("doc_id", F.replace("text", F.lit(". "), F.lit(PAGE_BREAK)).alias("text"))
    pages = spark.sql("SELECT d.doc_id, p.page_number, p.text FROM {docs} AS d, LATERAL pages_of(d.text) AS p", docs=docs)
    return pages.groupBy("doc_id").agg(
        F.max("page_number").cast("long").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"),
        F.min_by("text", "page_number").alias("first_page"))


def printed_page(spark, d):
    key = F.col("doc_id")
    body = F.when(key % 3 == 0, text(F.col("text"), "\n\n  ", key % 50, " \n")).when(
        key % 3 == 1, text(key % 40 + 100, "\n", F.col("text"))).otherwise(F.col("text"))
    lines = table(spark, d, "documents", even=True).select("doc_id", cp.page_lines(body).alias("lines"))
    return lines.select(
        "doc_id", F.size("lines").alias("n_lines"),
        cp.printed_page(F.col("lines"), F.col("doc_id").cast("int")).alias("printed_page"))


def amendment_parse(spark, d):
    status = F.col("o_orderstatus")
    action = F.when(status == "F", F.lit("Substituted ")).when(status == "O", F.lit("#4 Omitted ")).otherwise(F.lit(""))
    line = text(action, "vide G.S.R. ", F.col("o_orderkey"), "(E) dated ", F.date_format("o_orderdate", "dd"), " June 2017")
    wef = text("Inserted vide GSR ", F.col("o_custkey"), "(E) dated 7, w.e.f. 01.01.2018")
    page = text(line, "\nplain line\n", wef, "\nclause omitted by notice")
    rows = table(spark, d, "orders").select("o_orderkey", cp.page_lines(page).alias("lines"))
    read = rows.select("o_orderkey", F.size(cp.omitted_passages(F.col("lines"))).alias("n_omitted"),
                       F.explode_outer(cp.amendments(F.col("lines"), F.lit(5))).alias("a"))
    return read.select("o_orderkey", "n_omitted", "a.action", "a.gsr_number", "a.date",
                       F.coalesce("a.effective_from", F.lit("")).alias("effective_from"), "a.printed_page")


def page_structure(spark, d):
    key = F.col("o_orderkey")
    pages = table(spark, d, "orders").select("o_orderkey", key.alias("page_number"), text(
        "Some text. ", F.when(key % 3 == 0, text("RULE  ", F.col("o_custkey"), ". ")).otherwise(F.lit("")),
        F.when(key % 4 == 0, F.lit("see Schedule VII")).otherwise(F.lit("no table"))).alias("text"))
    return cp.page_structure(pages).select(
        "o_orderkey", "rule", F.coalesce("schedule", F.lit("")).alias("schedule"), "page_start", "page_end")


def provision_trigger(spark, d):
    """Provisions brought in by each source's documents, printed pages taken from the document number."""
    docs = table(spark, d, "documents", even=True).select(
        "source", "doc_id", (F.col("doc_id") % 40 + 1).cast("int").alias("printed_page"), "text")
    return cp.chunks_from_pages(docs, "text", "printed_page", "doc_id", ["source"]).select(
        "source", "chunk_id", "first_page_ord", "chapter", "status", "effective_from")


def _chunks(spark, d):
    """Orders as chunks: validity dates from the order date, status from the order status."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderkey").alias("insert_ord"),
        F.date_format(day, "yyyy-MM-dd").alias("effective_from"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_format(F.date_add(day, 180), "yyyy-MM-dd")).alias("effective_to"),
        case(F.col("o_orderkey") % 4, F.lit("current"), F.lit("Superseded"), F.lit("current"), F.lit(None)).alias("status"),
        "o_orderpriority", "o_orderstatus")


def validity_filter(spark, d):
    return ix.in_force(_chunks(spark, d), "1998-06-30").select("chunk_id")


def metadata_filter(spark, d):
    live = ix.with_status(_chunks(spark, d), "current")
    kept = ix.matching(live, {"o_orderpriority": "1-URGENT", "unknown_column": None})
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_chunks"))


def first_copy(spark, d):
    """The first document of each text; copies of one text combine before the shuffle."""
    docs = table(spark, d, "documents", even=True)
    return docs.groupBy(F.sha2("text", 256).alias("_k")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).drop("_k")


def schema_enforce(spark, d):
    chunks = cp.enforce_schema(_chunks(spark, d).withColumn("page_start", F.lit(3)))
    return chunks.select(
        "chunk_id", "effective_from", "page_start", F.size("amended_by").alias("n_amended"),
        F.col("table").isNull().alias("no_table"), F.lit(len(chunks.columns)).alias("n_columns"))


def section_chunks(spark, d):
    sections = table(spark, d, "customer").select(
        F.col("c_custkey").alias("section_ord"), F.concat(F.lit("Rule "), F.col("c_nationkey").cast("string")).alias("rule"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("sub_rule"), F.col("c_name").alias("text"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("page_start"))
    out = cp.section_chunks(sections, {"document_id": "doc_x", "domain": "lm"})
    return out.select("chunk_id", "document_id", "chapter", "rule", F.coalesce("sub_rule", F.lit("")).alias("sub_rule"),
                      "page_start", "page_end", "effective_from", "status", F.size("amended_by").alias("n_amended"))


def chapter_lookup(spark, d):
    parts = table(spark, d, "part")
    rule = F.when(F.col("p_partkey") % 9 == 0, F.lit("x1")).otherwise(text(" ", F.col("p_size")))
    return parts.groupBy(cp.chapter_of(rule).alias("chapter")).agg(F.count(F.lit(1)).alias("n_rules"))


def _customer_chunks(spark, d):
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("chapter"), F.col("n_name").alias("rule"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("sub_rule"), F.lit(None).cast("string").alias("clause"),
        F.lit(1).alias("page_start"), F.col("c_custkey").cast("string").alias("chunk_id"), F.col("c_custkey").alias("insert_ord"))


def hierarchy_counts(spark, d):
    return cp.hierarchy_counts(_customer_chunks(spark, d))


def hierarchy_tree(spark, d):
    tree = cp.hierarchy_tree(_customer_chunks(spark, d), leaf_rows=1000)
    e = F.col("entries")
    return tree.select(
        "chapter", "rule", "part_no", F.size(e).alias("n_entries"), e[0]["chunk_id"].alias("first_chunk"),
        F.element_at(e, -1)["chunk_id"].alias("last_chunk"), e[0]["sub_rule"].alias("first_sub_rule"))


def legal_reference_parse(spark, d):
    n, m = F.col("o_custkey") % 40, F.col("o_orderkey") % 9
    letter = F.substring("o_orderstatus", 1, 1)
    words = case(
        F.col("o_orderkey") % 8,
        text("See Rule ", n, "(", m, ")(", letter, ") of the Act"), text("rule ", n, " ( ", m, " )"),
        text("RULE ", n, "(", letter, ")"), text("under rule ", n, " and section ", m, "(", n, ")"),
        text("Schedule ", m, " sizes"), text("the Third Schedule and Section ", n), text("24(a) alone ", n), F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", reference(words).alias("r")).select(
        "o_orderkey", *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("rule", "sub_rule", "clause", "section", "schedule")],
        "r.explicit_provision", F.size("r.raw_matches").alias("n_matches"))


def mock_embedding(spark, d):
    e = table(spark, d, "documents", even=True).select("doc_id", codepoint_embedder()(F.col("text")).alias("v"))
    return e.select("doc_id", F.round(F.col("v")[0].cast("double"), 4).alias("value"), F.size("v").alias("dimension"))


def unit_vectors(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", ix.unit_vector(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("u"), "embedding")
    gap = F.aggregate(F.zip_with("u", "embedding", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0),
                      lambda worst, x: F.greatest(worst, x))
    return e.select("vec_id", F.size("u").alias("dimension"), (gap < 1e-5).alias("same_direction"))


def index_upsert_delete(spark, d):
    """A store of vectors, a batch that replaces label 0 and adds new ids, then a deletion of label 9."""
    e = table(spark, d, "embeddings")
    store = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("insert_ord"), "label",
                     "embedding", F.lit("old").alias("version"))
    again = e.filter("label = 0").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("batch_ord"),
                                         "label", "embedding", F.lit("new").alias("version"))
    added = e.filter("label = 1").select(F.lit(None).cast("string").alias("chunk_id"), F.col("vec_id").alias("batch_ord"),
                                         F.lit(77).alias("label"), F.lit(None).cast("array<float>").alias("embedding"),
                                         F.lit("added").alias("version"))
    out = ix.delete(ix.upsert(store, again.unionByName(added)), store.filter("label = 9"))
    return out.groupBy("version", "label").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids"),
        F.countDistinct("insert_ord").alias("n_places"), F.min(F.col("chunk_id").cast("bigint")).alias("first_id"))


def metadata_lookup(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    store = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), "o_orderstatus")
    return ix.lookup(store, ids).select("chunk_id", F.coalesce("o_orderstatus", F.lit("")).alias("status"))


def oldest_chunks(spark, d):
    """First-generation search: the k oldest rows at a constant score (the limit is the operator)."""
    store = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("insert_ord"))
    return ix.first_inserted(store, 5).select("o_orderkey", "score")


QUERIES = {
    "page_split": page_split,
    "page_lateral": page_lateral,
    "printed_page": printed_page,
    "amendment_parse": amendment_parse,
    "page_structure": page_structure,
    "provision_trigger": provision_trigger,
    "validity_filter": validity_filter,
    "metadata_filter": metadata_filter,
    "first_copy": first_copy,
    "schema_enforce": schema_enforce,
    "section_chunks": section_chunks,
    "chapter_lookup": chapter_lookup,
    "hierarchy_counts": hierarchy_counts,
    "hierarchy_tree": hierarchy_tree,
    "legal_reference_parse": legal_reference_parse,
    "mock_embedding": mock_embedding,
    "unit_vectors": unit_vectors,
    "index_upsert_delete": index_upsert_delete,
    "metadata_lookup": metadata_lookup,
    "oldest_chunks": oldest_chunks,
}

_CHAPTER = "CASE " + " ".join(
    f"WHEN {{0}} BETWEEN {a} AND {b} THEN '{n}: {t}'" for n, t, a, b in pv.CHAPTERS) + " ELSE 'General' END"
_CHUNKS = """
  SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS effective_from,
    CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 180 DAY, '%Y-%m-%d') END AS effective_to,
    CASE o_orderkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'Superseded' WHEN 2 THEN 'current' END AS status, o_orderpriority, o_orderstatus FROM orders
"""
_GEO = """
  SELECT r_name AS chapter, n_name AS rule, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'main' END AS sub_rule, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _any(column: str, words: list[str]) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


def _trigger(entry) -> str:
    phrases, exact, pages = pv.GROUPS[entry[0]]
    group = _any("low", phrases)
    if exact:
        group += " OR " + _any("text", exact)
    if pages:
        group += f" OR p IN ({', '.join(map(str, pages))})"
    own = entry[7]
    if not own.get("words"):
        return f"({group})"
    inner = _any("low", own["words"])
    if own.get("pages"):
        inner += f" OR p IN ({', '.join(map(str, own['pages']))})"
    if own.get("last_page"):
        inner = f"({inner}) AND p <= {own['last_page']}"
    return f"({group}) AND ({inner})"


def _provision_sql() -> str:
    parts = []
    for e in pv.PROVISIONS:
        _, rule, sub, clause, _, first, _, extra, _ = e
        status = extra.get("status", "current")
        cid = f"chk_lm_{rule}_{sub or 'main'}_{clause or 'main'}_{first}" + ("_superseded" if status == "superseded" else "")
        parts.append(
            f"SELECT source, '{cid}' AS chunk_id, min(doc_id) AS first_page_ord, {_CHAPTER.format(rule)} AS chapter, '{status}' AS status, "
            f"'{extra.get('effective_from', pv.DEFAULT_EFFECTIVE_FROM)}' AS effective_from FROM d WHERE {_trigger(e)} GROUP BY source")
    return ("WITH d AS (SELECT source, doc_id, doc_id % 40 + 1 AS p, text, lower(text) AS low FROM documents) "
            + " UNION ALL ".join(parts))


ORACLE = {
    "page_split": r"""
        WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
        q AS (SELECT doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM p)
        SELECT doc_id, count(*) AS n_pages, CAST(sum(CASE WHEN line = '' THEN length('[OCR Fallback Extracted Text for Page ' || n || ']') ELSE length(line) END) AS BIGINT) AS n_chars,
          count(*) FILTER (line = '') AS n_blank FROM q GROUP BY doc_id""",
    "page_lateral": r"""
        WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS page, unnest(range(1, len(string_split(text, '. ')) + 1)) AS n FROM documents),
        q AS (SELECT doc_id, n, regexp_replace(page, '^\s+|\s+$', '', 'g') AS page FROM p),
        r AS (SELECT doc_id, n, CASE WHEN page = '' THEN '[OCR Fallback Extracted Text for Page ' || n || ']' ELSE page END AS page FROM q)
        SELECT doc_id, max(n) AS n_pages, CAST(sum(length(page)) AS BIGINT) AS n_chars, arg_min(page, n) AS first_page FROM r GROUP BY doc_id""",
    "printed_page": r"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents)
        SELECT doc_id, CAST(len(ls) + CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS INTEGER) AS n_lines,
          CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 50
               WHEN doc_id % 3 = 1 THEN CASE WHEN len(ls) > 0 AND regexp_matches(ls[-1], '^[0-9]+$') THEN CAST(ls[-1] AS BIGINT) ELSE doc_id % 40 + 100 END
               WHEN len(ls) > 0 AND regexp_matches(ls[-1], '^[0-9]+$') THEN CAST(ls[-1] AS BIGINT)
               WHEN len(ls) > 0 AND regexp_matches(ls[1], '^[0-9]+$') THEN CAST(ls[1] AS BIGINT)
               ELSE greatest(1, doc_id - 1) END AS INTEGER) AS printed_page FROM l""",
    "amendment_parse": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS n_omitted,
          CASE o_orderstatus WHEN 'F' THEN 'Substituted' WHEN 'O' THEN 'Omitted' ELSE 'Substituted/Amended' END AS action,
          'GSR ' || o_orderkey || '(E)' AS gsr_number, strftime(o_orderdate, '%d')[1:1] AS date, '' AS effective_from, 5 AS printed_page FROM orders
        UNION ALL
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END, 'Inserted', 'GSR ' || o_custkey || '(E)', '7', '01.01.2018', 5 FROM orders""",
    "page_structure": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Rule ' || o_custkey ELSE 'Rule 6' END AS rule,
          CASE WHEN o_orderkey % 4 = 0 THEN 'Schedule VII' ELSE '' END AS schedule, o_orderkey AS page_start, o_orderkey AS page_end FROM orders""",
    "provision_trigger": _provision_sql(),
    "validity_filter": f"""
        SELECT chunk_id FROM ({_CHUNKS}) WHERE lower(coalesce(status, 'current')) <> 'superseded' AND '1998-06-30' >= effective_from
          AND (effective_to IS NULL OR '1998-06-30' <= effective_to)""",
    "metadata_filter": f"""
        SELECT o_orderstatus, count(*) AS n_chunks FROM ({_CHUNKS}) WHERE status = 'current' AND o_orderpriority = '1-URGENT' GROUP BY 1""",
    "first_copy": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text",
    "schema_enforce": f"""
        SELECT chunk_id, effective_from, 3 AS page_start, 0 AS n_amended, true AS no_table, 22 AS n_columns FROM ({_CHUNKS})""",
    "section_chunks": """
        SELECT 'chk_lm_' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS chunk_id,
          'doc_x' AS document_id, 'Chapter II' AS chapter, 'Rule ' || c_nationkey AS rule, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS sub_rule,
          CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 1 END AS page_start, 1 AS page_end, '2011-03-01' AS effective_from, 'current' AS status, 1 AS n_amended
        FROM customer""",
    "chapter_lookup": f"""
        SELECT CASE WHEN p_partkey % 9 = 0 THEN 'General' ELSE {_CHAPTER.format('p_size')} END AS chapter, count(*) AS n_rules FROM part GROUP BY 1""",
    "hierarchy_counts": f"SELECT chapter, rule, sub_rule, count(*) AS n_chunks FROM ({_GEO}) GROUP BY 1, 2, 3",
    "hierarchy_tree": f"""
        SELECT chapter, rule, c_custkey // 1000 AS part_no, count(*) AS n_entries, CAST(min(c_custkey) AS VARCHAR) AS first_chunk,
          CAST(max(c_custkey) AS VARCHAR) AS last_chunk, arg_min(sub_rule, c_custkey) AS first_sub_rule FROM ({_GEO}) GROUP BY 1, 2, 3""",
    "legal_reference_parse": """
        WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS form, CAST(o_custkey % 40 AS VARCHAR) AS n, CAST(o_orderkey % 9 AS VARCHAR) AS m,
                     lower(o_orderstatus[1:1]) AS c FROM orders)
        SELECT o_orderkey, CASE WHEN form < 4 THEN n ELSE '' END AS rule,
          CASE form WHEN 0 THEN n || '(' || m || ')' WHEN 1 THEN n || '(' || m || ')' WHEN 2 THEN n || '(' || c || ')' ELSE '' END AS sub_rule,
          CASE form WHEN 0 THEN n || '(' || m || ')(' || c || ')' WHEN 2 THEN n || '(' || c || ')' ELSE '' END AS clause,
          CASE form WHEN 3 THEN m || '(' || n || ')' WHEN 5 THEN n ELSE '' END AS section,
          CASE form WHEN 4 THEN CASE WHEN CAST(m AS INT) BETWEEN 1 AND 7 THEN ['I','II','III','IV','V','VI','VII'][CAST(m AS INT)] ELSE m END
               WHEN 5 THEN 'III' ELSE '' END AS schedule,
          form < 6 AS explicit_provision, CASE form WHEN 3 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS n_matches
        FROM o""",
    "mock_embedding": """
        SELECT doc_id, round(coalesce(list_sum(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))), 0) % 100 / 100.0, 4) AS value,
          384 AS dimension FROM documents""",
    "unit_vectors": "SELECT vec_id, len(embedding) AS dimension, true AS same_direction FROM embeddings",
    "index_upsert_delete": """
        SELECT CASE WHEN label = 0 THEN 'new' ELSE 'old' END AS version, label, count(*) AS n_chunks, count(*) AS n_ids, count(*) AS n_places,
          min(vec_id) AS first_id FROM embeddings WHERE label <> 9 GROUP BY 1, 2
        UNION ALL
        SELECT 'added', 77, count(*), count(*), count(*), (SELECT count(*) FROM embeddings) + (SELECT min(p) FROM (SELECT label, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings WHERE label IN (0, 1)) WHERE label = 1) FROM embeddings WHERE label = 1""",
    "metadata_lookup": """
        SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(o_orderstatus, '') AS status FROM labels LEFT JOIN orders ON doc_id = o_orderkey""",
    "oldest_chunks": "SELECT o_orderkey, 0.88 AS score FROM orders ORDER BY o_orderkey LIMIT 5",
}
