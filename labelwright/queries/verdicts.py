"""Registered queries: verdicts, missing declarations, checks, routing and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.fixed import catalogues as cat
from labelwright.fixed.limits import CONSISTENCY_WORDS
from labelwright.operators import checks as ck
from labelwright.operators import contracts as ct
from labelwright.operators import decide as dc
from labelwright.operators import report as rp
from labelwright.plans import scan as sc
from labelwright.queries.labels import part_labels
from labelwright.queries.tables import SECONDS_SQL, case, money, seconds, table, text


def _fields(spark, d):
    """Order lines as extracted fields: seventh lines have no value, confidence falls with the discount."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_returnflag",
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_name"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(money("l_extendedprice")).alias("normalized_value"),
        F.lit("").alias("raw_text"), (F.lit(1.0) - F.col("l_discount") * 6).alias("confidence"))


def field_verdict(spark, d):
    judged = dc.judge_fields(_fields(spark, d), F.lit("Rule 6"))
    return judged.groupBy("l_returnflag", "field_name", "status").agg(
        F.count(F.lit(1)).alias("n_fields"), F.min(F.length("reason")).alias("shortest_reason"))


def package_verdict(spark, d):
    judged = dc.judge_fields(_fields(spark, d))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return dc.package_status(judged, ["l_orderkey"], orders)


def missing_mandatory(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.floor(seconds() / 86400).cast("bigint"))
    value = F.when(F.col("value") > 5, F.col("value"))
    return dc.missing_rows(
        rows, ["user_id", "day"], "event_type", value, ["view", "click", "purchase", "refund"]
    ).select("user_id", "day", "missing_field", F.col("missing_ord").cast("int").alias("missing_ord"))


def issue_report(spark, d):
    scanned = sc.scan_labels(part_labels(table(spark, d, "part", even=True)))
    issues = rp.issue_rows(F.col("issues"))
    flat = scanned.select(F.explode_outer(issues).alias("i")).select("i.*")
    return flat.groupBy("title", "officer_action", "statutory_section").agg(
        F.count(F.lit(1)).alias("n_issues"), F.min("item").alias("first_item"))


def declaration_audit(spark, d):
    scanned = sc.scan_labels(part_labels(table(spark, d, "part", even=True)))
    f = F.col("extracted_fields")
    values = {n: sc.value_of(f, n) for n in ("mrp", "mfg_date", "fssai_license", "ingredients", "allergens")}
    values["net_quantity"] = sc.net_quantity_of(f)["raw"]
    rows = rp.declaration_rows(values, F.col("missing_mandatory_fields"), F.lit("Front panel (A)"))
    return scanned.select(F.explode_outer(rows).alias("r")).groupBy(
        "r.declaration_ord", "r.declaration", "r.statutory_rule", "r.provenance", "r.audit_status").agg(
        F.count(F.lit(1)).alias("n_labels"))


def inspection_report(spark, d):
    """The text report of every label; its head and length are compared."""
    scanned = sc.scan_labels(part_labels(table(spark, d, "part", even=True)))
    f = F.col("extracted_fields")
    rows = rp.declaration_rows({"mrp": sc.value_of(f, "mrp")}, F.col("missing_mandatory_fields"))
    report = rp.text_report(
        F.col("p_partkey").cast("string"), F.col("commodity_type"), F.col("is_compliant"), rows, F.col("issues"))
    lines = F.split(report, "\n")
    return scanned.select(
        "p_partkey", lines[4].alias("scan_line"), lines[5].alias("category_line"), lines[7].alias("count_line"),
        lines[10].alias("mrp_line"), F.size(F.filter(lines, lambda x: x.startswith("[Item "))).alias("n_items"))


def domain_dispatch(spark, d):
    commodity = F.when(F.col("o_orderpriority") == "1-URGENT", "food").when(
        F.col("o_orderpriority") == "2-HIGH", "drugs_cosmetics").otherwise("general_commodity")
    routed = ck.route(table(spark, d, "orders").select("o_orderkey", commodity.alias("commodity_type")))
    return routed.groupBy("commodity_type", "routed_domain", "domain_ord").agg(F.count(F.lit(1)).alias("n_queries"))


# Field names asked for by an order, by customer.
_NAMES = ["mrp", "Net", "address", "consumer care", "batch_number", "ORIGIN", "", "declaration"]


def check_mapping(spark, d):
    fields = table(spark, d, "orders").select(
        "o_orderkey", case(F.col("o_custkey") % 8, *[F.lit(n) for n in _NAMES]).alias("field"))
    return ck.checks_for_fields(fields).select(
        "o_orderkey", "field", "check_id", "check_type", F.array_join("query_terms", "|").alias("query_terms"))


def rule_mapping(spark, d):
    fields = table(spark, d, "orders").select(
        "o_orderkey", case(F.col("o_custkey") % 8, *[F.lit(n or "rs") for n in _NAMES]).alias("field_name"))
    return ck.rules_for_fields(fields, ck.rule_catalogue(spark)).groupBy("field_name", "rule_id").agg(
        F.count(F.lit(1)).alias("n_fields"))


def field_queries(spark, d):
    fields = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.lit("food").alias("commodity_type"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("field_name"),
        F.when(F.col("l_discount") > 0.05, money("l_extendedprice")).alias("normalized_value"),
        F.when(F.col("l_returnflag") == "R", F.lit("raw")).alias("raw_text"))
    first = ck.field_queries(fields, ["image_id"]).groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n_queries"), F.countDistinct("query_id").alias("n_ids"))
    food = ck.fssai_queries(fields, ["image_id"]).groupBy("field_name").agg(F.count(F.lit(1)).alias("n_food_queries"))
    return food.join(first, "field_name", "left")


def catalogue_validity(spark, d):
    """Rule entries made from parts, some without a key; sources of every third check are incomplete."""
    key = F.col("p_partkey")
    names = F.when(key % 4 == 0, F.array(*[F.lit(k) for k in cat.RULE_KEYS[1:]])).otherwise(
        F.array(*[F.lit(k) for k in cat.RULE_KEYS]))
    entry = F.map_from_arrays(names, F.transform(names, lambda n: F.lit("x")))
    check = F.map_from_arrays(
        F.array(*[F.lit(k) for k in cat.CHECK_KEYS]), F.array(*[F.lit("x") for _ in cat.CHECK_KEYS]))
    wanted = F.array(*[F.lit(k) for k in cat.CHECK_SOURCE_KEYS])
    have = F.when(key % 3 == 0, F.slice(wanted, 1, 5)).otherwise(wanted)
    source = F.map_from_arrays(have, F.transform(have, lambda n: F.lit("x")))
    sources = F.when(key % 5 == 0, F.slice(F.array(source), 1, 0)).otherwise(F.array(source))
    rows = table(spark, d, "part").select(
        "p_brand", ck.valid_rule(entry).alias("rule_ok"), ck.valid_check(check, sources).alias("check_ok"))
    return rows.groupBy("p_brand").agg(
        F.count_if("rule_ok").alias("valid_rules"), F.count_if("check_ok").alias("valid_checks"),
        ck.every_valid(F.col("rule_ok")).alias("all_rules_valid"))


def _part_chunks(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_partkey").alias("insert_ord"),
        F.col("p_size").cast("string").alias("rule"), text(F.col("p_size"), "(", F.col("p_partkey") % 3, ")").alias("sub_rule"),
        F.lit(None).cast("string").alias("clause"), (F.col("p_partkey") % 30).cast("int").alias("page_start"),
        (F.col("p_partkey") % 30 + 1).cast("int").alias("page_end"),
        F.when(F.col("p_partkey") % 2 == 0, text("the net weight of ", F.col("p_name"))).otherwise(F.lit("short")).alias("text"))


def _catalogue_details(spark, d):
    """Targets (one per supplier nation and brand number) against part chunks."""
    nation = F.col("s_nationkey")
    targets = table(spark, d, "supplier").groupBy(nation).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("T"), nation.cast("string")).alias("check_id"),
        case(nation % 3, F.lit("Net Quantity"), F.lit("MRP shown"), F.lit("Wholesale note")).alias("requirement_name"),
        (nation * 3 + 1).cast("string").alias("rule"),
        F.when(nation % 2 == 0, text(nation * 3 + 1, "(1)")).alias("sub_rule"), F.lit(None).cast("string").alias("clause"),
        (nation + 2).cast("int").alias("page"))
    return ck.validate_catalogue(targets, _part_chunks(spark, d))


def catalogue_open_targets(spark, d):
    """One target per supplier; every third names no rule, every other one no sub-rule, some no page."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    targets = table(spark, d, "supplier").select(
        key.cast("string").alias("check_id"), F.lit("Net Quantity").alias("requirement_name"),
        F.when(key % 3 != 0, (nation * 2 + 1).cast("string")).alias("rule"),
        F.when(key % 2 == 0, text(nation * 2 + 1, "(1)")).alias("sub_rule"), F.lit(None).cast("string").alias("clause"),
        (key % 40).cast("int").alias("page"))
    return ck.validate_catalogue(targets, _part_chunks(spark, d)).select(
        "check_id", F.coalesce(F.col("matched_chunk_id").cast("bigint"), F.lit(0).cast("bigint")).alias("first_chunk"),
        F.coalesce("tier", F.lit(0)).alias("tier"))


def catalogue_summary(spark, d):
    """How many targets were matched, contradicted or not found."""
    return ck.validation_summary(_catalogue_details(spark, d)).withColumn("pass_rate", F.round("pass_rate", 6))


def catalogue_first_match(spark, d):
    return _catalogue_details(spark, d).select(
        "check_id", "status", F.coalesce("matched_chunk_id", F.lit("")).alias("matched_chunk_id"),
        F.coalesce("tier", F.lit(0)).alias("tier"))


def contract_validate(spark, d):
    key = F.col("o_orderkey")
    box = F.array(*[F.lit(0.0)] * 4)
    block = F.struct(
        F.when(key % 6 != 0, F.lit("t")).alias("text"), (key % 12 / F.lit(10.0)).alias("confidence"),
        F.when(key % 5 == 0, F.slice(box, 1, 3)).otherwise(box).alias("bbox"))
    rows = table(spark, d, "orders").select(ct.ocr_violations(
        F.when(key % 7 != 0, key.cast("string")), F.array(block)).alias("v"))
    return rows.groupBy(F.array_join("v", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {
    "field_verdict": field_verdict,
    "package_verdict": package_verdict,
    "missing_mandatory": missing_mandatory,
    "issue_report": issue_report,
    "declaration_audit": declaration_audit,
    "inspection_report": inspection_report,
    "domain_dispatch": domain_dispatch,
    "check_mapping": check_mapping,
    "rule_mapping": rule_mapping,
    "field_queries": field_queries,
    "catalogue_validity": catalogue_validity,
    "catalogue_first_match": catalogue_first_match,
    "catalogue_open_targets": catalogue_open_targets,
    "catalogue_summary": catalogue_summary,
    "contract_validate": contract_validate,
}

_FIELDS = """
  SELECT l_orderkey, l_returnflag, 'f' || l_linenumber AS field_name, l_linenumber = 7 AS blank, 1.0 - l_discount * 6 AS conf FROM lineitem
"""
_STATUS = "CASE WHEN blank OR conf < 0.5 THEN 'FAIL' WHEN conf >= 0.7 THEN 'PASS' ELSE 'UNCERTAIN' END"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CHECKS = ", ".join(
    f"({_quote(i)}, {_quote(n)}, {_quote(k)}, {_quote('|'.join(t))})" for i, n, k, _, _, t, _ in cat.CHECKS)
_RULES = ", ".join(f"({_quote(r[0])}, {_quote('|'.join(r[5]))})" for r in cat.RULES)
_LIST = "[" + ", ".join(_quote(n) for n in _NAMES) + "]"
_LIST_RS = "[" + ", ".join(_quote(n or "rs") for n in _NAMES) + "]"
_CONSISTENT = " OR ".join(
    f"(contains(lower(requirement_name), '{w}') AND ({' OR '.join(f'contains(lower(text), {_quote(k)})' for k in ks)}))"
    for w, ks in CONSISTENCY_WORDS)
_LABEL = """
  SELECT *, (100 - p_size) / 100.0 AS conf, p_partkey % 2 <> 0 AS has_mrp, p_partkey % 5 <> 0 AS has_date,
    p_partkey % 7 <> 0 AS has_licence, p_partkey % 3 <> 0 AS has_contents FROM part
"""
# Fields and missing declarations of a part's label, in order.
_LABEL_LISTS = f"""
  SELECT *, list_filter([CASE WHEN has_mrp THEN 'mrp' END, 'net_quantity', CASE WHEN has_licence THEN 'fssai_license' END,
        CASE WHEN has_date THEN 'mfg_date' END, CASE WHEN has_contents THEN 'ingredients' END,
        CASE WHEN has_contents THEN 'allergens' END, CASE WHEN has_contents THEN 'ins_additives' END], lambda x: x IS NOT NULL) AS fields,
    list_filter([CASE WHEN NOT has_mrp THEN 'mrp' END, CASE WHEN NOT has_date THEN 'mfg_date' END,
        CASE WHEN NOT has_licence THEN 'fssai_license' END, 'manufacturer'], lambda x: x IS NOT NULL) AS missing
  FROM ({_LABEL})
"""
_DECLS = [
    ("Maximum Retail Price (MRP)", "Rule 6(1)(a)", "has_mrp", True), ("Net Quantity", "Rule 6(1)(b)", "true", True),
    ("Date of Mfg / Pkg", "Rule 6(1)(e)", "has_date", True),
    ("Best Before / Expiry Date", "Rule 6(1)(f)", "false", False),
    ("FSSAI 14-Digit License", "FSS Act Sec 31", "has_licence", True),
    ("Ingredients List", "FSSAI Reg 5(2)", "has_contents", False),
    ("Manufacturer / Packer", "Rule 6(1)(d)", "false", True), ("Country of Origin", "Rule 6(1)(n)", "false", False),
    ("Consumer Helpline / Care", "Rule 6(1)(h)", "false", False),
    ("Allergen Disclosures", "FSSAI Reg 5(3)", "has_contents", False),
]

_FIRST_MATCH = f"""
        WITH c AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS rule, p_size || '(' || (p_partkey % 3) || ')' AS sub, p_partkey % 30 AS ps,
            CASE WHEN p_partkey % 2 = 0 THEN 'the net weight of ' || p_name ELSE 'short' END AS text FROM part),
        t AS (SELECT DISTINCT 'T' || s_nationkey AS check_id, ['Net Quantity', 'MRP shown', 'Wholesale note'][s_nationkey % 3 + 1] AS requirement_name,
            CAST(s_nationkey * 3 + 1 AS VARCHAR) AS rule, CASE WHEN s_nationkey % 2 = 0 THEN (s_nationkey * 3 + 1) || '(1)' END AS sub,
            s_nationkey + 2 AS page FROM supplier),
        j AS (SELECT t.*, c.p_partkey, c.text, CASE WHEN (t.sub IS NULL OR contains(t.sub, c.sub) OR contains(c.sub, t.sub))
              AND (ps = 0 OR page BETWEEN ps AND ps + 1 OR abs(ps - page) <= 2) THEN 1 ELSE 2 END AS tier
              FROM t LEFT JOIN c ON c.rule = t.rule),
        r AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY tier, p_partkey) AS rn FROM j)
        SELECT check_id, CASE WHEN p_partkey IS NULL THEN 'NOT_FOUND' WHEN {_CONSISTENT} OR length(text) > 20 THEN 'MATCHED' ELSE 'MISMATCH' END AS status,
          coalesce(CAST(p_partkey AS VARCHAR), '') AS matched_chunk_id, CASE WHEN p_partkey IS NULL THEN 0 ELSE tier END AS tier
        FROM r WHERE rn = 1"""

ORACLE = {
    "field_verdict": f"""
        SELECT l_returnflag, field_name, {_STATUS} AS status, count(*) AS n_fields,
          min(CASE {_STATUS} WHEN 'FAIL' THEN length('Field ''f1'' is missing or low confidence (') + length(CAST(conf AS VARCHAR)) + 2
              WHEN 'PASS' THEN length('Field ''f1'' present with sufficient confidence and complies with Rule 6.')
              ELSE length('Field ''f1'' extracted but requires manual inspection.') END) AS shortest_reason
        FROM ({_FIELDS}) GROUP BY 1, 2, 3""",
    "package_verdict": f"""
        WITH f AS (SELECT l_orderkey, {_STATUS} AS s FROM ({_FIELDS}))
        SELECT o_orderkey AS l_orderkey, count(s) AS n_fields,
          CASE WHEN count(*) FILTER (s = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (s = 'UNCERTAIN') > 0 THEN 'UNCERTAIN' ELSE 'PASS' END AS overall_status
        FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "missing_mandatory": f"""
        WITH g AS (SELECT DISTINCT user_id, {SECONDS_SQL} // 86400 AS day FROM events),
        r AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('refund', 3)) AS t(missing_field, o)),
        m AS (SELECT g.*, missing_field, o FROM g CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.user_id
             AND {SECONDS_SQL} // 86400 = g.day AND e.event_type = r.missing_field AND e.value > 5))
        SELECT user_id, day, missing_field, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY o) - 1 AS INTEGER) AS missing_ord FROM m""",
    "issue_report": f"""
        WITH l AS (SELECT *, CASE WHEN conf < 0.5 THEN 'FAIL' WHEN conf >= 0.7 THEN 'PASS' ELSE 'UNCERTAIN' END AS status FROM ({_LABEL_LISTS})),
        f AS (SELECT p_partkey, conf, status, unnest(fields) AS name, unnest(range(1, len(fields) + 1)) AS item FROM l WHERE status <> 'PASS'),
        m AS (SELECT p_partkey, unnest(missing) AS name, unnest(range(1, len(missing) + 1))
              + CASE WHEN status = 'PASS' THEN 0 ELSE len(fields) END AS item FROM l),
        i AS (SELECT CASE WHEN status = 'FAIL' THEN 'Field ''' || name || ''' is missing or low confidence (' || conf || ').'
                ELSE 'Field ''' || name || ''' extracted but requires manual inspection.' END AS title,
              'Ensure ' || name || ' declaration is printed clearly as per Legal Metrology Rules.' AS officer_action,
              'Legal Metrology (Packaged Commodities) Rules, 2011' AS statutory_section, item FROM f
            UNION ALL
            SELECT 'Mandatory declaration field ''' || name || ''' was not detected on the product label.',
              'Add mandatory declaration ''' || name || ''' in legible font size as mandated by Rule 6.', 'Legal Metrology Rule 6(1)', item FROM m)
        SELECT title, officer_action, statutory_section, count(*) AS n_issues, min(item) AS first_item FROM i GROUP BY 1, 2, 3""",
    "declaration_audit": " UNION ALL ".join(f"""
        SELECT {i} AS declaration_ord, '{label}' AS declaration, '{rule}' AS statutory_rule, 'Front panel' AS provenance,
          CASE WHEN {has} THEN 'DECLARED (OK)' WHEN {str(must).lower()} THEN 'NOT DECLARED [VIOLATION]' ELSE 'N/A / Voluntary' END AS audit_status,
          count(*) AS n_labels FROM ({_LABEL}) GROUP BY 5""" for i, (label, rule, has, must) in enumerate(_DECLS)),
    "inspection_report": f"""
        WITH l AS (SELECT *, len(missing) + CASE WHEN conf >= 0.7 THEN 0 ELSE len(fields) END AS n FROM ({_LABEL_LISTS}))
        SELECT p_partkey, 'Inspection Scan ID : ' || p_partkey AS scan_line,
          'Commodity Category : ' || CASE WHEN has_contents OR has_licence THEN 'food' ELSE 'general_commodity' END AS category_line,
          'Violations Count   : ' || n AS count_line,
          '  - Maximum Retail Price (MRP)    : ' || CASE WHEN has_mrp THEN 'Rs. ' || CASE WHEN p_retailprice * 10 = floor(p_retailprice * 10)
               THEN CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS VARCHAR) ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END
             ELSE 'NOT DECLARED [VIOLATION]' END AS mrp_line,
          n AS n_items FROM l""",
    "domain_dispatch": """
        WITH o AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'food' WHEN '2-HIGH' THEN 'drugs_cosmetics' ELSE 'general_commodity' END AS commodity_type FROM orders)
        SELECT commodity_type, routed_domain, domain_ord, count(*) AS n_queries
        FROM o JOIN (VALUES ('legal_metrology', 0), ('fssai', 1)) AS r(routed_domain, domain_ord)
          ON routed_domain = 'legal_metrology' OR commodity_type = 'food' GROUP BY 1, 2, 3""",
    "check_mapping": f"""
        WITH f AS (SELECT o_orderkey, {_LIST}[o_custkey % 8 + 1] AS field FROM orders),
        c AS (SELECT * FROM (VALUES {_CHECKS}) AS t(check_id, name, kind, terms))
        SELECT o_orderkey, field, coalesce(check_id, 'LM_' || upper(field) || '_001') AS check_id, coalesce(kind, 'presence') AS check_type,
          coalesce(terms, field || '|declaration|pre-packaged commodity') AS query_terms
        FROM f LEFT JOIN c ON contains(lower(check_id), lower(field)) OR contains(lower(name), lower(field)) OR contains(lower(terms), lower(field))
        WHERE field <> ''""",
    "rule_mapping": f"""
        WITH f AS (SELECT {_LIST_RS}[o_custkey % 8 + 1] AS field_name FROM orders),
        r AS (SELECT * FROM (VALUES {_RULES}) AS t(rule_id, keywords))
        SELECT field_name, rule_id, count(*) AS n_fields FROM f JOIN r
          ON contains(lower(rule_id), lower(field_name)) OR contains(lower(keywords), lower(field_name)) GROUP BY 1, 2""",
    "field_queries": """
        WITH f AS (SELECT l_orderkey, 'f' || l_linenumber AS field_name, l_discount > 0.05 OR l_returnflag = 'R' AS has_value
                   FROM lineitem WHERE l_linenumber > 1)
        SELECT field_name, count(*) AS n_food_queries, count(*) FILTER (has_value) AS n_queries,
          count(DISTINCT CASE WHEN has_value THEN l_orderkey END) AS n_ids FROM f GROUP BY field_name""",
    "catalogue_validity": """
        SELECT p_brand, count(*) FILTER (p_partkey % 4 <> 0) AS valid_rules,
          count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 5 <> 0) AS valid_checks,
          bool_and(p_partkey % 4 <> 0) AS all_rules_valid FROM part GROUP BY p_brand""",
    "catalogue_first_match": _FIRST_MATCH,
    "catalogue_open_targets": """
        WITH c AS (SELECT p_partkey AS ord, CAST(p_size AS VARCHAR) AS c_rule, p_size || '(' || p_partkey % 3 || ')' AS c_sub,
            p_partkey % 30 AS first_page, p_partkey % 30 + 1 AS last_page FROM part),
        t AS (SELECT CAST(s_suppkey AS VARCHAR) AS check_id, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey * 2 + 1 AS VARCHAR) END AS t_rule,
            CASE WHEN s_suppkey % 2 = 0 THEN (s_nationkey * 2 + 1) || '(1)' END AS t_sub, s_suppkey % 40 AS page FROM supplier),
        p AS (SELECT check_id, ord, CASE
            WHEN (t_rule IS NULL OR t_rule = c_rule) AND (t_sub IS NULL OR contains(t_sub, c_sub) OR contains(c_sub, t_sub))
              AND (page = 0 OR first_page = 0 OR page BETWEEN first_page AND last_page OR abs(first_page - page) <= 2) THEN 1
            WHEN t_rule = c_rule THEN 2 END AS tier FROM t, c),
        b AS (SELECT check_id, min(tier) AS tier, arg_min(ord, tier * 1000000000 + ord) AS ord FROM p WHERE tier IS NOT NULL GROUP BY 1)
        SELECT t.check_id, coalesce(b.ord, 0) AS first_chunk, coalesce(b.tier, 0) AS tier FROM t LEFT JOIN b USING (check_id)""",
    "catalogue_summary": f"""
        SELECT count(*) AS total_checks, count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status = 'MISMATCH') AS mismatch,
          count(*) FILTER (status = 'NOT_FOUND') AS not_found, round(CAST(count(*) FILTER (status = 'MATCHED') AS DOUBLE) / count(*), 6) AS pass_rate
        FROM ({_FIRST_MATCH}) AS m""",
    "contract_validate": """
        SELECT concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'image_id' END, CASE WHEN o_orderkey % 6 = 0 THEN 'text' END,
          CASE WHEN o_orderkey % 12 > 10 THEN 'confidence' END, CASE WHEN o_orderkey % 5 = 0 THEN 'bbox' END) AS violations, count(*) AS n_records
        FROM orders GROUP BY 1""",
}
