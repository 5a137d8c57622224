"""Registered queries: reading declarations off label texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed import label_patterns as lp
from labelwright.functions import fields as fl
from labelwright.operators import blocks as bl
from labelwright.operators import extract as ex
from labelwright.plans import scan as sc
from labelwright.queries.tables import case, money, table, text
from labelwright.session import dealt

# ---------------------------------------------------------------- label texts made from columns


def price_label(price: str, n: Column) -> Column:
    amount = money(price)
    return case(
        n,
        text("MRP Rs. ", amount, " (incl. of all taxes)"), text("M.R.P.: ₹ ", amount), text("Rs. ", amount),
        text("Maximum Retail Price ", F.translate(amount, ".", ",")),
    )


def quantity_label(size: Column, n: Column) -> Column:
    return case(
        n,
        text("Net Wt ", size, " gms"), text("Net Qty: ", size, " kg"), text(size, " ml NET"),
        text("NET ", size, " litre"), text(size, " litre"), text("Contains ", size, " ltr bottle"),
    )


def ingredient_label() -> Column:
    word = F.split("p_name", " ")
    return text(
        "Ingredients: ", F.initcap(word[0]), " Flour, ", F.initcap(word[1]), " Oil (INS ", F.col("p_size") + 100,
        ", refined), Milk Solids; ", F.col("p_brand"), " Salt. Nutrition: energy 10 kcal",
    )


def part_labels(parts: DataFrame) -> DataFrame:
    """One label per part: price, quantity, licence, packing date, contents; some parts lack some of them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    conf = (F.lit(100) - size) / F.lit(100.0)

    def block(i: int, words: Column) -> Column:
        box = F.array(*[v.cast("double") for v in (F.lit(0), F.lit(900 - 100 * i), F.lit(300), F.lit(20))])
        return F.struct(
            F.lit(None).cast("string").alias("block_id"), words.alias("text"), conf.alias("confidence"), box.alias("bbox"))

    parts_of_label = [
        F.when(key % 3 != 0, block(0, ingredient_label())),
        F.when(key % 5 != 0, block(1, text("PKD ", F.lpad((size % 28 + 1).cast("string"), 2, "0"), "/05/2026"))),
        F.when(key % 7 != 0, block(2, text("FSSAI Lic No. 1", F.lpad(key.cast("string"), 13, "0")))),
        block(3, text("Net Wt ", size, " g")),
        F.when(key % 2 != 0, block(4, text("MRP Rs. ", money("p_retailprice")))),
        block(5, F.col("p_name")),
    ]
    return parts.select("p_partkey", F.array_compact(F.array(*parts_of_label)).alias("blocks"))


# ---------------------------------------------------------------- queries


def label_mrp_extract(spark, d):
    p = table(spark, d, "part").withColumn("label", price_label("p_retailprice", F.col("p_partkey") % 4))
    read = ex.declarations_in_text(p, "label", ["mrp"])
    return read.select("p_partkey", fl.amount(F.col("mrp_found")).alias("mrp"), F.col("mrp_unit").alias("unit"))


def label_net_quantity_extract(spark, d):
    p = table(spark, d, "part").withColumn("label", quantity_label(F.col("p_size"), F.col("p_partkey") % 6))
    read = ex.declarations_in_text(p, "label", ["net_quantity"])
    return read.select(
        "p_partkey", fl.quantity(F.col("net_quantity_found")).alias("quantity"), F.col("net_quantity_unit").alias("unit"))


def label_licence_batch_dates(spark, d):
    key = F.col("o_orderkey")
    expiry = F.when(key % 2 == 0, text("USE BY ", F.date_format("o_orderdate", "dd-MM-yyyy"))).otherwise(
        text("BEST BEFORE ", key % 24 + 1, " MONTHS"))
    o = table(spark, d, "orders").withColumn("label", text(
        "FSSAI Lic No 1", F.lpad(key.cast("string"), 13, "0"), " BATCH LT-", F.col("o_custkey"), "/A PKD ",
        F.date_format("o_orderdate", "dd/MM/yyyy"), " ", expiry))
    read = ex.declarations_in_text(o, "label", ["fssai_license", "batch_number", "mfg_date", "expiry_date"])
    return read.select(
        "o_orderkey", F.col("fssai_license_value").alias("licence"), F.col("batch_number_value").alias("batch"),
        F.col("mfg_date_value").alias("mfg_date"), F.col("expiry_date_value").alias("expiry_date"))


def label_value_totals(spark, d):
    rows = table(spark, d, "lineitem", even=True).select(
        "l_returnflag",
        text(price_label("l_extendedprice", F.col("l_linenumber") % 4), " / Net Wt ",
             F.col("l_quantity").cast("int"), " g").alias("label"))
    read = ex.declarations_in_text(rows, "label", ["mrp", "net_quantity"])
    return read.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.round(F.sum(fl.amount(F.col("mrp_found"))), 2).alias("total_mrp"),
        F.round(F.sum(fl.quantity(F.col("net_quantity_found"))), 2).alias("total_quantity"))


def contact_extract(spark, d):
    docs = table(spark, d, "documents", even=True)
    return docs.select(
        "doc_id", F.coalesce(fl.email_of(F.col("text")), F.lit("")).alias("email"),
        F.coalesce(fl.phone_of(F.col("text")), F.lit("")).alias("phone"))


def document_declarations(spark, d):
    docs = table(spark, d, "documents", even=True)
    read = ex.declarations_in_text(docs, "text")
    blank = F.lit("")
    return read.select(
        "doc_id", F.coalesce(fl.amount(F.col("mrp_found")), F.lit(-1.0)).alias("mrp"),
        F.coalesce(fl.quantity(F.col("net_quantity_found")), F.lit(-1.0)).alias("quantity"),
        F.coalesce("net_quantity_unit", blank).alias("unit"),
        F.coalesce("fssai_license_value", blank).alias("licence"),
        F.coalesce("batch_number_value", blank).alias("batch"),
        F.coalesce("mfg_date_value", blank).alias("mfg_date"),
        F.coalesce("expiry_date_value", blank).alias("expiry_date"))


def first_declarations_per_package(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem", even=True).withColumn("text", case(
        line % 3,
        text("MRP Rs. ", money("l_extendedprice")), text("Net Wt ", F.col("l_quantity").cast("int"), " g"),
        F.lit("Handle with care")))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    firsts = ex.first_declarations(rows, ["l_orderkey"], order, "text", ["mrp", "net_quantity"])
    return firsts.select(
        "l_orderkey", fl.amount(F.col("mrp_found")).alias("mrp"),
        fl.quantity(F.col("net_quantity_found")).alias("quantity"))


def ingredients_split(spark, d):
    section = table(spark, d, "part").select("p_partkey", ex.ingredient_section(ingredient_label()).alias("section"))
    s = F.col("section")
    return section.select(
        "p_partkey", F.array_join(ex.ingredient_items(s), " | ").alias("items"),
        F.array_join(fl.allergens_in(s), ", ").alias("allergens"),
        F.array_join(fl.additive_codes(s), ", ").alias("additives"))


def commodity_class(spark, d):
    low = fl.folded(F.col("text"))
    scored = table(spark, d, "documents", even=True).select(
        "doc_id", fl.pattern_score(low, lp.FOOD_WORDS).alias("food_score"),
        fl.pattern_score(low, lp.DRUG_COSMETIC_WORDS).alias("drug_score"))
    return scored.withColumn("commodity", fl.commodity_class(F.col("food_score"), F.col("drug_score")))


def label_commodity_class(spark, d):
    words = text(F.col("p_name"), case(
        F.col("p_partkey") % 5,
        F.lit(" Wheat flour, added sugars"), F.lit(" shampoo, for external use only"), F.lit(" tablet with oil"),
        F.lit(" plastic bucket"), F.lit(" Vegan masala in a capsule and a dose")))
    return table(spark, d, "part").select("p_partkey", fl.commodity_of_text(words).alias("commodity"))


def confidence_filter_mean(spark, d):
    rows = table(spark, d, "events").withColumn("confidence", F.least(F.col("value") / 100.0, F.lit(1.0)))
    kept = bl.keep_confident_rows(rows)
    return kept.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), bl.mean_confidence_rows(F.col("confidence")).alias("mean_confidence"))


def label_scan(spark, d):
    scanned = sc.scan_labels(part_labels(dealt(table(spark, d, "part"))))
    f = F.col("extracted_fields")
    return scanned.select(
        "p_partkey", "commodity_type", "overall_status", "is_compliant", "ocr_detections_count",
        F.size("issues").alias("n_issues"),
        F.array_join("missing_mandatory_fields", ",").alias("missing"),
        F.array_join(F.transform(f, lambda x: x["field_name"]), ",").alias("fields"),
        F.coalesce(sc.value_of(f, "mrp"), F.lit("")).alias("mrp"),
        sc.net_quantity_of(f)["raw"].alias("net_quantity"),
        F.coalesce(sc.value_of(f, "ingredients"), F.lit("")).alias("ingredients"))


def label_scan_verdicts(spark, d):
    """The scan over order lines: one label per line, verdicts counted."""
    key, size = F.col("l_partkey"), F.col("l_quantity").cast("int")
    conf = F.lit(1.0) - F.col("l_discount") * 6

    def block(words: Column) -> Column:
        return F.struct(
            F.lit(None).cast("string").alias("block_id"), words.alias("text"), conf.alias("confidence"),
            F.array(*[F.lit(float(v)) for v in (0, 0, 100, 20)]).alias("bbox"))

    labels = dealt(table(spark, d, "lineitem")).select("l_returnflag", F.array_compact(F.array(
        F.when(key % 2 == 0, block(text("MRP Rs. ", money("l_extendedprice")))),
        block(text("Net Wt ", size, " g")),
        F.when(key % 3 == 0, block(text("PKD ", F.date_format("l_shipdate", "dd/MM/yyyy")))),
    )).alias("blocks"))
    return sc.scan_labels(labels).groupBy("l_returnflag", "overall_status").agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum(F.size("issues")).alias("n_issues"),
        F.sum(F.size("missing_mandatory_fields")).alias("n_missing"))


def merge_panels(spark, d):
    line = F.col("l_linenumber")
    block = F.struct(
        F.lit(None).cast("string").alias("block_id"),
        F.when(line % 2 == 0, text("MRP Rs. ", money("l_extendedprice"))).otherwise(
            text("Net Wt ", F.col("l_quantity").cast("int"), " g")).alias("text"),
        F.lit(0.9).alias("confidence"), F.array(*[F.lit(0.0)] * 4).alias("bbox"))
    panels = dealt(table(spark, d, "lineitem")).select(
        F.col("l_orderkey").alias("scan_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("panel_ord"),
        F.array(block).alias("blocks"))
    merged = sc.merge_panels(ex.extract_fields(panels))
    return merged.select(
        "scan_id", "field_name", F.col("field.normalized_value").try_cast("double").alias("value"),
        F.col("panel_ord.l_linenumber").alias("panel"))


QUERIES = {
    "label_mrp_extract": label_mrp_extract,
    "label_net_quantity_extract": label_net_quantity_extract,
    "label_licence_batch_dates": label_licence_batch_dates,
    "label_value_totals": label_value_totals,
    "contact_extract": contact_extract,
    "document_declarations": document_declarations,
    "first_declarations_per_package": first_declarations_per_package,
    "ingredients_split": ingredients_split,
    "commodity_class": commodity_class,
    "label_commodity_class": label_commodity_class,
    "confidence_filter_mean": confidence_filter_mean,
    "label_scan": label_scan,
    "label_scan_verdicts": label_scan_verdicts,
    "merge_panels": merge_panels,
}

# ---------------------------------------------------------------- expected results in SQL

_W = r"\p{L}\p{N}_"


def _word_re(pattern: str) -> str:
    """A word pattern with its boundaries spelled out for an engine without Unicode boundaries."""
    body = pattern
    head = tail = ""
    if body.startswith(r"\b"):
        head, body = f"(^|[^{_W}])", body[2:]
    if body.endswith(r"\b"):
        tail, body = f"([^{_W}]|$)", body[:-2]
    return "(?i)" + head + body.replace(r"\b", "") + tail


def _score_sql(column: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches({column}, '{_word_re(p)}') AS INTEGER)" for p in patterns)


_DATE = (r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[A-Za-z]{3,9}\s*[''.]?\s*[0-9]{2,4}"
         r"|[0-9]{1,2}\s*[A-Za-z]{3,9}\s*[0-9]{2,4}")
_MRP1 = r"(?i)(?:M\.?R\.?P\.?|MAX(?:IMUM)?\s*RETAIL\s*PRICE)[^0-9₹Rs]*[₹Rs.]*\s*([0-9]+(?:[.,][0-9]{1,2})?)"
_MRP2 = r"(?i)(?:₹|Rs\.?)\s*([0-9]+(?:[.,][0-9]{1,2})?)"
_NET = r"NET\s*(?:QTY|QUANTITY|WT|WEIGHT|CONTENT)?"
_UNITS1 = "kg|g|gm|gms|mg|l|ltr|litres?|ml|piece|pieces|pcs|count|u|units?"
_UNITS2 = "kg|g|gm|gms|l|ltr|ml"
_END = f"(?:[^{_W}]|$)"
_START = f"(?:^|[^{_W}])"
_Q1 = rf"(?i){_NET}[^0-9]*([0-9]+(?:\.[0-9]+)?)\s*({_UNITS1}){_END}"
_Q2 = rf"(?i){_START}([0-9]+(?:\.[0-9]+)?)\s*({_UNITS2})\s*(?:{_NET}){_END}"
_Q3 = rf"(?i){_START}([0-9]+(?:\.[0-9]+)?)\s*({_UNITS2}){_END}"


def _rx(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


def _unit_sql(expr: str) -> str:
    return (f"CASE lower({expr}) WHEN 'gm' THEN 'g' WHEN 'gms' THEN 'g' WHEN 'ltr' THEN 'l' WHEN 'litre' THEN 'l' "
            f"WHEN 'litres' THEN 'l' ELSE lower({expr}) END")


_QTY = f"coalesce({_rx('text', _Q1)}, {_rx('text', _Q2)}, {_rx('text', _Q3)})"
_UNIT = (f"CASE WHEN {_rx('text', _Q1)} IS NOT NULL THEN {_rx('text', _Q1, 2)} WHEN {_rx('text', _Q2)} IS NOT NULL "
         f"THEN {_rx('text', _Q2, 2)} ELSE {_rx('text', _Q3, 2)} END")

# The label of a part, as the columns it was made from.
_PART_LABEL = """
  SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, (100 - p_size) / 100.0 AS conf,
    p_partkey % 2 <> 0 AS has_mrp, p_partkey % 5 <> 0 AS has_date, p_partkey % 7 <> 0 AS has_licence,
    p_partkey % 3 <> 0 AS has_contents,
    upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] AS w1,
    upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS w2
  FROM part
"""

ORACLE = {
    "label_mrp_extract": """
        SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS mrp, 'INR' AS unit FROM part""",
    "label_net_quantity_extract": """
        SELECT p_partkey, CASE WHEN p_partkey % 6 = 4 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS quantity,
          CASE p_partkey % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 4 THEN NULL ELSE 'l' END AS unit
        FROM part""",
    "label_licence_batch_dates": """
        SELECT o_orderkey, '1' || lpad(CAST(o_orderkey AS VARCHAR), 13, '0') AS licence,
          'LT-' || o_custkey || '/A' AS batch, strftime(o_orderdate, '%d/%m/%Y') AS mfg_date,
          CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
               ELSE (o_orderkey % 24 + 1) || ' MONTHS' END AS expiry_date
        FROM orders""",
    "label_value_totals": """
        SELECT l_returnflag, count(*) AS n_labels, round(sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)), 2) AS total_mrp,
          round(sum(floor(l_quantity)), 2) AS total_quantity
        FROM lineitem GROUP BY l_returnflag""",
    "contact_extract": r"""
        SELECT doc_id, regexp_extract(text, '([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)', 1) AS email,
          regexp_extract(text, '(?i)(?:TOLL\s*FREE|HELPLINE|CALL|CARE)[^0-9]*([0-9]{3,5}[-\s]?[0-9]{3,4}[-\s]?[0-9]{3,4}|[0-9]{10,11})', 1) AS phone
        FROM documents""",
    "document_declarations": rf"""
        SELECT doc_id,
          coalesce(CAST(replace(coalesce({_rx('text', _MRP1)}, {_rx('text', _MRP2)}), ',', '.') AS DOUBLE), -1.0) AS mrp,
          coalesce(CAST({_QTY} AS DOUBLE), -1.0) AS quantity,
          coalesce({_unit_sql(_UNIT)}, '') AS unit,
          coalesce({_rx('text', r'(?i)(?:FSSAI|LIC(?:ENCE)?\s*(?:NO\.?)?)[^0-9]*([12][0-9]{13})')},
                   {_rx('text', _START + '([12][0-9]{13})' + _END)}, '') AS licence,
          coalesce({_rx('text', r'(?i)(?:BATCH|LOT|B\.?\s*NO\.?)[^' + _W + r']*([A-Z0-9/-]+)')}, '') AS batch,
          coalesce(trim({_rx('text', r'(?i)(?:MFD|MFG|PACKED|PKD|DATE\s*OF\s*(?:MFG|PACKING))[^0-9]*(' + _DATE + ')')}), '') AS mfg_date,
          coalesce(trim({_rx('text', r'(?i)(?:EXP(?:IRY)?|USE\s*BY|BEST\s*BEFORE)[^0-9]*(' + _DATE + r'|[0-9]+\s*MONTHS?)')}), '') AS expiry_date
        FROM documents""",
    "first_declarations_per_package": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)
        SELECT l_orderkey,
          max(CASE WHEN rn = 1 AND l_linenumber % 3 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END) AS mrp,
          max(CASE WHEN rn = 1 AND l_linenumber % 3 = 1 THEN floor(l_quantity) END) AS quantity
        FROM r GROUP BY l_orderkey""",
    "ingredients_split": f"""
        SELECT p_partkey, w1 || ' Flour | ' || w2 || ' Oil (INS ' || (p_size + 100) || ', refined) | Milk Solids | '
            || p_brand || ' Salt' AS items,
          'Milk' AS allergens, 'INS ' || (p_size + 100) AS additives
        FROM ({_PART_LABEL})""",
    "commodity_class": f"""
        WITH s AS (SELECT doc_id, {_score_sql('lower(text)', lp.FOOD_WORDS)} AS food_score,
            {_score_sql('lower(text)', lp.DRUG_COSMETIC_WORDS)} AS drug_score FROM documents)
        SELECT *, CASE WHEN food_score >= 1 AND food_score >= drug_score THEN 'food'
          WHEN drug_score >= 1 THEN 'drugs_cosmetics' ELSE 'general_commodity' END AS commodity FROM s""",
    "label_commodity_class": """
        SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'food' WHEN 1 THEN 'drugs_cosmetics' WHEN 2 THEN 'food'
          WHEN 3 THEN 'general_commodity' ELSE 'food' END AS commodity FROM part""",
    "confidence_filter_mean": """
        SELECT user_id, count(*) AS n_blocks, round(avg(least(value / 100.0, 1.0)), 4) AS mean_confidence
        FROM events WHERE least(value / 100.0, 1.0) >= 0.5 GROUP BY user_id""",
    "label_scan": f"""
        WITH l AS (SELECT *, CASE WHEN conf < 0.5 THEN 'FAIL' WHEN conf >= 0.7 THEN 'PASS' ELSE 'UNCERTAIN' END AS status
                   FROM ({_PART_LABEL})),
        m AS (SELECT *, concat_ws(',', CASE WHEN NOT has_mrp THEN 'mrp' END, CASE WHEN NOT has_date THEN 'mfg_date' END,
                 CASE WHEN NOT has_licence THEN 'fssai_license' END, 'manufacturer') AS missing,
               2 + CAST(has_mrp AS INT) + CAST(has_date AS INT) + CAST(has_licence AS INT) + CAST(has_contents AS INT) AS n_blocks,
               1 + CAST(has_mrp AS INT) + CAST(has_date AS INT) + CAST(has_licence AS INT) + 3 * CAST(has_contents AS INT) AS n_fields
              FROM l)
        SELECT p_partkey, CASE WHEN has_contents OR has_licence THEN 'food' ELSE 'general_commodity' END AS commodity_type,
          status AS overall_status, false AS is_compliant, n_blocks AS ocr_detections_count,
          CASE WHEN status = 'PASS' THEN 0 ELSE n_fields END + len(string_split(missing, ',')) AS n_issues, missing,
          concat_ws(',', CASE WHEN has_mrp THEN 'mrp' END, 'net_quantity', CASE WHEN has_licence THEN 'fssai_license' END,
            CASE WHEN has_date THEN 'mfg_date' END,
            CASE WHEN has_contents THEN 'ingredients,allergens,ins_additives' END) AS fields,
          CASE WHEN has_mrp THEN CASE WHEN p_retailprice * 10 = floor(p_retailprice * 10)
               THEN CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS VARCHAR) ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END
               ELSE '' END AS mrp,
          p_size || '.0 g' AS net_quantity,
          CASE WHEN has_contents THEN w1 || ' Flour, ' || w2 || ' Oil (INS ' || (p_size + 100)
            || ', refined), Milk Solids, ' || p_brand || ' Salt' ELSE '' END AS ingredients
        FROM m""",
    "label_scan_verdicts": """
        WITH l AS (SELECT l_returnflag, 1.0 - l_discount * 6 AS conf, l_partkey % 2 = 0 AS has_mrp, l_partkey % 3 = 0 AS has_date
                   FROM lineitem),
        s AS (SELECT *, CASE WHEN conf < 0.5 THEN 'FAIL' WHEN conf >= 0.7 THEN 'PASS' ELSE 'UNCERTAIN' END AS overall_status,
                5 - 1 - CAST(has_mrp AS INT) - CAST(has_date AS INT) AS n_missing FROM l)
        SELECT l_returnflag, overall_status, count(*) AS n_labels,
          CAST(sum(n_missing + CASE WHEN overall_status = 'PASS' THEN 0 ELSE 5 - n_missing END) AS BIGINT) AS n_issues,
          CAST(sum(n_missing) AS BIGINT) AS n_missing
        FROM s GROUP BY 1, 2""",
    "merge_panels": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)
        SELECT l_orderkey AS scan_id, CASE WHEN l_linenumber % 2 = 0 THEN 'mrp' ELSE 'net_quantity' END AS field_name,
          CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) ELSE floor(l_quantity) END AS value,
          l_linenumber AS panel
        FROM r WHERE rn = 1""",
}
