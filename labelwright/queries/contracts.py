"""Registered queries: records of orders and order lines held against the four contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.fixed.contracts import CONTRACTS
from labelwright.operators.json_schema import violations
from labelwright.queries.tables import table


def _counted(records: DataFrame, contract: str) -> DataFrame:
    """Records per list of broken rules; ``records`` has one struct column, ``record``."""
    broken = violations(CONTRACTS[contract], F.col("record"), records.schema["record"].dataType)
    return records.groupBy(F.array_join(broken, "; ").alias("violations")).agg(F.count(F.lit(1)).alias("n_records"))


def contract_ocr_output(spark, d):
    """An order is a document, its lines are the blocks: dear lines are too sure of themselves, third lines lack text, fifth a side of the box."""
    line = F.col("l_linenumber")
    box = F.array(*[F.lit(float(i)) for i in range(4)])
    block = F.struct(
        F.when(line != 3, F.col("l_linestatus")).alias("text"),
        (F.col("l_quantity") / 49).cast("double").alias("confidence"),
        F.when(line == 5, F.slice(box, 1, 3)).otherwise(box).alias("bbox"))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(block).alias("text_blocks"))
    record = F.struct(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey").cast("string")).alias("image_id"), "text_blocks")
    return _counted(orders.select(record.alias("record")), "ocr_output")


def contract_field_extraction(spark, d):
    """Every order line is a record with one field."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    field = F.struct(
        F.when(line != 2, F.col("l_returnflag")).alias("field_name"), F.when(line != 4, F.col("l_linestatus")).alias("raw_text"),
        (F.col("l_discount") * 12).cast("double").alias("confidence"))
    fields = F.when(line != 6, F.array(field))
    record = F.struct(key.cast("string").alias("image_id"), F.when(key % 5 != 0, F.lit("food")).alias("commodity_type"), fields.alias("extracted_fields"))
    return _counted(table(spark, d, "lineitem").select(record.alias("record")), "field_extraction")


def contract_compliance_check(spark, d):
    """Every order is a check query; some have no domain, no field, or a term that is null."""
    key = F.col("o_orderkey")
    terms = F.array(F.col("o_orderpriority"), F.when(key % 4 != 0, F.col("o_orderstatus")))
    record = F.struct(
        key.cast("string").alias("check_id"), F.when(key % 3 != 0, F.lit("legal_metrology")).alias("domain"), F.lit("food").alias("commodity_type"),
        F.when(key % 5 != 0, F.lit("mrp")).alias("field"), F.when(key % 11 != 0, terms).alias("query_terms"))
    return _counted(table(spark, d, "orders").select(record.alias("record")), "compliance_check")


def contract_evidence_output(spark, d):
    """Every part is a piece of evidence; scores run from below 0 to above 1, pages may be halves, citations may lack their rule."""
    key = F.col("p_partkey")
    text = key.cast("string")
    cited = F.struct(F.lit("Rules").alias("document"), F.when(key % 4 != 0, F.lit("Rule 6")).alias("rule"), (key / 2).alias("page"))
    record = F.struct(
        text.alias("check_id"), text.alias("chunk_id"), F.lit("Rules").alias("document"), F.lit("Rule 6").alias("rule"),
        F.lit(None).cast("string").alias("sub_rule"), F.col("p_name").alias("text"), (F.col("p_size") / 40.0 - 0.1).alias("retrieval_score"),
        F.when(key % 5 != 0, cited).alias("citation"))
    return _counted(table(spark, d, "part").select(record.alias("record")), "evidence_output")


QUERIES = {f.__name__: f for f in (contract_ocr_output, contract_field_extraction, contract_compliance_check, contract_evidence_output)}

ORACLE = {
    "contract_ocr_output": """
        WITH o AS (SELECT l_orderkey, bool_or(l_linenumber = 3) AS no_text, bool_or(l_quantity > 49) AS too_high, bool_or(l_linenumber = 5) AS short_box
                   FROM lineitem GROUP BY 1)
        SELECT concat_ws('; ', CASE WHEN l_orderkey % 7 = 0 THEN 'image_id: required' END, CASE WHEN no_text THEN 'text_blocks[].text: required' END,
          CASE WHEN too_high THEN 'text_blocks[].confidence: maximum' END, CASE WHEN short_box THEN 'text_blocks[].bbox: minItems' END) AS violations,
          count(*) AS n_records FROM o GROUP BY 1""",
    "contract_field_extraction": """
        SELECT concat_ws('; ', CASE WHEN l_orderkey % 5 = 0 THEN 'commodity_type: required' END,
          CASE WHEN l_linenumber = 6 THEN 'extracted_fields: required' END,
          CASE WHEN l_linenumber = 2 THEN 'extracted_fields[].field_name: required' END,
          CASE WHEN l_linenumber = 4 THEN 'extracted_fields[].raw_text: required' END,
          CASE WHEN l_linenumber <> 6 AND CAST(l_discount * 12 AS DOUBLE) > 1 THEN 'extracted_fields[].confidence: maximum' END) AS violations,
          count(*) AS n_records FROM lineitem GROUP BY 1""",
    "contract_compliance_check": """
        SELECT concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'domain: required' END, CASE WHEN o_orderkey % 5 = 0 THEN 'field: required' END,
          CASE WHEN o_orderkey % 11 = 0 THEN 'query_terms: required' WHEN o_orderkey % 4 = 0 THEN 'query_terms[]: required' END) AS violations,
          count(*) AS n_records FROM orders GROUP BY 1""",
    "contract_evidence_output": """
        SELECT concat_ws('; ', CASE WHEN p_size / 40.0 - 0.1 < 0 THEN 'retrieval_score: minimum' WHEN p_size / 40.0 - 0.1 > 1 THEN 'retrieval_score: maximum' END,
          CASE WHEN p_partkey % 5 = 0 THEN 'citation: required' END,
          CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 = 0 THEN 'citation.rule: required' END,
          CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 1 THEN 'citation.page: type' END) AS violations,
          count(*) AS n_records FROM part GROUP BY 1""",
}
