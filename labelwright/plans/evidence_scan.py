"""Scan of labels with the evidence for every declaration found on them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.config import LayoutConfig
from labelwright.functions.embed import Embedder
from labelwright.functions.fields import COMMODITIES
from labelwright.operators.checks import checks_for_fields
from labelwright.operators.extract import DECLARED
from labelwright.plans.compliance import EVIDENCE, dispatch
from labelwright.plans.scan import scan_labels
from labelwright.session import cut_lineage

# Words under which the check catalogue knows a declaration whose own name it does not hold.
FIELD_WORDS = {
    "net_quantity": "net quantity", "mfg_date": "month and year of manufacture", "manufacturer": "name and address of manufacturer",
    "country_of_origin": "country of origin", "consumer_care": "consumer care", "generic_name": "generic name",
}


def asked_as(field: Column, words: dict[str, str] | None = None) -> Column:
    """The name a declaration is looked up by."""
    if not words:
        return field
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(known, field), field)


def _pair(field: Column, commodity: Column) -> Column:
    return F.concat(commodity, F.lit("\t"), field)


def scan_with_evidence(
    labels: DataFrame, metrology: DataFrame, food: DataFrame | None, as_of: str, embed: Embedder | None = None,
    blocks: str = "blocks", layout: LayoutConfig = LayoutConfig(), words: dict[str, str] | None = FIELD_WORDS,
) -> DataFrame:
    """``scan_labels`` and two more columns: ``field_evidences``, per declaration in label order its name and evidence,
    and ``evidences``, all of it in the same order.  ``words=None`` looks declarations up by their bare names.

    What a declaration is answered with depends on its name and the label's
    commodity alone, and a scan knows ``DECLARED`` names and ``COMMODITIES``
    alone.  So evidence is found once per such pair, however many labels there
    are.  The lists of all pairs are one small map that every task gets, and each
    label reads its declarations' lists from it inside its row: labels are read
    once, and neither they nor their evidence move.  Labels without a declaration
    get empty lists; repeated and null ids are labels of their own.
    """
    spark = labels.sparkSession
    names = spark.createDataFrame(list(product(DECLARED, COMMODITIES)), "field_name string, commodity_type string")
    pairs = names.select(asked_as(F.col("field_name"), words).alias("field"), "commodity_type").distinct()
    checks = checks_for_fields(pairs).withColumn("query_id", F.concat_ws("\t", "commodity_type", "field", "check_id"))
    found = dispatch(checks, metrology, food, as_of, embed)
    item = F.struct("catalogue_ord", "domain_ord", F.col("routed_domain").alias("domain"), F.struct(*EVIDENCE).alias("evidence"))
    answers = found.groupBy("field", "commodity_type").agg(F.array_sort(F.collect_list(item)).alias("_items")).select(
        "field", "commodity_type", F.transform("_items", lambda x: x["evidence"]).alias("evidences"))
    entry = F.struct(_pair(F.col("field"), F.col("commodity_type")), "evidences")
    held = cut_lineage(answers.agg(F.map_from_entries(F.collect_list(entry)).alias("_answers")))
    none = F.array().cast(answers.schema["evidences"].dataType)

    def answered(f: Column) -> Column:
        found = F.try_element_at("_answers", _pair(asked_as(f["field_name"], words), F.col("commodity_type")))
        return F.struct(f["field_name"].alias("field_name"), F.coalesce(found, none).alias("evidences"))

    out = scan_labels(labels, blocks, layout).crossJoin(F.broadcast(held))
    listed = F.coalesce(F.transform("extracted_fields", answered), F.array())
    out = out.withColumn("field_evidences", listed).drop("_answers")
    return out.withColumn("evidences", F.flatten(F.transform("field_evidences", lambda x: x["evidences"])))
