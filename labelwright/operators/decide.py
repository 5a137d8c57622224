"""Verdicts per field and package, missing declarations and issue lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed.limits import MANDATORY_FIELDS
from labelwright.functions.measures import field_reason, field_status, severity, status_of_severity
from labelwright.functions.text import truthy

DEFAULT_REGULATION = "Legal Metrology (Packaged Commodities) Rules, 2011"
MISSING_REGULATION = "Legal Metrology Rule 6(1)"


def judge_fields(fields: DataFrame, rule: Column | None = None) -> DataFrame:
    """Status and reason of every field row."""
    cite = rule if rule is not None else F.lit(None).cast("string")
    judged = fields.withColumn(
        "status", field_status(F.col("normalized_value"), F.col("raw_text"), F.col("confidence")))
    return judged.withColumn("reason", field_reason(F.col("field_name"), F.col("status"), F.col("confidence"), cite))


def package_status(judged: DataFrame, keys: list[str], packages: DataFrame | None = None) -> DataFrame:
    """Worst field status per package; packages without fields pass.  ``max`` combines map-side."""
    worst = judged.groupBy(*keys).agg(
        F.max(severity(F.col("status"))).alias("_level"), F.count(F.lit(1)).alias("n_fields"))
    if packages is not None:
        worst = packages.select(*keys).distinct().join(worst, keys, "left")
    return worst.select(
        *keys, status_of_severity(F.coalesce("_level", F.lit(0))).alias("overall_status"),
        F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def status_of_fields(fields: Column) -> Column:
    """Package status of an array of extracted fields, inside the row."""
    level = F.aggregate(fields, F.lit(0), lambda s, f: F.greatest(
        s, severity(field_status(f["normalized_value"], f["raw_text"], f["confidence"]))))
    return status_of_severity(level)


def missing_in_row(fields: Column) -> Column:
    """Mandatory declarations an array of extracted fields lacks, in list order."""
    present = F.transform(
        F.filter(fields, lambda f: F.coalesce(truthy(f["normalized_value"]), truthy(f["raw_text"])).isNotNull()),
        lambda f: f["field_name"])
    return F.array_except(F.array(*[F.lit(m) for m in MANDATORY_FIELDS]), present)


def missing_rows(found: DataFrame, keys: list[str], name: str, value: Column, required: list[str]) -> DataFrame:
    """Required names a group of rows lacks.

    Per group only one flag per required name is kept (a ``max``, combined
    map-side); the missing names are then unfolded from the flags.
    """
    has = found.groupBy(*keys).agg(*[
        F.max((F.col(name) == r) & value.isNotNull()).alias(f"_has_{i}") for i, r in enumerate(required)])
    lacking = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.col(f"_has_{i}"), F.lit(False)), F.lit(r)) for i, r in enumerate(required)]))
    return has.select(*keys, F.posexplode(lacking).alias("missing_ord", "missing_field"))


def field_issues(fields: Column, rule_of: Column | None = None) -> Column:
    """Issues of an array of extracted fields: failed and doubtful fields, in field order."""
    regulation = rule_of if rule_of is not None else F.lit(DEFAULT_REGULATION)

    def issue(f: Column) -> Column:
        status = field_status(f["normalized_value"], f["raw_text"], f["confidence"])
        return F.struct(
            F.when(status == "FAIL", F.lit("critical")).otherwise(F.lit("warning")).alias("severity"),
            field_reason(f["field_name"], status, f["confidence"], F.lit(None).cast("string")).alias("detail"),
            F.concat(F.lit("Ensure "), f["field_name"],
                     F.lit(" declaration is printed clearly as per Legal Metrology Rules.")).alias("recommendation"),
            regulation.alias("regulation_id"),
        )

    doubtful = F.filter(
        fields, lambda f: field_status(f["normalized_value"], f["raw_text"], f["confidence"]) != "PASS")
    return F.transform(doubtful, issue)


def missing_issue(name: Column) -> Column:
    return F.struct(
        F.lit("critical").alias("severity"),
        F.concat(F.lit("Mandatory declaration field '"), name,
                 F.lit("' was not detected on the product label.")).alias("detail"),
        F.concat(F.lit("Add mandatory declaration '"), name,
                 F.lit("' in legible font size as mandated by Rule 6.")).alias("recommendation"),
        F.lit(MISSING_REGULATION).alias("regulation_id"),
    )


def all_issues(fields: Column, missing: Column) -> Column:
    """Field issues, then one critical issue per missing declaration."""
    return F.concat(field_issues(fields), F.transform(missing, missing_issue))
