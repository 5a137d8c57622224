"""Inspection and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.fixed.limits import REPORT_FIELDS
from labelwright.functions.text import shorten, strip, truthy

# Single-value declarations of a scan answer, in order.
VALUE_FIELDS = [
    "mrp", "net_quantity", "mfg_date", "expiry_date", "fssai_license", "manufacturer", "country_of_origin",
    "consumer_care",
]


def declaration_rows(values: dict[str, Column], missing: Column, provenance: Column | None = None) -> Column:
    """The declarations table of a label: one struct per declaration, inside the row."""
    where = provenance if provenance is not None else F.lit("Panel 1")
    where = strip(F.get(F.split(where, r"\("), F.lit(0)))
    rows = []
    for ord_, (name, label, rule) in enumerate(REPORT_FIELDS):
        value = truthy(values.get(name, F.lit(None).cast("string")))
        shown = value
        if name == "mrp":
            shown = F.concat(F.lit("Rs. "), value)
        elif name in ("manufacturer", "consumer_care"):
            shown = shorten(value, 45)
        elif name == "ingredients":
            shown = F.concat(F.size(F.split(value, ", ")).cast("string"), F.lit(" ingredients listed"))
        omitted = F.array_contains(missing, name)
        rows.append(F.struct(
            F.lit(ord_).alias("declaration_ord"), F.lit(name).alias("field_name"), F.lit(label).alias("declaration"),
            F.lit(rule).alias("statutory_rule"),
            F.when(value.isNotNull(), shown).when(omitted, F.lit("Missing / Not Legible"))
            .otherwise(F.lit("Not Detected")).alias("detected_value"),
            where.alias("provenance"),
            F.when(value.isNotNull(), F.lit("DECLARED (OK)")).when(omitted, F.lit("NOT DECLARED [VIOLATION]"))
            .otherwise(F.lit("N/A / Voluntary")).alias("audit_status"),
        ))
    return F.array(*rows)


def verdict_text(compliant: Column, issues: Column) -> Column:
    return F.when(compliant, F.lit("PASS — COMPLIANT (CLEARED FOR RETAIL)")).otherwise(
        F.concat(F.lit("NON-COMPLIANT — ACTION REQUIRED ("), F.size(issues).cast("string"), F.lit(" VIOLATIONS)")))


def height_finding(height: Column) -> Column:
    """Finding line of the numeral height audit."""
    return F.when(height["is_compliant"], F.lit("COMPLIANT (Satisfies Rule 9(1) Table 1 Minimum)")).otherwise(
        F.concat(F.lit("SUB-STANDARD DEFICIT ("), height["est_height_mm"].cast("string"), F.lit(" mm < "),
                 height["required_min_mm"].cast("string"), F.lit(" mm Statutory Min)")))


def issue_rows(issues: Column) -> Column:
    """Numbered issue rows with their fallbacks."""
    return F.transform(issues, lambda x, i: F.struct(
        (i + 1).alias("item"),
        F.coalesce(truthy(x["detail"]), F.concat(F.lit("Defect #"), (i + 1).cast("string"))).alias("title"),
        F.coalesce(x["detail"], F.lit("")).alias("observation"),
        F.coalesce(truthy(x["recommendation"]), F.lit("Direct manufacturer to rectify.")).alias("officer_action"),
        F.coalesce(x["regulation_id"], F.lit("Legal Metrology Act, 2009 / FSSAI Regulations")).alias("statutory_section"),
    ))


def text_report(scan_id: Column, category: Column, compliant: Column, declarations: Column, issues: Column,
                height: Column | None = None) -> Column:
    """The inspection report as plain text, built inside the row."""
    double, single = F.lit("=" * 65), F.lit("-" * 65)
    head = F.array(
        double,
        F.lit("   GOVERNMENT OF INDIA — STATUTORY FIELD INSPECTION REPORT"),
        F.lit("     Legal Metrology & Food Safety Compliance Enforcement"),
        double,
        F.concat(F.lit("Inspection Scan ID : "), F.coalesce(scan_id, F.lit("N/A"))),
        F.concat(F.lit("Commodity Category : "), category),
        F.concat(F.lit("Inspection Verdict : "), F.when(compliant, F.lit("PASS (COMPLIANT)")).otherwise(
            F.lit("NON-COMPLIANT (ACTION REQUIRED)"))),
        F.concat(F.lit("Violations Count   : "), F.size(issues).cast("string")),
        single,
        F.lit("1. SUMMARY OF MANDATORY DECLARATIONS:"),
    )
    declared = F.transform(declarations, lambda d: F.concat(
        F.lit("  - "), F.rpad(d["declaration"], 30, " "), F.lit(": "),
        F.when(d["audit_status"] == "DECLARED (OK)", d["detected_value"]).otherwise(F.lit("NOT DECLARED [VIOLATION]"))))
    audit = F.array().cast("array<string>")
    if height is not None:
        audit = F.when(height.isNotNull(), F.array(
            single, F.lit("2. RULE 9 NUMERAL HEIGHT AUDIT:"),
            F.concat(F.lit("  - Status                  : "), height["status"]),
            F.concat(F.lit("  - Measured Height (Est.)   : "), height["est_height_mm"].cast("string"), F.lit(" mm")),
            F.concat(F.lit("  - Statutory Requirement   : "), height["required_min_mm"].cast("string"), F.lit(" mm")),
        )).otherwise(audit)
    found = F.flatten(F.transform(issue_rows(issues), lambda x: F.array(
        F.concat(F.lit("\n[Item "), x["item"].cast("string"), F.lit("] "), F.lit("Violation")),
        F.concat(F.lit("  Observation       : "), x["observation"]),
        F.concat(F.lit("  Officer Action    : "), x["officer_action"]),
        F.concat(F.lit("  Statutory Section : "), x["statutory_section"]),
    )))
    violations = F.when(F.size(issues) > 0, F.concat(
        F.array(single, F.lit("3. STATUTORY VIOLATIONS & RECOMMENDED OFFICER ACTIONS:")), found,
    )).otherwise(F.array().cast("array<string>"))
    foot = F.array(
        F.concat(F.lit("\n"), double),
        F.lit("Inspecting Officer Signature: _______________________"),
        F.lit("Designation                : Food Safety Officer / Inspector (Legal Metrology)"),
        double,
    )
    return F.array_join(F.concat(head, declared, audit, violations, foot), "\n")


def validation_line(row: DataFrame) -> Column:
    """One Markdown table line of the catalogue validation report."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    cite = F.concat(F.lit("Rule "), shown("rule"), F.lit(", Sub "), shown("sub_rule"), F.lit(", Clause "),
                    shown("clause"), F.lit(", Pg "), shown("page"))
    return F.concat(
        F.lit("| `"), F.col("check_id"), F.lit("` | **"), F.col("status"), F.lit("** | `"), cite, F.lit("` | `"),
        F.coalesce("matched_chunk_id", F.lit("N/A")), F.lit("` | "), F.col("reason"), F.lit(" |"))
