"""Evaluation cases: references are made from the provisions, questions are fixed values."""

from labelwright.fixed.provisions import PROVISIONS


def reference_cases():
    """One exact-reference case per current provision except the plain names of goods."""
    out = []
    for _, rule, sub, clause, _, _, _, extra, _ in PROVISIONS:
        name = f"Rule {clause or sub or rule}"
        if extra.get("status") == "superseded" or name == "Rule 6(1)(b)":
            continue
        out.append((f"E{len(out):03d}", "exact_provision", name, [name], None))
    return out


# Questions and the provisions that answer them.
SCHEDULE_CASES = [
    ("Schedule III commodities when packed", ["Rule 11(4)"], "III"),
    ("Third Schedule provisions", ["Rule 11(4)"], "III"),
    ("Schedule II standard package sizes", [], "II"),
    ("Second Schedule standard package sizes", [], "II"),
]
QUESTIONS = [
    ("What must be printed as MRP?", ["Rule 6(1)(e)"]),
    ("What are the consumer complaint details?", ["Rule 6(2)"]),
    ("What is the minimum height of numerals?", ["Rule 7(2)"]),
    ("What declarations are required on a wholesale package?", ["Rule 24(a)"]),
    ("Can MRP include all taxes?", ["Rule 6(1)(e)"]),
    ("Where must the principal display panel be located?", ["Rule 8(1)"]),
    ("What is the rule for multi-pack net quantity?", ["Rule 13(6)"]),
    ("Are SI units mandatory for net quantity symbols?", ["Rule 13(5)"]),
    ("Rules for wholesale container labeling", ["Rule 24(a)"]),
    ("Exclusion of wrapper weight from net content", ["Rule 11(1)"]),
    ("Helpline email and contact for customer grievances", ["Rule 6(2)"]),
    ("Letter size specifications on display panel", ["Rule 7(2)"]),
    ("Contrast and color legibility for price declarations", ["Rule 9(1)(b)"]),
    ("Transparent outer wrapper visibility requirements", ["Rule 9(2)"]),
    ("Exaggerated or misleading net quantity presentation", ["Rule 12(6)"]),
    ("Dimensions and sheet count for plastic or paper sheets", ["Rule 16"]),
    ("Country of origin labeling for imported goods", ["Rule 6(1)(aa)"]),
    ("Mandatory registration for packers and importers", ["Rule 27"]),
    ("net quantity unit requirement", ["Rule 12(1)"]),
    ("net quantity placement", ["Rule 8(1)"]),
    ("net quantity font height", ["Rule 7(2)"]),
    ("net quantity multipack", ["Rule 13(6)"]),
    ("advertisement font height", ["Rule 31(2)"]),
    ("outer wrapper declarations", ["Rule 9(3)"]),
]


def all_cases():
    sched = [(f"S{i}", "schedule_query", q, p, s) for i, (q, p, s) in enumerate(SCHEDULE_CASES)]
    asked = [(f"N{i:02d}", "natural_language", q, p, None) for i, (q, p) in enumerate(QUESTIONS)]
    return reference_cases() + sched + asked


# Catalogue targets (check, requirement, rule, sub-rule, clause, page) and the chunk each finds.
TARGETS = [
    ("LM_MFR_ADDR_001", "Manufacturer address", "6", "6(1)", "6(1)(a)", 10, "chk_lm_6_6(1)_6(1)(a)_10"),
    ("LM_ORIGIN_001", "Country of origin", "6", "6(1)", "6(1)(aa)", 10, "chk_lm_6_6(1)_6(1)(aa)_10"),
    ("LM_NET_QTY_001", "Net quantity", "6", "6(1)", "6(1)(c)", 11, "chk_lm_6_6(1)_6(1)(c)_11"),
    ("LM_DATE_001", "Date of manufacture", "6", "6(1)", "6(1)(d)", 11, "chk_lm_6_6(1)_6(1)(d)_11"),
    ("LM_BEST_BEFORE_001", "Best before date", "6", "6(1)", "6(1)(da)", 11, "chk_lm_6_6(1)_6(1)(da)_11"),
    ("LM_MRP_001", "MRP declaration", "6", "6(1)", "6(1)(e)", 12, "chk_lm_6_6(1)_6(1)(e)_12"),
    ("LM_DIMENSIONS_001", "Dimensions", "6", "6(1)", "6(1)(f)", 12, "chk_lm_6_6(1)_6(1)(f)_12"),
    ("LM_OTHER_DECL_001", "Other declarations", "6", "6(1)", "6(1)(g)", 13, "chk_lm_6_6(1)_6(1)(a)_10"),
    ("LM_CONSUMER_CARE_001", "Consumer care", "6", "6(2)", None, 14, "chk_lm_6_6(2)_main_13"),
    ("LM_DISPLAY_PANEL_001", "Display panel", "8", "8(1)", None, 20, "chk_lm_8_8(1)_main_20"),
    ("LM_MRP_CONTRAST_001", "MRP contrast", "9", "9(1)", "9(1)(b)", 21, "chk_lm_9_9(1)_9(1)(b)_21"),
    ("LM_WHEN_PACKED_001", "When packed", "11", "11(4)", None, 23, "chk_lm_11_11(4)_main_23"),
    ("LM_MULTIPACK_QTY_001", "Multipack quantity", "13", "13(6)", None, 25, "chk_lm_13_13(6)_main_25"),
    ("LM_SHEET_COUNT_001", "Sheet count", "16", None, None, 25, "chk_lm_16_main_main_25"),
    ("LM_WHOLESALE_QTY_001", "Wholesale quantity", "24", "24(c)", None, 35, "chk_lm_24_24(c)_main_35"),
    ("LM_ADV_FONT_001", "Advertisement font", "31", "31(2)", None, 36, "chk_lm_31_31(2)_main_36"),
    ("LM_DECEPTIVE_PACKAGE_001", "Deceptive package", "23", None, None, 33, "chk_lm_23_main_main_33"),
]
