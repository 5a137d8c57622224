"""Check and rule catalogues."""

_RULES_2011 = "Legal Metrology (Packaged Commodities) Rules, 2011"

# Checks: check_id, requirement_name, check_type, applies_to, required_observations, query_terms,
# (rule, sub_rule, clause, schedule, page).
CHECKS = [
    ("LM_MRP_001", "Maximum Retail Price (MRP) declaration", "presence", "pre_packaged_commodity",
     ["mrp_text", "mrp_bbox"],
     ["MRP", "maximum retail price", "inclusive of all taxes", "pre-packaged commodity", "declaration"],
     ("Rule 6", "sub-rule (1)", "clause (f)", None, 12)),
    ("LM_NET_001", "Net Quantity declaration", "presence", "pre_packaged_commodity",
     ["net_quantity_text", "net_quantity_bbox"],
     ["Net Quantity", "net weight", "net volume", "units", "standard unit"],
     ("Rule 6", "sub-rule (1)", "clause (d)", None, 10)),
    ("LM_MFG_001", "Manufacturer or Packer or Importer details declaration", "presence", "pre_packaged_commodity",
     ["manufacturer_name", "manufacturer_address"],
     ["name and address of manufacturer", "packer", "importer", "pre-packaged commodity"],
     ("Rule 6", "sub-rule (1)", "clause (a)", None, 8)),
    ("LM_DATE_001", "Month and Year of Manufacture or Packing declaration", "presence", "pre_packaged_commodity",
     ["manufacture_date_text"],
     ["month and year of manufacture", "date of packing", "imported date"],
     ("Rule 6", "sub-rule (1)", "clause (e)", None, 11)),
    ("LM_CARE_001", "Consumer Care Details declaration", "presence", "pre_packaged_commodity",
     ["consumer_care_contact"],
     ["consumer care", "customer care helpline", "email address", "telephone number", "address"],
     ("Rule 6", "sub-rule (1)", "clause (g)", None, 13)),
    ("LM_ORIGIN_001", "Country of Origin declaration for imported goods", "conditional_presence",
     "imported_pre_packaged_commodity",
     ["country_of_origin_text"],
     ["country of origin", "imported package", "made in"],
     ("Rule 6", "sub-rule (1)", "clause (b)", None, 9)),
    ("LM_GENERIC_001", "Generic or Common Name declaration", "presence", "pre_packaged_commodity",
     ["generic_name_text"],
     ["generic name", "common name of commodity"],
     ("Rule 6", "sub-rule (1)", "clause (c)", None, 9)),
    ("LM_SIZE_001", "Height of Numerals and Letters in Declarations", "measurement_format", "pre_packaged_commodity",
     ["declaration_height_mm", "package_area_cm2"],
     ["height of numeral", "font size mm", "Schedule II", "principal display panel"],
     ("Rule 7", "sub-rule (1)", None, "Schedule II", 24)),
]

# Rules: rule_id, rule_name, rule_number, mandatory, description, keywords.
RULES = [
    ("LMR_RULE_06_1_A", "Manufacturer Name and Address Declaration", "Rule 6(1)(a)", True,
     "Every package shall bear thereon the name and address of the manufacturer or packer or importer.",
     ["manufacturer", "packer", "importer", "address", "name"]),
    ("LMR_RULE_06_1_B", "Country of Origin Declaration", "Rule 6(1)(b)", True,
     "Every imported package shall bear the name of the country of origin.",
     ["country of origin", "imported", "made in"]),
    ("LMR_RULE_06_1_C", "Generic or Common Name Declaration", "Rule 6(1)(c)", True,
     "The common or generic names of the commodity contained in the package.",
     ["generic name", "common name", "commodity"]),
    ("LMR_RULE_06_1_D", "Net Quantity Declaration", "Rule 6(1)(d)", True,
     "Net quantity, in terms of standard unit of weight or measure or number.",
     ["net quantity", "net wt", "net volume", "g", "kg", "ml", "l"]),
    ("LMR_RULE_06_1_E", "Month and Year of Manufacture", "Rule 6(1)(e)", True,
     "The month and year in which the commodity is manufactured or pre-packed or imported.",
     ["mfg", "mfd", "packing date", "month", "year"]),
    ("LMR_RULE_06_1_F", "Maximum Retail Price (MRP)", "Rule 6(1)(f)", True,
     "The maximum retail price at which the package may be sold to ultimate consumer inclusive of all taxes.",
     ["mrp", "maximum retail price", "incl of all taxes", "rs", "rupees"]),
    ("LMR_RULE_06_1_G", "Consumer Care Details", "Rule 6(1)(g)", True,
     "Name, address, telephone number, e-mail address of the person or office who can be contacted in case of consumer complaints.",
     ["consumer care", "customer care", "helpline", "email", "phone"]),
]

FSSAI_RULES = [
    ("FSSAI_LIC_01", "FSSAI License / Registration Number", "FSSAI Labelling Regulation 2.2.1", True,
     "FSSAI logo and 14-digit license number must be displayed on the principal display panel of pre-packaged food.",
     ["fssai", "lic no", "license number", "fssai logo"]),
    ("FSSAI_NUT_02", "Nutritional Information Declaration", "FSSAI Labelling Regulation 2.2.2", True,
     "Nutritional facts per 100g or per serving including energy, protein, carbohydrate, total sugar, added sugar, and fat.",
     ["nutritional information", "nutrition facts", "energy", "protein", "carbohydrates", "fat"]),
    ("FSSAI_VEG_03", "Veg / Non-Veg Symbol Declaration", "FSSAI Labelling Regulation 2.2.3", True,
     "Green filled circle inside green square for Vegetarian, or Brown filled triangle inside brown square for Non-Vegetarian food.",
     ["veg", "non-veg", "vegetarian", "non-vegetarian", "green dot", "brown dot"]),
]

CHECK_KEYS = [
    "check_id", "domain", "requirement_name", "check_type", "applies_to",
    "required_observations", "query_terms", "legal_sources",
]
CHECK_SOURCE_KEYS = ["document", "rule", "sub_rule", "clause", "schedule", "page"]
RULE_KEYS = ["rule_id", "rule_name", "rule_number", "mandatory", "description", "keywords"]


def check_rows():
    """Checks as nested rows ready for ``createDataFrame``."""
    for check_id, name, kind, applies_to, seen, terms, source in CHECKS:
        yield (check_id, "legal_metrology", name, kind, applies_to, seen, terms, [(_RULES_2011, *source)])
