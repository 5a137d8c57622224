"""The compliance intent catalogue.

Columns: intent_id, requirement_name, rule_target, object, facets, context,
entities, attributes, positive_signals, negative_signals, semantic_aliases.
"""

INTENTS = [
    ("consumer_complaint_contact", "Consumer Complaint Contact Details", "Rule 6(2)", "consumer_complaint",
     ["contact", "consumer_care", "grievance"], "PACKAGE_LABEL",
     ["consumer", "customer", "complaint", "complaints", "grievance", "grievances", "helpline", "contact", "care", "support"],
     ["name", "address", "telephone", "phone", "email", "e-mail", "office", "number"],
     ["consumer care", "customer care", "helpline", "complaint", "grievance", "contact information", "email and phone"],
     [],
     ["consumer care details", "customer care details", "helpline details", "complaint contact", "grievance contact",
      "customer contact information", "consumer contact information",
      "helpline email and contact for customer grievances", "where can customers complain",
      "telephone and email for customer complaints", "consumer care telephone number",
      "helpline details for complaints", "contact information for consumer grievances",
      "customer care email and phone", "complaint helpline on package",
      "where should grievance contact details be printed"]),
    ("mrp_declaration", "Maximum Retail Price (MRP) Declaration", "Rule 6(1)(e)", "mrp",
     ["declaration_presence", "price_display"], "PACKAGE_LABEL",
     ["mrp", "price", "retail", "tax", "taxes", "cost", "charge", "sale", "display"],
     ["maximum retail price", "inclusive of all taxes", "rs", "rupees", "max retail price", "price display"],
     ["mrp", "retail sale price", "inclusive of all taxes", "maximum retail price", "price display rules"],
     ["advertisement", "advertising", "media release", "wholesale"],
     ["mrp declaration", "retail sale price", "inclusive of all taxes", "maximum retail price inclusive of taxes",
      "what must be printed as mrp", "can mrp include all taxes", "price declaration on package",
      "price display rules for pre-packed goods", "retail price inclusive of all taxes notice"]),
    ("net_quantity", "Net Quantity Declaration", "Rule 6(1)(c)", "net_quantity",
     ["declaration_presence", "weight_volume_count"], "PACKAGE_LABEL",
     ["net quantity", "net weight", "net volume", "weight", "volume", "measure", "count", "quantity", "contents", "unit"],
     ["standard unit", "grams", "kg", "liters", "ml", "number", "standard unit requirements"],
     ["net quantity", "net weight", "net volume", "net weight notice"],
     ["advertisement", "advertising", "font size", "numeral height", "clear space", "wrapper exclusion", "when packed",
      "multi-pack", "wholesale", "si units", "exaggerated", "misleading"],
     ["net quantity declaration", "net content notice", "how should net quantity be declared",
      "how should net quantity be written", "declaration of net weight or volume",
      "standard unit requirements for net content", "how should net quantity be written on package"]),
    ("country_of_origin", "Country of Origin Declaration", "Rule 6(1)(aa)", "country_of_origin",
     ["declaration_presence", "origin_country"], "IMPORT_PACKAGE",
     ["country of origin", "origin", "imported", "import", "manufacture", "assembly"],
     ["made in", "country name", "imported product", "place of manufacture"],
     ["country of origin", "imported goods", "imported commodity", "manufactured or assembled"],
     [],
     ["country of origin labeling", "country of origin for imported goods",
      "where was imported commodity manufactured or assembled", "country of assembly declaration"]),
    ("importer_manufacturer_details", "Manufacturer or Importer Name and Address", "Rule 6(1)(a)",
     "manufacturer_importer_details", ["declaration_presence", "name_address"], "PACKAGE_LABEL",
     ["manufacturer", "packer", "importer", "company", "maker", "seller"],
     ["name", "address", "location"],
     ["name and address", "manufacturer address", "importer details", "packer name and address"],
     ["wholesale", "registration"],
     ["manufacturer address", "importer details", "packer name and address",
      "what information is required for an imported package", "name and address of manufacturer or importer"]),
    ("numeral_height", "Minimum Height of Numerals and Letters", "Rule 7(2)", "numeral_height",
     ["font_size", "numeral_height", "letter_size"], "PACKAGE_LABEL",
     ["height", "size", "numeral", "numerals", "letter", "letters", "font", "dimension"],
     ["principal display panel", "table i", "table ii", "mm", "minimum height", "font height"],
     ["height of numeral", "minimum letter size", "font size requirement", "letter size specifications",
      "font height requirement"],
     ["advertisement", "advertising", "media release", "wholesale"],
     ["minimum letter size", "font size requirement", "numeral height", "letter size specifications on display panel",
      "font height requirement for net quantity and mrp", "what is the minimum height of numerals"]),
    ("wholesale_package_declaration", "Wholesale Package Declarations", "Rule 24(a)", "wholesale_package",
     ["wholesale_declaration", "name_address"], "WHOLESALE_PACKAGE",
     ["wholesale", "bulk", "distributor", "outer container"],
     ["manufacturer", "importer", "name and address", "bulk wholesale"],
     ["wholesale package", "bulk wholesale package", "wholesale container labeling", "rules for wholesale"],
     ["retail sale", "consumer complaint"],
     ["wholesale container labeling", "wholesale package details", "rules for wholesale container labeling",
      "declarations on bulk wholesale package", "what declarations are required on a wholesale package"]),
    ("manufacture_packing_date", "Month and Year of Manufacture or Pre-packing", "Rule 6(1)(d)",
     "manufacture_packing_date", ["declaration_presence", "mfg_date"], "PACKAGE_LABEL",
     ["manufacture", "packing", "mfg", "mfd", "date", "month", "year"],
     ["pre-packed", "import date"],
     ["month and year of manufacture", "packing date", "mfg date"],
     [],
     ["month and year of manufacture", "packing date declaration", "mfg date requirement"]),
    ("best_before_date", "Best Before or Use By Date", "Rule 6(1)(da)", "best_before_date",
     ["declaration_presence", "expiry_date"], "PACKAGE_LABEL",
     ["best before", "use by", "expiry", "expiration", "perishable", "spoilage"],
     ["date", "month", "year"],
     ["best before", "use by date", "expiry date"],
     [],
     ["best before or use by date requirement for perishable items", "expiry date declaration", "use by date rule"]),
    ("principal_display_panel", "Principal Display Panel Location and Clear Space", "Rule 8(1)",
     "principal_display_panel", ["placement", "spacing", "clear_space"], "PACKAGE_LABEL",
     ["principal display panel", "pdp", "location", "clear space", "surrounding"],
     ["display panel", "front panel", "package area", "net quantity declaration"],
     ["principal display panel be located", "clear space surrounding", "pdp location",
      "clear space surrounding net quantity declaration", "net quantity placement"],
     ["font height", "numeral height", "table i", "table ii"],
     ["where must the principal display panel be located", "clear space surrounding quantity declaration",
      "clear space surrounding net quantity declaration", "pdp location rule", "net quantity placement"]),
    ("mrp_color_contrast", "Color Contrast for MRP and Net Quantity", "Rule 9(1)(b)", "color_contrast",
     ["legibility", "color_contrast"], "PACKAGE_LABEL",
     ["contrast", "color", "background", "conspicuous", "legibility"],
     ["numerals", "letters", "mrp", "net quantity"],
     ["contrast and color legibility", "background color contrast", "conspicuous contrast"],
     [],
     ["contrast and color legibility for price declarations", "background color contrast for mrp",
      "conspicuous contrast requirement"]),
    ("transparent_packaging_visibility", "Packaging Visibility Through Transparent Container or Liquid", "Rule 9(2)",
     "transparent_packaging", ["wrapper_visibility", "reading_through"], "PACKAGE_LABEL",
     ["transparent", "liquid", "wrapper", "container", "visibility", "reading"],
     ["reading through liquid", "clear packaging"],
     ["transparent outer wrapper visibility", "reading through liquid", "transparent packaging contents",
      "visibility through transparent container"],
     [],
     ["transparent outer wrapper visibility requirements", "reading through liquid or transparent packaging",
      "visibility through transparent container"]),
    ("outer_wrapper_container_declaration", "Outer Wrapper or Container Mandatory Declarations", "Rule 9(3)",
     "outer_wrapper", ["outer_wrapper_declarations", "placement"], "PACKAGE_LABEL",
     ["outer wrapper", "container", "wrapper"],
     ["mandatory declarations", "appear on outer wrapper"],
     ["outer wrapper declarations", "declarations shall appear on such outer wrapper", "provided with an outer wrapper"],
     ["transparent", "reading through liquid"],
     ["outer wrapper declarations", "declarations on outer container or wrapper"]),
    ("net_quantity_packaging_exclusion", "Net Quantity Exclusion of Wrapper Weight", "Rule 11(1)", "wrapper_exclusion",
     ["tare_weight", "wrapper_exclusion"], "PACKAGE_LABEL",
     ["wrapper", "wrappers", "packaging material", "exclude", "exclusion", "tare"],
     ["net quantity", "exclude wrappers"],
     ["exclusion of wrapper weight", "exclude wrappers and packaging materials", "wrapper weight exclusion"],
     ["transparent outer wrapper visibility"],
     ["exclusion of wrapper weight from net content", "net quantity declaration shall exclude wrappers",
      "wrapper weight exclusion"]),
    ("net_quantity_when_packed", "Net Quantity When Packed Qualification (Third Schedule)", "Rule 11(4)", "when_packed",
     ["when_packed_qualification", "third_schedule"], "PACKAGE_LABEL",
     ["when packed", "third schedule", "schedule iii", "qualification"],
     ["commodities specified in third schedule"],
     ["when packed qualification", "third schedule commodities when packed", "schedule iii commodities when packed"],
     [],
     ["third schedule commodities when packed", "schedule iii commodities when packed", "when packed qualification"]),
    ("manner_of_standard_units", "Manner and Units of Net Quantity Declaration", "Rule 12(1)", "standard_unit_manner",
     ["unit", "manner_of_declaration"], "PACKAGE_LABEL",
     ["standard unit", "unit requirement", "weight measure number", "appropriate standard unit"],
     ["use appropriate standard unit", "unit of weight measure or number"],
     ["net quantity unit requirement", "appropriate standard unit", "use appropriate standard unit"],
     [],
     ["net quantity unit requirement", "appropriate standard unit for net quantity"]),
    ("misleading_net_quantity", "Exaggerated or Misleading Net Quantity Presentation", "Rule 12(6)",
     "misleading_quantity", ["deceptive", "misleading", "exaggerated"], "PACKAGE_LABEL",
     ["exaggerated", "misleading", "impression", "deceptive"],
     ["exaggerated or misleading impression"],
     ["exaggerated or misleading", "misleading net quantity", "create an exaggerated impression"],
     [],
     ["exaggerated or misleading net quantity presentation", "misleading net quantity declaration"]),
    ("si_units_net_quantity", "SI Units Mandatory for Net Quantity Symbols", "Rule 13(5)", "si_units",
     ["si_units", "unit"], "PACKAGE_LABEL",
     ["si units", "symbols", "international system of units", "si"],
     ["net quantity symbols", "si units mandatory"],
     ["si units mandatory", "net quantity symbols", "international system of units"],
     [],
     ["are si units mandatory for net quantity symbols", "si unit symbols for net quantity"]),
    ("multi_pack_quantity", "Multi-pack Net Quantity Declaration", "Rule 13(6)", "multi_pack",
     ["multipack", "individual_total_quantity"], "MULTIPACK",
     ["multi-pack", "multipack", "multiple packages", "outer package", "individual", "total"],
     ["individual quantity", "total quantity"],
     ["multi-pack net quantity", "multiple packages of same commodity", "multipack quantity declaration",
      "multiple retail packages"],
     ["wholesale", "bulk wholesale package"],
     ["what is the rule for multi-pack net quantity", "multiple packages of same commodity contained in outer package",
      "multipack quantity declaration", "multiple retail packages"]),
    ("sheet_count_dimensions", "Dimensions and Sheet Count for Paper or Plastic Sheets", "Rule 16",
     "paper_plastic_sheets", ["sheet_count", "sheet_dimensions"], "PACKAGE_LABEL",
     ["paper", "plastic", "sheets", "sheet count", "dimensions"],
     ["exact sheet count and dimensions", "specified paper or plastic sheets"],
     ["plastic or paper sheets", "dimensions and sheet count", "sheet count and dimensions"],
     [],
     ["dimensions and sheet count for plastic or paper sheets", "paper or plastic sheet count"]),
    ("mandatory_registration", "Mandatory Registration of Manufacturer, Packer, Importer", "Rule 27", "registration",
     ["registration", "director_controller"], "GENERAL_QUANTITY",
     ["registration", "register", "director", "controller", "legal metrology"],
     ["mandatory registration", "packer", "importer", "manufacturer"],
     ["mandatory registration", "registration with director", "legal metrology registration"],
     [],
     ["mandatory registration for packers and importers", "registration with director of legal metrology",
      "legal metrology registration rule"]),
    ("advertisement_declaration", "Net Quantity in Advertisement", "Rule 31(1)", "advertisement",
     ["advertisement_declaration"], "ADVERTISEMENT",
     ["advertisement", "advertising", "media release", "tv", "newspaper", "commercial"],
     ["net quantity in advertisement", "retail sale price in advertisement"],
     ["advertisement mentioning retail sale price", "media release", "advertising net quantity"],
     [],
     ["advertisement net quantity requirement", "media release indicating retail sale price",
      "advertising net quantity"]),
    ("advertisement_font_size", "Net Quantity Font Size in Advertisement", "Rule 31(2)", "advertisement",
     ["advertisement_font_size"], "ADVERTISEMENT",
     ["advertisement", "advertising", "font size", "price font"],
     ["font size in advertisement", "equal to or larger than retail price font size"],
     ["advertisement font size", "font size in advertisement"],
     [],
     ["font size in advertisement", "net quantity font size in advertisement",
      "advertisement price font size comparison"]),
]

COLUMNS = [
    "intent_id", "requirement_name", "rule_target", "object", "facets", "context", "entities", "attributes",
    "positive_signals", "negative_signals", "semantic_aliases",
]


def intent_rows():
    """The catalogue as dictionaries, in catalogue order."""
    return [dict(zip(COLUMNS, row)) for row in INTENTS]
