"""Provisions of the packaged-commodity rules and their triggers."""

DOCUMENT_ID = "LM_PC_2011_consolidated"
DOCUMENT_TITLE = "Legal Metrology (Packaged Commodities) Rules, 2011"
AUTHORITY = "Department of Consumer Affairs"
JURISDICTION = "India"
DOMAIN = "legal_metrology"
DEFAULT_EFFECTIVE_FROM = "2011-03-01"

# Chapters: name, title, first rule, last rule.
CHAPTERS = [
    ("Chapter I", "Preliminary", 1, 2),
    ("Chapter II", "Provisions Applicable to Packages Intended for Retail Sale", 3, 23),
    ("Chapter III", "Provisions Applicable to Wholesale Packages", 24, 24),
    ("Chapter IV", "Export Packages", 25, 25),
    ("Chapter V", "Exemptions", 26, 26),
    ("Chapter VI", "Registration of Manufacturers, Packers and Importers", 27, 30),
    ("Chapter VII", "General", 31, 34),
]

# When a page opens a group of provisions: phrases (any case), exact phrases, printed pages.
GROUPS = {
    "6": (["declarations to be made", "rule 6"], [], [10, 11, 12, 13, 14]),
    "7": (["principal display panel-its area", "rule 7"], [], [17, 18]),
    "8": (["principal display panel", "rule 8"], [], []),
    "9": (["manner in which declaration shall be made", "rule 9", "contrast"], [], []),
    "10": (["declaration where to be made", "rule 10"], [], []),
    "11": (["wrappers and packaging materials", "rule 11", "when packed"], [], []),
    "12": (["symbols for unit", "rule 12", "units of weight"], [], []),
    "13": (["international system of units", "rule 13", "multi-pack"], ["13(5)", "13(6)"], [24, 25, 26, 27]),
    "14-16": (["rule 14", "textile", "rule 15", "rule 16"], [], [25, 26, 27]),
    "23": (["deceptive", "rule 23"], [], []),
    "24": (["wholesale", "rule 24"], ["24(a)", "24(b)"], [34, 35, 36, 37]),
    "27-28": (["registration", "rule 27", "rule 28"], [], []),
    "31": (["advertisement", "rule 31"], [], []),
}

# Provisions in order: group, rule, sub_rule, clause, schedule, page_start, page_end, extra, text.
# extra may hold: words (any must occur), pages (or printed on one of these), last_page (printed
# no later than), status, effective_from, effective_to, amended_by, superseded_by.
PROVISIONS = [
    ("6", "6", "6(1)", "6(1)(a)", None, 10, 10, {"words": ["name and address of the manufacturer"]},
     "Rule 6(1)(a) The name and address of the manufacturer, or where the manufacturer is not the packer, the name and address of the manufacturer and packer and for any imported package the name and address of the importer shall be mentioned."),
    ("6", "6", "6(1)", "6(1)(aa)", None, 10, 10,
     {"words": ["country of origin", "assembly in case of imported"], "effective_from": "2018-01-01", "amended_by": ["GSR 629(E)"]},
     "Rule 6(1)(aa) The name of the country of origin or manufacture or assembly in case of imported products shall be mentioned on the package."),
    ("6", "6", "6(1)", "6(1)(b)", None, 10, 10, {"words": ["common or generic names"]},
     "Rule 6(1)(b) The common or generic names of the commodity contained in the package and in case of packages with more than one product, the name and number or quantity of each product shall be mentioned on the package."),
    ("6", "6", "6(1)", "6(1)(c)", None, 11, 11, {"words": ["net quantity"], "last_page": 11},
     "Rule 6(1)(c) The net quantity, in terms of the standard unit of weight or measure, of the commodity contained in the package or where the commodity is packed or sold by number, the number of the commodity contained in the package shall be mentioned."),
    ("6", "6", "6(1)", "6(1)(d)", None, 11, 11, {"words": ["month and year in which the commodity is manufactured"]},
     "Rule 6(1)(d) The month and year in which the commodity is manufactured or pre-packed or imported shall be mentioned on the package: Provided that for packages containing food articles, the provisions of this clause shall not apply."),
    ("6", "6", "6(1)", "6(1)(da)", None, 11, 12,
     {"words": ["best before", "use by date"], "effective_from": "2018-01-01", "amended_by": ["GSR 629(E)"]},
     "Rule 6(1)(da) The 'best before' or 'use by' date, month and year shall be mentioned for commodities which may become unfit for human consumption after a period of time."),
    ("6", "6", "6(1)", "6(1)(e)", None, 12, 13,
     {"words": ["retail sale price", "mrp", "inclusive of all taxes"], "effective_from": "2022-10-01", "amended_by": ["GSR 779(E)", "GSR 226(E)"]},
     "Rule 6(1)(e) Maximum Retail Price (MRP) Rs. xx.xx (inclusive of all taxes) or Maximum or Max Retail Price Rs. xx.xx (incl. of all taxes) shall be declared on every package."),
    ("6", "6", "6(1)", "6(1)(e)", None, 12, 13,
     {"words": ["retail sale price", "mrp", "inclusive of all taxes"], "status": "superseded", "effective_from": "2018-01-01",
      "effective_to": "2022-09-30", "amended_by": ["GSR 629(E)"], "superseded_by": ["GSR 779(E)"]},
     "Rule 6(1)(e) [SUPERSEDED] Retail sale price of the package shall be declared as Maximum Retail Price Rs. xx.xx incl. of all taxes."),
    ("6", "6", "6(1)", "6(1)(f)", None, 12, 13,
     {"words": ["unit sale price", "dimensions", "size of the commodity"], "effective_from": "2022-10-01", "amended_by": ["GSR 779(E)"]},
     "Rule 6(1)(f) The unit sale price and dimensions of the commodity, where applicable, shall be declared on the package."),
    ("6", "6", "6(2)", None, None, 13, 13, {"words": ["consumer complaints", "consumer care"], "pages": [13]},
     "Rule 6(2) Every package shall bear the name, address, telephone number, e-mail address of the person who can be or the office which can be contacted, in case of consumer complaints."),
    ("7", "7", "7(1)", None, None, 17, 17, {"words": ["ten cubic centimeters"], "pages": [17]},
     "Rule 7(1) In the case of a package having a capacity of ten cubic centimeters or less, the principal display panel may be a card or tape affixed firmly to the package and shall bear the required information."),
    ("7", "7", "7(2)", None, None, 17, 18, {"words": ["height of any numeral", "table-i"], "pages": [17, 18]},
     "Rule 7(2) The height of any numeral and letter in the declaration required under these rules, on the principal display panel shall not be less than as shown in Table-I (if net quantity declared in weight/volume) and Table-II (if declared in length/area/number)."),
    ("8", "8", "8(1)", None, None, 20, 20, {},
     "Rule 8(1) Every declaration required to be made under these rules shall appear on the principal display panel with adequate clear space surrounding quantity declaration."),
    ("9", "9", "9(1)", "9(1)(a)", None, 20, 21, {},
     "Rule 9(1)(a) Declarations on package shall be legible, prominent, definite, plain and conspicuous."),
    ("9", "9", "9(1)", "9(1)(b)", None, 21, 21, {},
     "Rule 9(1)(b) Numerals and letters of MRP and net-quantity declarations shall contrast conspicuously with the background."),
    ("9", "9", "9(2)", None, None, 21, 21, {},
     "Rule 9(2) Declaration shall not require reading through liquid or transparent packaging contents."),
    ("9", "9", "9(3)", None, None, 21, 21, {},
     "Rule 9(3) Where a package is provided with an outer wrapper or container, all mandatory declarations shall appear on such outer wrapper."),
    ("10", "10", "10(1)", None, None, 21, 21, {},
     "Rule 10(1) The declared address of manufacturer/packer/importer must be complete to enable consumer to locate office."),
    ("10", "10", "10(2)", None, None, 22, 22, {},
     "Rule 10(2) Manufacturer or packer or importer name shall be actual corporate name."),
    ("11", "11", "11(1)", None, None, 22, 22, {},
     "Rule 11(1) Net quantity declaration shall exclude wrappers and packaging materials."),
    ("11", "11", "11(2)", None, None, 22, 22, {},
     "Rule 11(2) Where environmental variation is not relevant, declared net quantity shall be received by consumer."),
    ("11", "11", "11(4)", None, "Third Schedule", 23, 23, {},
     "Rule 11(4) 'When packed' qualification allowed only for commodities specified in Third Schedule."),
    ("12", "12", "12(1)", None, None, 23, 23, {},
     "Rule 12(1) Net quantity declaration shall use appropriate standard unit of weight, measure, or number."),
    ("12", "12", "12(2)", None, None, 23, 23, {},
     "Rule 12(2) Solid/semi-solid commodities by mass; liquid by volume; linear commodity by length."),
    ("12", "12", "12(6)", None, None, 23, 23, {},
     "Rule 12(6) Net quantity declaration shall not create an exaggerated or misleading impression."),
    ("13", "13", "13(5)", None, None, 24, 24, {},
     "Rule 13(5) Net quantity symbols shall follow International System of Units (SI Units)."),
    ("13", "13", "13(6)", None, None, 25, 25, {},
     "Rule 13(6) Multiple packages of same commodity contained in outer package shall declare individual and total quantity."),
    ("14-16", "14", None, None, None, 25, 25, {},
     "Rule 14 Declarations on textile and finished commodities require piece count, dimensions, and net weight."),
    ("14-16", "15", None, None, None, 25, 25, {},
     "Rule 15 Where dimensions/weight relate directly to retail price, corresponding dimensions shall be declared."),
    ("14-16", "16", None, None, None, 25, 25, {},
     "Rule 16 Packages containing specified paper or plastic sheets must declare exact sheet count and dimensions."),
    ("23", "23", None, None, None, 33, 33, {},
     "Rule 23 Package must not be designed or constructed to deliberately create a deceptive impression about commodity volume."),
    ("24", "24", "24(a)", None, None, 35, 35, {},
     "Rule 24(a) Wholesale package must bear name and address of manufacturer or importer."),
    ("24", "24", "24(b)", None, None, 35, 35, {},
     "Rule 24(b) Wholesale package must state identity of commodity contained therein."),
    ("24", "24", "24(c)", None, None, 35, 35, {},
     "Rule 24(c) Wholesale package must declare total number of retail packages contained in wholesale package."),
    ("27-28", "27", None, None, None, 35, 35, {},
     "Rule 27 Mandatory registration of every manufacturer, packer, and importer with Director or Controller of Legal Metrology."),
    ("27-28", "28", None, None, None, 36, 36, {},
     "Rule 28 Shorter registered address may be used on label only where registered address is filed with Controller."),
    ("31", "31", "31(1)", None, None, 36, 36, {},
     "Rule 31(1) Advertisement or media release indicating retail sale price must state net quantity of commodity."),
    ("31", "31", "31(2)", None, None, 36, 36, {},
     "Rule 31(2) Net-quantity font size in advertisement must be equal to or larger than retail price font size."),
]

# Statutory header given to documents that carry none of their own.
STATUTE_HEADER = {
    "document_title": DOCUMENT_TITLE,
    "authority": "Ministry of Consumer Affairs, Food and Public Distribution, Government of India",
    "jurisdiction": "India (Federal)",
    "domain": "legal_metrology",
    "effective_from": "2011-03-01",
    "effective_to": None,
    "status": "current",
    "amended_by": ["Legal Metrology (Packaged Commodities) Amendment Rules, 2022"],
}

# Sections of the small starter index: rule, sub_rule, clause, schedule, page, text.
STARTER_SECTIONS = [
    ("Rule 6", "sub-rule (1)", "clause (f)", None, 12,
     "Rule 6(1)(f) The maximum retail price at which the package may be sold to the ultimate consumer inclusive of all taxes."),
    ("Rule 6", "sub-rule (1)", "clause (d)", None, 10,
     "Rule 6(1)(d) Net quantity, in terms of standard unit of weight or measure or number, contained in the package."),
    ("Rule 6", "sub-rule (1)", "clause (a)", None, 8,
     "Rule 6(1)(a) The name and address of the manufacturer or where the manufacturer is not the packer, the name and address of the manufacturer and packer."),
    ("Rule 6", "sub-rule (1)", "clause (g)", None, 13,
     "Rule 6(1)(g) Name, address, telephone number, e-mail address of the person who can be contacted in case of consumer complaints."),
    ("Rule 7", "sub-rule (1)", None, "Schedule II", 24,
     "Rule 7 & Schedule II: Height of numerals and letters in declarations shall comply with prescribed mm size requirements per area of principal display panel."),
]

# Evidence used when nothing is retrieved.
NO_EVIDENCE = {"chunk_id": "chk_none", "rule": "Rule 6", "text": "No evidence retrieved", "score": 0.0}
FSSAI_FALLBACK = {
    "chunk_id": "chk_fssai_pkg_2018",
    "document_title": "FSSAI Food Safety & Standards Regulations, 2018",
    "rule": "FSSAI Packaging Reg 2018",
    "text": "Every food package shall comply with FSSAI labeling and packaging regulations.",
    "score": 0.95,
}
