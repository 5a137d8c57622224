"""Word lists and patterns for reading declarations off a label.

Everything in this module is a fixed value that results depend on.  Patterns
use Unicode classes and ignore case; ``functions.text.rx`` adds the flags.
"""

# Price: a labelled amount first, a bare currency amount second.
MRP = [
    r"(?:M\.?R\.?P\.?|MAX(?:IMUM)?\s*RETAIL\s*PRICE)[^\d₹Rs]*[₹Rs\.]*\s*([0-9]+(?:[\.,][0-9]{1,2})?)",
    r"(?:₹|Rs\.?)\s*([0-9]+(?:[\.,][0-9]{1,2})?)",
]

# Net quantity: NET + number + unit, number + unit + NET, bare number + unit.
NET_QUANTITY = [
    r"(?:NET\s*(?:QTY|QUANTITY|WT|WEIGHT|CONTENT)?)[^\d]*([0-9]+(?:\.[0-9]+)?)\s*(kg|g|gm|gms|mg|l|ltr|litres?|ml|piece|pieces|pcs|count|u|units?)\b",
    r"\b([0-9]+(?:\.[0-9]+)?)\s*(kg|g|gm|gms|l|ltr|ml)\s*(?:NET\s*(?:QTY|QUANTITY|WT|WEIGHT|CONTENT)?)\b",
    r"\b([0-9]+(?:\.[0-9]+)?)\s*(kg|g|gm|gms|l|ltr|ml)\b",
]

UNIT_ALIASES = {"gm": "g", "gms": "g", "ltr": "l", "litre": "l", "litres": "l"}

MFG_DATE = [
    r"(?:MFD|MFG|PACKED|PKD|DATE\s*OF\s*(?:MFG|PACKING))[^\d]*([0-9]{1,2}[\/\-\.][0-9]{1,2}[\/\-\.][0-9]{2,4}|[A-Za-z]{3,9}\s*['\.]?\s*[0-9]{2,4}|[0-9]{1,2}\s*[A-Za-z]{3,9}\s*[0-9]{2,4})",
]

EXPIRY_DATE = [
    r"(?:EXP(?:IRY)?|USE\s*BY|BEST\s*BEFORE)[^\d]*([0-9]{1,2}[\/\-\.][0-9]{1,2}[\/\-\.][0-9]{2,4}|[A-Za-z]{3,9}\s*['\.]?\s*[0-9]{2,4}|[0-9]{1,2}\s*[A-Za-z]{3,9}\s*[0-9]{2,4}|[0-9]+\s*MONTHS?)",
]

FSSAI_LICENSE = [
    r"(?:FSSAI|LIC(?:ENCE)?\s*(?:NO\.?)?)[^\d]*([12]\d{13})",
    r"\b([12]\d{13})\b",
]

BATCH_NUMBER = [
    r"(?:BATCH|LOT|B\.?\s*NO\.?)[^\w]*([A-Z0-9\-\/]+)",
]

# Consumer care: e-mail address first, phone number second.
CONSUMER_CARE = [
    r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)",
    r"(?:TOLL\s*FREE|HELPLINE|CALL|CARE)[^\d]*(\d{3,5}[-\s]?\d{3,4}[-\s]?\d{3,4}|\d{10,11})",
]

INS_CODE = r"(?:INS\s*|E\s*|\()([0-9]{3,4}[a-z]?(?:\([i-v]+\))?)\)?"

ALLERGENS = [
    "wheat", "gluten", "milk", "dairy", "soy", "soya", "peanut", "peanuts",
    "tree nuts", "almond", "cashew", "mustard", "sulphite", "sulphites", "sesame", "egg", "fish",
]

INGREDIENT_HEADER = r"(?:[in1l][ng]{1,2}r[e3]d[ie1][e3]n?t[es]{1,3}|ingredients?)\s*[:\-\.]?"
INGREDIENT_STOP = (
    r"(?:nutritio\w*|typical\s*values|serving\s*size|good\s*to\s*know|how\s*to\s*prepare|cook\s*any\s*dish"
    r"|mfg|mrp|packed\s*by|marketed\s*by|storage|keep\s*in\s*a\s*cool|tastes\s*best)"
)
INGREDIENT_SEPARATOR = r"[,;•\n\r]+|\.(?=\s*[A-Z])|\s{2,}"
INGREDIENT_NOISE = r"^(?:allergen\s*note:?|may\s*contain|contains:?)\s*"
INGREDIENT_TRIM = r" .;:\"'\-_"
INGREDIENT_MIN_CHARS = 3

# Commodity class: one point for each pattern that occurs.
FOOD_WORDS = [
    r"\bfssai\b", r"\bnutrition", r"\bingredients?\b", r"\bedible\b",
    r"\bcalories?\b", r"\bprotein\b", r"\bcarbohydrate\b", r"\badded sugars?\b",
    r"\bflavour\b", r"\bmasala\b", r"\bspices?\b", r"\bveg(an)?\b", r"\bnon-veg\b",
    r"\bserve\b", r"\benergy\b", r"\bwheat\b", r"\boil\b", r"\bfat\b",
]
DRUG_COSMETIC_WORDS = [
    r"\bmfg\s*lic\b", r"\bcosmetic\b", r"\bshampoo\b", r"\blotion\b",
    r"\bfor external use only\b", r"\bparaben\b", r"\bpharmaceutical\b",
    r"\bdose\b", r"\btablet\b", r"\bcapsule\b", r"\bophthalmic\b", r"\bointment\b",
]

# Order in which declarations are reported within one block.
FIELD_ORDER = ["mrp", "net_quantity", "fssai_license", "batch_number", "mfg_date", "expiry_date"]

# Words counted when choosing an image orientation.
ORIENTATION_WORDS = [
    "mrp", "rs", "inr", "net", "wt", "weight", "qty", "fssai", "lic",
    "mfd", "mfg", "exp", "batch", "ingredients", "nutrition", "india",
    "consumer", "use by", "best before", "product",
]
