"""Patterns for citations, page structure and amendment notes."""

SCHEDULE_REF = (
    r"\b(?:schedule\s+(vii|vi|v|iv|iii|ii|i|\d+|1st|2nd|3rd|4th|5th|6th|7th)"
    r"|(first|second|third|fourth|fifth|sixth|seventh)\s+schedule)\b"
)
RULE_CLAUSE_REF = r"\brule\s+(\d+)\s*\(\s*(\d+)\s*\)\s*\(\s*([a-z]{1,2})\s*\)"
RULE_SUB_REF = r"\brule\s+(\d+)\s*\(\s*(\d+)\s*\)"
RULE_LETTER_REF = r"\brule\s+(\d+)\s*\(\s*([a-z]{1,2})\s*\)"
RULE_REF = r"\brule\s+(\d+)\b"
SHORT_LETTER_REF = r"\b(\d+)\s*\(\s*([a-z]{1,2})\s*\)\b"
SECTION_REF = r"\bsection\s+(\d+)(?:\s*\(\s*(\d+)\s*\))?"

PAGE_RULE = r"Rule\s+(\d+)\.?"
PAGE_SCHEDULE = r"Schedule\s+([I|V|X]+|\d+)"

# Groups: prefix, action, notification number, date, effective-from.
AMENDMENT = (
    r"([\*\#\d\$\@]+)?\s*(Substituted|amended|Omitted|Inserted|Replaced)?(?:\s*/\s*amended)?\s*vide\s*"
    r"(?:G\.?S\.?R\.?|GSR)?\s*([\d\w\(\)]+)\s*(?:dated\s*)?([0-9a-zA-Z\s,]+?)"
    r"(?:(?:\,\s*|(?:\s*came\s*into\s*force\s*)?)w\.?e\.?f\.?\s*"
    r"([0-9\.\/a-zA-Z]+(?:\s*\(now\s*w\.e\.f\s*[0-9\.\/a-zA-Z\s\(\)E\d\.\,]+)?))?"
)
AMENDMENT_WORDS = ["vide", "gsr", "substituted", "omitted"]
OMISSION_WORDS = ["omitted", "repealed"]
