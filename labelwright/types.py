"""Schemas of the records the operators read and write (Spark DDL)."""

BLOCK = (
    "struct<block_id:string,text:string,confidence:double,bbox:array<double>,"
    "font_height_px:int,layout_position:string>"
)

OCR_DOCUMENT = (
    "image_id string, "
    "text_blocks array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>, "
    "ocr_blocks array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>, "
    "blocks array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>"
)

# A bare list of blocks: one block per record, image unnamed.
OCR_BLOCK_RECORD = "block_id string, text string, confidence double, bbox array<double>"

FIELD = (
    "struct<field_name:string,raw_text:string,normalized_value:string,unit:string,"
    "confidence:double,bbox:array<double>>"
)

CHECK_QUERY = (
    "check_id string, domain string, commodity_type string, field string, check_type string, "
    "query_terms array<string>"
)

CHUNK = (
    "chunk_id string, document_id string, document_title string, authority string, jurisdiction string, "
    "domain string, chapter string, rule string, sub_rule string, clause string, schedule string, "
    "`table` string, page_start int, page_end int, effective_from string, effective_to string, "
    "status string, amended_by array<string>, supersedes array<string>, superseded_by array<string>, "
    "chunk_type string, text string"
)

# Columns every stored chunk has, in order.
CHUNK_COLUMNS = [
    "chunk_id", "document_id", "document_title", "authority", "jurisdiction", "domain", "chapter",
    "rule", "sub_rule", "clause", "schedule", "table", "page_start", "page_end", "effective_from",
    "effective_to", "status", "amended_by", "supersedes", "superseded_by", "chunk_type", "text",
]
CHUNK_ARRAYS = ["amended_by", "supersedes", "superseded_by"]

CHECK = (
    "check_id string, domain string, requirement_name string, check_type string, applies_to string, "
    "required_observations array<string>, query_terms array<string>, "
    "legal_sources array<struct<document:string,rule:string,sub_rule:string,clause:string,schedule:string,page:int>>"
)

RULE = (
    "rule_id string, rule_name string, rule_number string, mandatory boolean, description string, "
    "keywords array<string>"
)

INTENT = (
    "intent_id string, requirement_name string, rule_target string, object string, facets array<string>, "
    "context string, entities array<string>, attributes array<string>, positive_signals array<string>, "
    "negative_signals array<string>, semantic_aliases array<string>"
)

EVAL_CASE = "id string, category string, query string, expected_provisions array<string>, expected_schedule string"
