"""The four record contracts, as JSON Schema."""

_TEXT = {"type": "string"}
_SHARE = {"type": "number", "minimum": 0.0, "maximum": 1.0}
_BOX = {"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 4}
_TEXT_OR_NULL = {"type": ["string", "null"]}
_PAGE = {"type": ["integer", "null"]}

OCR_OUTPUT = {
    "type": "object",
    "properties": {
        "image_id": _TEXT,
        "text_blocks": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "block_id": _TEXT, "text": _TEXT, "confidence": _SHARE, "bbox": _BOX,
                    "layout": {"type": "object", "properties": {"font_height_px": {"type": "number"}, "position": _TEXT}},
                },
                "required": ["text", "confidence", "bbox"],
            },
        },
    },
    "required": ["image_id", "text_blocks"],
}

FIELD_EXTRACTION = {
    "type": "object",
    "properties": {
        "image_id": _TEXT,
        "commodity_type": _TEXT,
        "extracted_fields": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {"field_name": _TEXT, "raw_text": _TEXT, "normalized_value": _TEXT, "confidence": _SHARE, "bbox": _BOX},
                "required": ["field_name", "raw_text", "confidence"],
            },
        },
    },
    "required": ["image_id", "commodity_type", "extracted_fields"],
}

COMPLIANCE_CHECK = {
    "type": "object",
    "properties": {
        "check_id": _TEXT, "domain": _TEXT, "commodity_type": _TEXT, "field": _TEXT, "check_type": _TEXT,
        "query_terms": {"type": "array", "items": _TEXT},
    },
    "required": ["check_id", "domain", "commodity_type", "field", "query_terms"],
}

EVIDENCE_OUTPUT = {
    "type": "object",
    "properties": {
        "check_id": _TEXT, "chunk_id": _TEXT, "document": _TEXT, "rule": _TEXT,
        "sub_rule": _TEXT_OR_NULL, "clause": _TEXT_OR_NULL, "schedule": _TEXT_OR_NULL, "page": _PAGE,
        "text": _TEXT, "retrieval_score": _SHARE,
        "citation": {
            "type": "object",
            "properties": {
                "document": _TEXT, "rule": _TEXT, "sub_rule": _TEXT_OR_NULL, "clause": _TEXT_OR_NULL, "schedule": _TEXT_OR_NULL, "page": _PAGE,
            },
            "required": ["document", "rule"],
        },
    },
    "required": ["check_id", "chunk_id", "document", "rule", "text", "retrieval_score", "citation"],
}

CONTRACTS = {"ocr_output": OCR_OUTPUT, "field_extraction": FIELD_EXTRACTION, "compliance_check": COMPLIANCE_CHECK, "evidence_output": EVIDENCE_OUTPUT}
