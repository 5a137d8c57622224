"""Registered queries and the SQL that says what they should return."""

from labelwright.queries import contracts, corpus, labels, layout, retrieval, streams, verdicts

_MODULES = (labels, layout, verdicts, contracts, corpus, retrieval, streams)

# Column types the SQL is cast to, so that both sides agree.
_CASTS = {
    "label_scan": {"n_issues": "INTEGER"},
    "field_verdict": {"shortest_reason": "INTEGER"},
    "issue_report": {"first_item": "INTEGER"},
    "inspection_report": {"n_items": "INTEGER"},
    "hierarchy_tree": {"n_entries": "INTEGER"},
    "unit_vectors": {"dimension": "INTEGER"},
    "oldest_chunks": {"score": "DOUBLE"},
    "bm25_documents": {"rank": "INTEGER"},
    "bm25_blocks": {"n_blocks": "BIGINT"},
    "orientation_turns": {"turn": "INTEGER"},
    "catalogue_open_targets": {"tier": "INTEGER"},
    "scan_evidence": {"evidence_ord": "INTEGER"},
    "bm25_provisions": {"rank": "INTEGER"},
    "dense_topk": {"rank": "INTEGER"},
    "dense_topk_streamed": {"rank": "INTEGER"},
    "dense_topk_filtered": {"rank": "INTEGER"},
    "dense_topk_mixed": {"rank": "INTEGER"},
    "hybrid_fusion": {"fused_rank": "INTEGER", "vector_rank": "INTEGER", "bm25_rank": "INTEGER"},
    "rerank_composite": {
        "final_rank": "INTEGER", "hierarchy_boost": "DOUBLE", "intent_boost": "DOUBLE", "facet_boost": "DOUBLE",
        "context_boost": "DOUBLE", "contradiction_penalty": "DOUBLE"},
    "evidence_citation": {"page": "INTEGER", "cited_page": "INTEGER"},
}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _CASTS.get(name, {}).items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if casts else sql


def all_queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: _typed(name, sql.strip()) for m in _MODULES for name, sql in m.ORACLE.items()}
