"""Schemas of the persistent tables and of nested values in flight."""

from __future__ import annotations

#: Table name to DDL, as ``spark.read.schema`` takes it.
TABLES: dict[str, str] = {
    "documents": "id long, tenant_id long, title string, source_uri string, file_sha256 string, file_size long, report_date date, year int, "
    "parse_status string, current_version_id long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "doc_versions": "id long, tenant_id long, document_id long, version_no int, content_sha256 string, parser_version string, created_at timestamp_ntz",
    "chunks": "id long, tenant_id long, document_id long, version_id long, chunk_no int, content string, content_sha256 string, page_start int, page_end int, "
    "is_table boolean, table_id long, is_deleted boolean, created_at timestamp_ntz",
    "tables": "id long, tenant_id long, document_id long, version_id long, table_sha256 string, page_no int, "
    "table_data struct<header:array<string>,data:array<array<string>>,row_count:int,col_count:int>, markdown string",
    "embeddings": "id long, tenant_id long, chunk_id long, content_sha256 string, embed_model string, vector array<float>, dim int, is_active boolean",
    "index_builds": "id long, tenant_id long, index_type string, params map<string,string>, doc_count long, chunk_count long, status string, started_at timestamp_ntz, finished_at timestamp_ntz",
    "qa_requests": "id long, tenant_id long, user_id long, session_id string, query string, query_hash string, rewritten_queries array<string>, answer string, "
    "confidence double, is_refused boolean, latency_ms long, cost_usd decimal(10,6), created_at timestamp_ntz",
    "qa_citations": "request_id long, chunk_id long, rank_no int, quote string, score double",
    "model_events": "id long, request_id long, model_name string, event_type string, http_status int, error_msg string, latency_ms long, created_at timestamp_ntz",
}

TABLE_DATA = "struct<header:array<string>,data:array<array<string>>,row_count:int,col_count:int>"
