"""Canonical schemas, as DDL."""

RECORD = """record_id STRING, document_id STRING, title STRING, content STRING, chunk_id STRING, hierarchy_level INT,
categories ARRAY<STRING>, relationships ARRAY<STRING>, published_date STRING, source STRING, processing_timestamp STRING,
validation_status BOOLEAN, language STRING, summary STRING"""
SECTION = """doc_id STRING, doc_number INT, section_id STRING, parent_id STRING, parent_ord INT, marker STRING, marker_value STRING,
level INT, ord INT, header STRING, title STRING, content STRING"""
HIT = """query_id STRING, collection STRING, rank INT, record_id STRING, document_id STRING, title STRING, content STRING,
chunk_id STRING, source STRING, model_info STRING, similarity_score DOUBLE"""
QUERY = """query_id STRING, cache_key STRING, create_time BIGINT, query_text STRING, response_text STRING,
sources ARRAY<STRING>, is_complete BOOLEAN, timestamp BIGINT, conversation_history ARRAY<MAP<STRING,STRING>>"""
MENTION = """mention STRING, document_type STRING, document_number STRING, issue_year STRING, issuer_body STRING,
extra_info STRING"""
CATALOG = """document_id STRING, full_name STRING, document_type STRING, document_number STRING, issue_year STRING,
issuer_body STRING, filename STRING"""
