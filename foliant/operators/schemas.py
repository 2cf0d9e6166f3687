"""Schemas of the tables that operators take and return."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGE = "doc_id string, page_no int, width double, height double, text string, link_count int, image_count int, warnings array<string>, text_char_count int, text_area_ratio double, image_area_ratio double"
TABLE = "struct<rows:array<array<string>>,row_count:int,column_count:int,header:array<string>,numeric_tokens:array<string>,warnings:array<string>,confidence:string>"
ENTITY = "struct<type:string,text:string,source:string,confidence:string>"
BLOCK = f"doc_id string, block_id string, page_no int, type string, text string, bbox {BOX}, ord int, parent_id string, relation string"
RAW_BLOCK = f"doc_id string, page_no int, page_height double, ord int, bbox {BOX}, lines array<struct<text:string,spans:array<struct<text:string,x:double,size:double>>>>"
EDGE = "doc_id string, child_id string, parent_id string, relation string, page_gap int, cross_page boolean, warning string"
CHUNK = "doc_id string, chunk_id string, ord int, pages array<int>, text string, block_ids array<string>, block_types map<string,int>, link_count int, image_count int, warnings array<string>, boundary_ids array<string>, relation_ids array<string>, approx_chars int, split_reason string, budget_overflow_chars int, budget_pressure string"
CELL = "doc_id string, table_id string, row_index int, column_index int, text string"
GLOSSARY = "ordinal long, en string, zh string, first_page int, source string, status string, confidence double, section_scope string"
RUN_EVENT = "run_id string, event_type string, phase string, chunk_id string, translator string, elapsed_ms long, source_char_count long, context_char_count long, request_char_count long, translated_char_count long, estimated_request_token_count long, estimated_translated_token_count long, reason string, error_code string, error_category string, http_retry_events array<struct<status:string,will_retry:boolean,error_code:string,error_category:string>>"
PRICE = "key string, currency string, input_per_1m_tokens double, output_per_1m_tokens double, input_per_1m_chars double, output_per_1m_chars double, per_request double"
JOB = "job_id string, user_id long, username string, original_filename string, created_at timestamp"
FAVORITE = "user_id long, job_id string, favorited_at timestamp"
AUDIT = "id long, created_at timestamp, user_id long, username string, ip string, action string, detail_json string, job_id string"
KEY_VALUE = "key string, value string"
