"""The application's tables. New columns are added at the end and are nullable, so old files stay readable."""

from __future__ import annotations

PAGES = "array<struct<page: int, text: string, method: string, ocr_confidence: double, flagged: boolean>>"

TABLES = {
    "documents": (
        "id bigint, filename string, title string, saved_path string, file_type string, original_path string, memo string, category string, status string, "
        "error string, page_count bigint, has_flagged boolean, sha256 string, view_count bigint, download_count bigint, uploaded_by string, department string, "
        "uploaded_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "chunks": "id bigint, doc_id bigint, text string, page_num int, chunk_idx int, embedding array<float>",
    "users": "email string, name string, picture string, department string, updated_at timestamp_ntz",
    "admin_emails": "email string, added_by string, created_at timestamp_ntz",
    "revoked_sessions": "session_id string, revoked_at timestamp_ntz",
    "search_logs": "id bigint, query string, alpha double, result_count bigint, user_email string, searched_at timestamp_ntz",
    "bookmarks": "id bigint, doc_id bigint, user_email string, created_at timestamp_ntz",
    "comments": "id bigint, doc_id bigint, user_email string, content string, created_at timestamp_ntz",
    "notifications": "id bigint, recipient string, doc_id bigint, comment_id bigint, message string, is_read boolean, created_at timestamp_ntz",
    "document_permissions": "id bigint, doc_id bigint, user_email string, created_at timestamp_ntz",
    "deletion_logs": (
        "id bigint, doc_id bigint, filename string, category string, deleted_by string, reason string, deleted_at timestamp_ntz, status string, trash_dir string, "
        "snapshot string, restored_at timestamp_ntz, restored_by string, restored_doc_id bigint"
    ),
    "chunk_index": "chunk_id bigint, doc_id bigint, filename string, title string, memo string, text string, page_num int, chunk_idx int, embedding array<float>",
    "postings": "chunk_id bigint, doc_id bigint, field string, dl bigint, term string, tf bigint",
    "parse_results": f"source_file string, status string, error string, pages {PAGES}",
}
