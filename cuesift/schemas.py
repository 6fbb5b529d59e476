"""Explicit schemas of the catalogue tables."""

from __future__ import annotations

DIRECTORIES = (
    "directory_id long, path string, path_key string, label string, enabled boolean, "
    "created_at long, last_scanned_at long"
)
ASSETS = (
    "asset_id long, directory_id long, path string, path_key string, file_name string, ext string, "
    "kind string, size_bytes long, mtime_ms long, fingerprint string, extract_status string, "
    "extract_error string, extracted_at long, duration_ms long, created_at long, updated_at long"
)
TAGS = "tag_id long, name string, name_key string, color string, created_at long"
ASSET_TAGS = "asset_id long, tag_id long, source string, created_at long"
SEGMENTS = (
    "segment_id long, asset_id long, source string, ordinal int, text string, "
    "start_ms long, end_ms long"
)
RUNS = (
    "run_id long, asset_id long, fingerprint string, status string, engine_label string, "
    "error_code string, error_message string, started_at long"
)
RUN_SOURCES = (
    "run_id long, source string, status string, segment_count long, "
    "error_code string, error_message string"
)
JOBS = "job_id long, type string, status string, target_id long, created_at long"
RESULTS = (
    "result_id long, asset_id long, body string, model string, prompt_version string, "
    "status string, error_code string, error_message string, input_chars long, "
    "input_tokens long, output_tokens long, created_at long"
)

# One segment as the parsers return it, before it is numbered.
PARSED = "array<struct<text:string,start_ms:bigint,end_ms:bigint>>"
