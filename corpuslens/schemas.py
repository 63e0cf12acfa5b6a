"""Declared schemas as DDL text; library code never infers one."""

FILES = "repo STRING, branch STRING, path STRING, name STRING, type STRING, content STRING"
BLOCK_ANALYSIS = {
    "file_name": "STRING",
    "file_path": "STRING",
    "function_name": "STRING",
    "block_type": "STRING",
    "missing_docstring": "BOOLEAN",
    "language": "STRING",
    "line_number": "INT",
}
SUGGESTION = {
    "file_path": "STRING",
    "file_name": "STRING",
    "function_name": "STRING",
    "block_type": "STRING",
    "line_number": "STRING",
    "language": "STRING",
    "generated_docstring": "STRING",
}
SUGGESTION_DOCUMENT = (
    "provider STRING, repo_path STRING, branch STRING, first_position BIGINT, suggestions ARRAY<STRUCT<"
    + ", ".join(f"{name}: {kind}" for name, kind in SUGGESTION.items())
    + ">>"
)
RUNS = {
    "id": "BIGINT",
    "repository_id": "BIGINT",
    "endpoint": "STRING",
    "status": "STRING",
    "progress_percent": "DOUBLE",
    "progress_message": "STRING",
    "created_at": "TIMESTAMP",
    "started_at": "TIMESTAMP",
    "completed_at": "TIMESTAMP",
    "duration_seconds": "DOUBLE",
    "request_payload": "STRING",
    "result_payload": "STRING",
    "error_message": "STRING",
    "artifact_dir": "STRING",
    "metrics_files_analyzed": "INT",
    "metrics_docstrings_generated": "INT",
    "metrics_skipped_files": "INT",
}
EVIDENCE = "repo STRING, category STRING, name STRING, path STRING, attrs MAP<STRING, STRING>"
EXACT_KEY = ["file_path", "function_name", "block_type", "line_number", "language"]
FUZZY_KEY = ["file_path", "function_name", "block_type", "language"]


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())
