"""Schemas of the index tables and of findings."""

from __future__ import annotations

FILES = "file_path string, description string, language string, scanned_at timestamp, sha256 string, line_count int"
SYMBOLS = "symbol_id string, name string, kind string, file_path string, start_line int, end_line int, complexity int, param_count int, is_exported boolean, parse_seq int"
IMPORTS = "file_path string, specifier string, target string, resolved boolean, imported_names array<string>, parse_seq int"
CALLS = "file_path string, callee string, line int, parse_seq int"
CHUNKS = "chunk_id string, file_path string, chunk_seq int, start_line int, end_line int, content string, summary string, intent_tags array<string>, struct_hash string"
EDGES = "src string, dst string, edge_type string, line int"
TERMS = "term string, chunk_id string, file_path string, tf long"
COMMITS = "commit_id string, file_path string"
FINDINGS = "id string, rule string, category string, severity string, file string, line int, snippet string, message string, remediation string, cve_id string, cwe_id string, epss_score double, source string"
SCOPE_RULES = "from_part string, to_part string, severity string, message string"

#: Severities from the lowest to the highest.
SEVERITIES = ("low", "medium", "high", "critical")
