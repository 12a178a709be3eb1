"""Schemas of the engine's tables; nothing is ever inferred."""

from __future__ import annotations

DOCUMENTS = "doc_path string, base_path string, content string"
LINKS = "ord int, text string, url string, line int, is_image boolean, is_reference boolean, reference_label string"
HEADINGS = "level int, text string, line int"
CODE_BLOCKS = "ord int, language string, code string, line int, file_hint string, symbols array<string>"
SYMBOLS = "file_path string, ord int, name string, type string, start_line int, end_line int, signature string, code string, language string"
PROBE_RESULTS = "url string, attempt int, status_code int, error string, elapsed double"
OWNER_RULES = "line_number int, pattern string, owners array<string>, is_negation boolean, regex string, dir_regex string"

# The statuses of links and of snippets.
LINK_STATUSES = ("ok", "broken", "timeout", "error", "skipped", "cached")
SNIPPET_STATUSES = ("valid", "outdated", "not_found", "invalid_syntax")
