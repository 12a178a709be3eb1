"""Pieces of SQL that several queries share."""

from __future__ import annotations


def slug_sql(x: str) -> str:
    """SQL of a heading's slug."""
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g'), '-')"


def path_sql(directory: str, file: str) -> str:
    """SQL of a relative path joined to a directory, for files whose dots stand in front."""
    up = f"(length(regexp_extract({file}, '^(\\./)*((\\.\\./)*)', 2)) // 3)"
    parts = f"string_split({directory}, '/')"
    rest = f"regexp_replace(regexp_replace({file}, '^(\\./)+', ''), '^(\\.\\./)+', '')"
    return f"array_to_string(list_concat({parts}[1:len({parts}) - {up}], case when {rest} = '' then [] else [{rest}] end), '/')"
