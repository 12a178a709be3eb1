"""Glob patterns of owner files and exclude lists as regular expressions, made once on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths


def owner_regex(pattern: str) -> str:
    """``**/`` any directories, ``**`` anything, ``*`` and ``?`` within a segment, all else literal; anchored."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i]))
            i += 1
    return f"^{''.join(out)}$"


def rule_regexes(pattern: str) -> tuple[str, str | None]:
    """The regexes of an owner rule: of the path itself, and of what lies under it (None if it ends with ``*``)."""
    p = pattern.removeprefix("!")
    p = p.removeprefix("/") if p.startswith("/") else p if "/" in p else f"**/{p}"
    p = p.rstrip("/")
    return owner_regex(p), None if p.endswith("*") else owner_regex(f"{p}/**")


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path is excluded: a pattern matches it or its name (``*`` crosses ``/``), or with ``**`` its rest is in the path."""
    hit = F.lit(False)
    for p in patterns:
        rx = translate(p).replace("(?s:", "(?s)(?:").replace(r"\Z", r"\z")
        hit = hit | path.rlike(f"^{rx}") | paths.name(path).rlike(f"^{rx}")
        if "**" in p:
            hit = hit | path.contains(p.replace("**/", "").replace("/**", ""))
    return hit
