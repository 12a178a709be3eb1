"""Heading anchors: slug, slug variants and numbered repetitions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters as classes that do not depend on a regex engine's flags.
SPACE = "\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
WORD = "\\p{L}\\p{N}_"


def slug(text: Column) -> Column:
    """Anchor of a heading: lower case, only word characters, white space and hyphens kept, white space to one hyphen."""
    kept = F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}-]", "")
    return F.btrim(F.regexp_replace(kept, f"[{SPACE}]+", "-"), F.lit("-"))


def variants(text: Column) -> Column:
    """The set of anchors other generators would give a heading, in order of first appearance, empties removed.

    Besides the plain slug: parentheses read as hyphens (hyphen runs collapsed), and an isolated full stop keeping both
    of its hyphens.
    """
    lowered = F.lower(text)

    def tidy(t: Column, kept: str = "") -> Column:
        return F.regexp_replace(F.regexp_replace(t, f"[^{WORD}{SPACE}{kept}-]", ""), f"[{SPACE}]+", "-")

    hyphened = F.regexp_replace(tidy(F.regexp_replace(lowered, r"\(([^)]+)\)", "-$1-")), "-+", "-")
    dotted = F.replace(tidy(lowered, "."), F.lit("."), F.lit(""))
    forms = [slug(text), F.btrim(hyphened, F.lit("-")), F.btrim(dotted, F.lit("-"))]
    return F.filter(F.array_distinct(F.array(*forms)), lambda v: v != "")


def has_anchor(slugs: Column, anchor: Column) -> Column:
    """Whether ``anchor`` is one of ``slugs`` or ``slug-k`` for the k-th repetition of a slug (k = 1, 2, ...)."""
    numbered = r"(?s)^(.*)-([1-9][0-9]{0,8})$"
    base, k = F.regexp_extract(anchor, numbered, 1), F.regexp_extract(anchor, numbered, 2).try_cast("int")
    repeats = F.size(F.filter(slugs, lambda s: s == base))
    return F.array_contains(slugs, anchor) | F.coalesce(repeats > k, F.lit(False))
