"""Lookups in a table of source symbols, and which files an embedding pass reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Endings of code that is embedded, and directories that are left out.
EMBEDDED = (".py", ".js", ".ts", ".go", ".java", ".rs")
LEFT_OUT = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env", ".tox", ".pytest_cache", "dist", "build", ".eggs", "site-packages",
    ".mypy_cache", ".ruff_cache",
)


def named(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Symbols of exactly this name (and type)."""
    found = symbols.where(F.col("name") == name)
    return found.where(F.col("type") == kind) if kind else found


def prefixed(symbols: DataFrame, prefix: str, kind: str | None = None) -> DataFrame:
    """Symbols whose name begins so (and of this type)."""
    found = symbols.where(F.col("name").startswith(prefix))
    return found.where(F.col("type") == kind) if kind else found


def counts(symbols: DataFrame, by: Sequence[str] = ("language", "type")) -> DataFrame:
    """Symbols and files per language and type."""
    return symbols.groupBy(*by).agg(F.count("*").alias("n_symbols"), F.count_distinct("file_path").alias("n_files"))


def embedded_docs(files: DataFrame, path: str = "path") -> DataFrame:
    """Pages that are embedded: ``.md`` only; a path that contains ``node_modules`` or ``.git`` anywhere is left out."""
    p = F.col(path)
    return files.where(p.endswith(".md") & ~p.contains("node_modules") & ~p.contains(".git"))


def embedded_code(files: DataFrame, path: str = "path") -> DataFrame:
    """Code that is embedded: six endings, fourteen directories left out."""
    ending = F.regexp_extract(paths.name(F.col(path)), r"(\.[^.]+)$", 1)
    return files.where(ending.isin(*EMBEDDED) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, LEFT_OUT))))
