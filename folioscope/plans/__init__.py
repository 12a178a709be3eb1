"""Queries over the tables of a data directory, with their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["references", "documents"]


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__name__}.{m}"), name)
    return out


def all_queries() -> dict:
    return _gather("QUERIES")


def all_sql() -> dict:
    return _gather("SQL")
