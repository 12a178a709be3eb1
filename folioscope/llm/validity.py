"""Source files that do not parse: every block is parsed by a recursive-descent parser of its language.

Expressions are parsed by precedence climbing; after an error the parser panics to the next statement and goes on, so
that all errors of a block are stored, its first one as the cause. The parsers are in ``syntax``, one module a language.
A task parses equal codes of equal language once, as long as it remembers them.
"""

from __future__ import annotations

import sys
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once, ship
from .syntax.ecma import JavaScript, TypeScript
from .syntax.golang import Go
from .syntax.java import Java
from .syntax.jsonlang import Json
from .syntax.pythonic import Python, Starlark
from .syntax.rust import Rust
from .syntax.scala import Scala

# The spellings of the languages that have a grammar.
SPELLINGS = {
    "python": ["python", "py", "python3"],
    "starlark": ["starlark", "bzl"],
    "java": ["java"],
    "typescript": ["typescript", "ts"],
    "javascript": ["javascript", "js"],
    "go": ["go", "golang"],
    "rust": ["rust", "rs"],
    "scala": ["scala"],
    "json": ["json"],
}
GRAMMARS = {
    "python": Python, "starlark": Starlark, "java": Java, "typescript": TypeScript, "javascript": JavaScript, "go": Go, "rust": Rust,
    "scala": Scala, "json": Json,
}
#: Python frames a parser may nest, at most. Code with brackets nested some 50,000 deep needs more, and is left undecided.
NESTING = 1_000_000
#: What ``errors`` reports instead of errors where it can't tell.
UNDECIDED = "nested too deeply to decide"


def language(column: Column) -> Column:
    """The language a spelling means, ignoring case; null if it has no grammar."""
    pairs = [F.lit(x) for name, all_ in SPELLINGS.items() for s in all_ for x in (s, name)]
    return F.try_element_at(F.create_map(*pairs), F.lower(column))


def errors(name: str, code: str) -> list[tuple[int, int, str]]:
    """(line, column, message) of all errors, in order; an empty list means that the code is a complete file."""
    if not code.strip() and name in ("json",):
        return [(1, 1, "no value")]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, min(NESTING, 10_000 + 40 * len(code))))  # frames of Python are no frames of C
    try:
        found = GRAMMARS[name](code).run()
    except RecursionError:
        return [(1, 1, UNDECIDED)]
    finally:
        sys.setrecursionlimit(limit)
    starts = [0] + [i + 1 for i, c in enumerate(code) if c == "\n"]
    places = [(bisect_right(starts, at) or 1, at, what) for at, what in found]
    return [(line, at - starts[line - 1] + 1, what) for line, at, what in places]


def checked(blocks: DataFrame) -> DataFrame:
    """One row per code_id with a language that has a grammar and a non-null code.

    Columns: code_id, repo, lang (canonical), valid, n_errors, first_line, first_error, errors (array of line, column,
    message; all of them, in order). Blank code is a valid empty file, but for JSON and Go. Rows sent twice count once.
    ``valid`` is null for code that is nested too deeply to decide.
    """
    ship(blocks.sparkSession)
    known = blocks.select("code_id", "repo", language(F.col("language")).alias("lang"), "code").where("lang is not null and code is not null and code_id is not null")
    kind = "code_id bigint, repo string, lang string, n_errors int, errors array<struct<line:int,column:int,message:string>>"
    item = pa.list_(pa.struct([("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())]))

    def run(batches):
        seen: dict[tuple[str, str], list] = {}
        for batch in batches:
            rows = []
            for name, code in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                key = (name, code)
                got = seen.get(key)
                if got is None:
                    got = [{"line": a, "column": b, "message": c} for a, b, c in errors(name, code)]
                    if len(seen) > 5000:
                        seen.clear()  # copies that come later are parsed again
                    seen[key] = got
                rows.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in rows], pa.int32()), pa.array(rows, item)], ["code_id", "repo", "lang", "n_errors", "errors"])

    # Texts are parsed where they are read; what is sent twice is made single afterwards, when it is small.
    got = once(known.mapInArrow(run, kind), ["code_id"])
    first = F.try_element_at("errors", F.lit(1))
    return got.select("code_id", "repo", "lang", F.when(first["message"] == UNDECIDED, None).otherwise(F.col("n_errors") == 0).alias("valid"), "n_errors", first["line"].alias("first_line"), first["message"].alias("first_error"), "errors")


def causes(blocks: DataFrame) -> DataFrame:
    """Of each invalid block all its errors, one row each: code_id, lang, error_no (from 1; the first is the cause), line, column, message."""
    bad = checked(blocks).where("not valid")
    return bad.select("code_id", "lang", F.posexplode("errors").alias("n", "e")).select("code_id", "lang", (F.col("n") + 1).alias("error_no"), "e.line", "e.column", "e.message")


def rates(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Per repo and language: blocks, invalid ones, their rate, and how many of these the earlier status had called valid.

    ``results`` (code_id, status) is pre-aggregated per code_id; a missing or null status claims nothing. Blocks without
    a grammar aren't counted; undecided ones count as blocks and not as invalid.
    """
    claims = results.where("code_id is not null").groupBy("code_id").agg(F.bool_or(F.col("status") == "valid").alias("claimed"))
    both = checked(blocks).select("code_id", "repo", "lang", "valid").join(claims, "code_id", "left")
    bad = ~F.col("valid")
    return both.groupBy("repo", "lang").agg(
        F.count("*").alias("n_blocks"), F.count_if(bad).alias("n_invalid"), (F.count_if(bad) / F.count("*")).alias("invalid_rate"),
        F.count_if(bad & F.coalesce("claimed", F.lit(False))).alias("n_claimed_valid"),
    )
