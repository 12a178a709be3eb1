"""Source files and their symbols: Python by its syntax tree, the other languages by a scanner that knows comments and strings."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Languages by file ending.
LANGUAGES = {
    ".java": "java", ".py": "python", ".scala": "scala", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".go": "go", ".rs": "rust", ".bzl": "starlark", ".bazel": "starlark",
}
# Directories that are never indexed, wherever they stand in a path.
SKIPPED = (
    "node_modules",
    ".git",
    "__pycache__",
    ".venv",
    "venv",
    "env",
    ".tox",
    ".pytest_cache",
    "dist",
    "build",
    ".eggs",
    "site-packages",
    ".mypy_cache",
    ".ruff_cache",
    "target",
    "bazel-bin",
    "bazel-out",
    "bazel-testlogs",
    ".idea",
    ".vscode",
)


def language_of(path: Column) -> Column:
    """The language of a path by its ending, ignoring case; null for others."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def indexable(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Files of a known language none of whose directories is skipped."""
    return files.where(language_of(F.col(path)).isNotNull() & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED))))


# What opens a symbol, by language: (type, pattern whose first group is the name).
_NAME = r"([^\W\d]\w*)"
_OPENERS = {
    "java": [("class", rf"\bclass\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("method", rf"(?:^|[;{{}}\s])(?:[\w<>\[\],.?@]+\s+)+{_NAME}\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:throws\s+[\w,.\s]+)?\{{"), ("constructor", rf"(?:^|[;{{}}])\s*(?:(?:public|private|protected)\s+){_NAME}\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w,.\s]+)?\{{")],
    "scala": [("class", rf"\bclass\s+{_NAME}"), ("trait", rf"\btrait\s+{_NAME}"), ("object", rf"\bobject\s+{_NAME}"), ("function", rf"\bdef\s+{_NAME}")],
    "typescript": [("class", rf"\bclass\s+{_NAME}"), ("function", rf"\bfunction\s*\*?\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}")],
    "javascript": [("class", rf"\bclass\s+{_NAME}"), ("function", rf"\bfunction\s*\*?\s+{_NAME}")],
    "go": [("method", rf"\bfunc\s+\([^)]*\)\s*{_NAME}"), ("function", rf"\bfunc\s+{_NAME}"), ("type", rf"\btype\s+{_NAME}")],
    "rust": [("function", rf"\bfn\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("trait", rf"\btrait\s+{_NAME}")],
    "starlark": [("function", rf"(?m)^[ \t]*def\s+{_NAME}")],
}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`[^`]*`", re.S)
_HASH_NOISE = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", re.S)


def _blank(text: str, noise: re.Pattern) -> str:
    """The text with comments and strings blanked out, line ends kept, so that positions stay."""
    return noise.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _symbol(code: str, lines: list[str], name: str, kind: str, first: int, last: int, language: str) -> dict:
    text = "\n".join(lines[first - 1 : last])
    signature = lines[first - 1].strip()
    if language == "java":
        signature = text.split("{", 1)[0].strip()
    return {"name": name, "type": kind, "start_line": first, "end_line": last, "signature": signature, "code": text}


def _python(code: str, lines: list[str]) -> list[dict]:
    out = []

    def walk(node, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.append(_symbol(code, lines, child.name, "class", child.lineno, child.end_lineno, "python"))
                walk(child, True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if in_class and not child.decorator_list else "function"
                out.append(_symbol(code, lines, child.name, kind, child.lineno, child.end_lineno, "python"))
                walk(child, False)
            else:
                walk(child, False)

    walk(ast.parse(code), False)
    return out


def _indented(code: str, lines: list[str], language: str) -> list[dict]:
    out = []
    for m in re.finditer(rf"(?m)^([ \t]*)(class|def)\s+{_NAME}", _blank(code, _HASH_NOISE)):
        first = code.count("\n", 0, m.start()) + 1
        depth, last = len(m.group(1)), first
        for n in range(first, len(lines)):
            if lines[n].strip():
                if len(lines[n]) - len(lines[n].lstrip()) <= depth and not lines[n].lstrip().startswith((")", "]", "}")):
                    break
                last = n + 1
        kind = "class" if m.group(2) == "class" else "method" if depth and language == "python" else "function"
        out.append(_symbol(code, lines, m.group(3), kind, first, last, language))
    return out


def _braced(code: str, lines: list[str], language: str) -> list[dict]:
    clean, found = _blank(code, _NOISE), {}
    keywords = {"if", "for", "while", "switch", "catch", "return", "new", "else", "synchronized", "try"}
    for kind, pattern in _OPENERS[language]:
        for m in re.finditer(pattern, clean):
            at, name = m.start(1), m.group(1)
            if name in keywords or at in found or re.search(r"\b(?:return|new|else|throw)\s", m.group()[: at - m.start()]):
                continue
            if kind == "method" and language == "java" and not re.search(r"[\w>\]]\s+$", re.sub(r"\b(?:public|private|protected|static|final|abstract|synchronized|native|default)\b", "", clean[m.start() : at]).rstrip() + " "):
                kind_ = "constructor"
            else:
                kind_ = kind
            head = m.start() + len(m.group()) - len(m.group().lstrip(" \t\r\n;{}"))
            open_, stop = clean.find("{", at), clean.find(";", at)
            if language in ("scala",):
                line_end = clean.find("\n", at)
                if open_ < 0 or line_end >= 0 and open_ > line_end:
                    open_ = -1
            if language == "go" and kind == "type":
                line_end = clean.find("\n", at)
                open_ = open_ if 0 <= open_ < (line_end if line_end >= 0 else len(clean)) else -1
            if open_ < 0 or 0 <= stop < open_:
                line_end = clean.find("\n", at)
                end = stop if 0 <= stop and language != "scala" else (line_end if line_end >= 0 else len(clean))
            else:
                depth, end = 0, len(clean) - 1
                for b in re.compile(r"[{}]").finditer(clean, open_):
                    depth += 1 if b.group() == "{" else -1
                    if depth == 0:
                        end = b.start()
                        break
            found[at] = (head, end, name, kind_)
    out = []
    for _, (head, end, name, kind) in sorted(found.items()):
        out.append(_symbol(code, lines, name, kind, clean.count("\n", 0, head) + 1, clean.count("\n", 0, end) + 1, language))
    return out


def extract(code: str, language: str) -> list[dict]:
    """Symbols of a file in the order they begin, nested ones after what holds them."""
    lines = code.split("\n")
    if language == "python":
        try:
            return _python(code, lines)
        except (SyntaxError, ValueError, RecursionError):
            return _indented(code, lines, language)
    if language == "starlark":
        return [s for s in _indented(code, lines, language) if s["type"] == "function"]
    return _braced(code, lines, language)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of (file_path, content): file_path, ord and what ``extract`` gives, with the language; null content has none."""
    ship(files.sparkSession)
    source = indexable(files).select("file_path", language_of(F.col("file_path")).alias("language"), "content").where("content is not null")
    names = ["file_path", "ord", "name", "type", "start_line", "end_line", "signature", "code", "language"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [{"file_path": path, "ord": n, "language": language, **s} for n, s in enumerate(extract(content, language))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return source.mapInArrow(run, "file_path string, ord int, name string, type string, start_line int, end_line int, signature string, code string, language string")
