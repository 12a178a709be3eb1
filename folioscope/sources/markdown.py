"""Markdown pages: listing, reading and scanning into links, headings, references and code blocks.

The scanner follows CommonMark's blocks (ATX and setext headings, fences of backticks and tildes in lists and quotes,
indented code, HTML comments) and inlines (code spans, escapes, links and images, inline or by reference, autolinks).
Native expressions are given for what needs no scanner: file hints and symbol names of snippets.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HEADINGS, LINKS
from ..session import ship


def list_files(root: str, endings: tuple[str, ...] = (".md", ".mdx")) -> list[str]:
    """All files under ``root`` with one of the endings, in order of their path's components; hidden ones as well.

    A ``root`` that is a file stands for itself alone, whatever its ending.
    """
    if os.path.isfile(root):
        return [root]
    found = [os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(endings)]
    return sorted(found, key=lambda p: p.split(os.sep))


def read_files(spark: SparkSession, paths: list[str], base: str) -> DataFrame:
    """(doc_path, base_path, content) of files, read by the executors; files that aren't UTF-8 are left out."""
    frame = spark.createDataFrame([(p, base) for p in paths], "doc_path string, base_path string")

    def run(batches):
        for batch in batches:
            rows = []
            for path, base_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(path, encoding="utf-8") as f:
                        rows.append((path, base_path, f.read()))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["doc_path", "base_path", "content"])

    parts = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    return frame.repartition(parts).mapInArrow(run, "doc_path string, base_path string, content string")


def write_files(pages: DataFrame, content: str = "content") -> DataFrame:
    """Write (doc_path, ``content``) back to files, by the executors: (doc_path, written).

    A file is written beside itself and moved into place, so a task that runs again leaves the same. Null contents and
    files that can't be written count as not written.
    """

    def run(batches):
        for batch in batches:
            done = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if text is None:
                        raise OSError
                    with open(f"{path}.{os.getpid()}.part", "w", encoding="utf-8", newline="") as f:
                        f.write(text)
                    os.replace(f"{path}.{os.getpid()}.part", path)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], ["doc_path", "written"])

    return pages.select("doc_path", content).mapInArrow(run, "doc_path string, written boolean")


_FENCE = re.compile(r"^([ ]{0,3})(`{3,}|~{3,})[ \t]*([^\n]*)$")
_ATX = re.compile(r"^[ ]{0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_CONTAINER = re.compile(r"^[ ]{0,3}(?:>[ ]?|[-+*](?:[ \t]+|$)|\d{1,9}[.)](?:[ \t]+|$))")
_DEFINITION = re.compile(r"(?m)^\[([^\]]+)\]:\s*(\S+)")
_INLINE = re.compile(r"(?P<escape>\\.)|(?P<ticks>`+)|(?P<auto><([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*)>)|(?P<open>!?\[)", re.S)
_DESTINATION = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")


def label(text: str) -> str:
    """A reference label as it is compared: lower case, white space collapsed."""
    return " ".join(text.lower().split())


def inline_links(text: str, references: dict[str, str], line: int) -> list[dict]:
    """Links and images of a block's text, in order; a link's text is the first piece of plain text in it."""
    out, i = [], 0
    while m := _INLINE.search(text, i):
        i = m.end()
        if m.group("escape"):
            continue
        if m.group("ticks"):
            close = re.compile(rf"(?<!`){re.escape(m.group('ticks'))}(?!`)").search(text, i)
            i = close.end() if close else i
            continue
        if m.group("auto"):
            out.append({"text": m.group(4), "url": m.group(4), "line": line, "is_image": False, "is_reference": False, "reference_label": None})
            continue
        image, depth, j = m.group("open")[0] == "!", 1, i
        while j < len(text) and depth:
            c = text[j]
            if c == "\\":
                j += 1
            elif c == "`":
                run = re.compile(r"`+").match(text, j).group()
                close = re.compile(rf"(?<!`){run}(?!`)").search(text, j + len(run))
                j = close.end() - 1 if close else j + len(run) - 1
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            j += 1
        if depth:
            continue
        inside, url, by = text[i : j - 1], None, None
        if d := _DESTINATION.match(text, j):
            url, end = d.group(1) if d.group(1) is not None else d.group(2), d.end()
            url = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", url)
        else:
            r = re.compile(r"\[([^\]]*)\]").match(text, j)
            name = label(r.group(1) if r and r.group(1) else inside)
            url, by, end = references.get(name), name, r.end() if r else j
        if url is None:
            continue
        plain = re.split(r"[`*_\[!]", re.sub(r"^[*_]+", "", inside))[0] if not image else inside
        nested = [] if image else [x for x in inline_links(inside, references, line) if x["is_image"]]
        out.append({"text": plain, "url": url, "line": line, "is_image": image, "is_reference": by is not None, "reference_label": by})
        out.extend(nested)
        i = end
    return out


def parse(content: str) -> dict[str, list[dict]]:
    """Links, headings, references and code blocks of a page; lines count from 1, those of links are their block's first."""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    references: dict[str, str] = {}
    for m in _DEFINITION.finditer(content):
        references[label(m.group(1))] = m.group(2)
    links, headings, blocks = [], [], []
    paragraph: list[tuple[int, str]] = []

    def flush() -> None:
        if paragraph:
            text = "\n".join(t for _, t in paragraph)
            links.extend(inline_links(text, references, paragraph[0][0]))
            paragraph.clear()

    rows, i = content.split("\n"), 0
    while i < len(rows):
        prefix, body = "", rows[i]
        while c := _CONTAINER.match(body):
            if re.fullmatch(r"[ ]{0,3}([-*_][ \t]*){3,}", body):
                break
            prefix, body = prefix + body[: c.end()], body[c.end() :]
            if prefix.strip()[-1:] != ">":
                flush()
        fence = _FENCE.match(body.strip(" ") if prefix or not body.startswith("    ") else body)
        if fence and not (fence.group(2)[0] == "`" and "`" in fence.group(3)):
            flush()
            mark, info, start, code = fence.group(2), fence.group(3).strip(), i + 1, []
            indent = len(prefix) + len(fence.group(1)) if prefix else len(body) - len(body.lstrip(" "))
            quoted = prefix.count(">")
            i += 1
            while i < len(rows):
                row = rows[i]
                for _ in range(quoted):
                    row = re.sub(r"^[ ]{0,3}>[ ]?", "", row, count=1)
                if re.match(rf"^\s*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", row):
                    break
                cut = 0
                while cut < (indent if not quoted else 0) and row[cut : cut + 1] == " ":
                    cut += 1
                code.append(row[cut:])
                i += 1
            words = info.split()
            blocks.append({"language": words[0] if words else "", "code": "".join(x + "\n" for x in code), "line": start})
            i += 1
            continue
        if not body.strip():
            flush()
        elif a := _ATX.match(body):
            flush()
            headings.append({"level": len(a.group(1)), "text": (a.group(2) or "").strip(), "line": i + 1})
            links.extend(inline_links(a.group(2) or "", references, i + 1))
        elif paragraph and (s := re.fullmatch(r"[ ]{0,3}(=+|-+)[ \t]*", body)) and not prefix:
            text = "\n".join(t.strip() for _, t in paragraph)
            headings.append({"level": 1 if s.group(1)[0] == "=" else 2, "text": text, "line": paragraph[0][0]})
            flush()
        elif not paragraph and body.startswith("    ") and not prefix:
            pass  # indented code
        elif _DEFINITION.match(body):
            flush()
        else:
            paragraph.append((i + 1, body.strip()))
        i += 1
    flush()
    for name, rows_ in (("links", links), ("headings", headings), ("blocks", blocks)):
        for n, r in enumerate(rows_):
            r["ord"] = n
    return {"links": links, "headings": headings, "blocks": blocks, "references": [{"label": k, "url": v} for k, v in references.items()]}


def scan(documents: DataFrame) -> DataFrame:
    """doc_path, base_path and the arrays links, headings, references and blocks of each page, parsed once; null content has none.

    Blocks come with file_hint and symbols. Repeated rows stay.
    """
    ship(documents.sparkSession)
    kind = (
        "doc_path string, base_path string, "
        f"links array<struct<{LINKS.replace(' ', ':').replace(',:', ',')}>>, headings array<struct<ord:int,{HEADINGS.replace(' ', ':').replace(',:', ',')}>>, "
        "blocks array<struct<ord:int,language:string,code:string,line:int>>, references array<struct<label:string,url:string>>"
    )
    link = pa.struct([("ord", pa.int32()), ("text", pa.string()), ("url", pa.string()), ("line", pa.int32()), ("is_image", pa.bool_()), ("is_reference", pa.bool_()), ("reference_label", pa.string())])
    heading = pa.struct([("ord", pa.int32()), ("level", pa.int32()), ("text", pa.string()), ("line", pa.int32())])
    block = pa.struct([("ord", pa.int32()), ("language", pa.string()), ("code", pa.string()), ("line", pa.int32())])
    reference = pa.struct([("label", pa.string()), ("url", pa.string())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [parse(x or "") for x in part.column(2).to_pylist()]
                arrays = [pa.array([g[name] for g in got], pa.list_(t)) for name, t in (("links", link), ("headings", heading), ("blocks", block), ("references", reference))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["doc_path", "base_path", "links", "headings", "blocks", "references"])

    return documents.select("doc_path", "base_path", "content").mapInArrow(run, kind)


def links(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_path", "base_path", F.inline("links"))


def headings(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_path", F.inline("headings"))


def references(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_path", F.inline("references"))


def code_blocks(scanned: DataFrame) -> DataFrame:
    """Code blocks with file_hint and symbols."""
    rows = scanned.select("doc_path", F.inline("blocks"))
    return rows.select("*", file_hint(F.col("code")).alias("file_hint"), snippet_symbols(F.col("code"), F.col("language")).alias("symbols"))


# Comments that name a file, tried in this order.
HINT_PATTERNS = [
    r"(?://|#)\s*(?:File:\s*)?([^\s]+\.[a-zA-Z]+)",
    r"/\*\s*(?:File:\s*)?([^\s]+\.[a-zA-Z]+)\s*\*/",
    r"^(?://|#)\s*([\w/.-]+\.[a-zA-Z]+)",
]


def file_hint(code: Column) -> Column:
    """The first path with an ending in a ``//``, ``#`` or ``/* */`` comment of a snippet; null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(code, f"(?m){p}", 1), F.lit("")) for p in HINT_PATTERNS])


# What names a symbol in a snippet, by the languages that share it, in order.
SYMBOL_PATTERNS = [
    (("java", "scala", "kotlin"), [r"\b(?:class|interface|trait|object|enum)\s+(\w+)", r"\b(?:public|private|protected|def|fun)\s+\w*\s*(\w+)\s*\("]),
    (("python", "py"), [r"\bclass\s+(\w+)", r"\bdef\s+(\w+)"]),
    (("javascript", "typescript", "js", "ts", "jsx", "tsx"), [r"\bclass\s+(\w+)", r"\b(?:async\s+)?function\s+(\w+)", r"\bconst\s+(\w+)\s*=\s*(?:async\s*)?\("]),
    (("go",), [r"\bfunc\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)", r"\btype\s+(\w+)\s+(?:struct|interface)"]),
    (("rust", "rs"), [r"\bfn\s+(\w+)", r"\b(?:struct|enum|trait|impl)\s+(\w+)"]),
    (("bazel", "starlark", "bzl"), [r"\bdef\s+(\w+)", r"name\s*=\s*[\"']([^\"']+)[\"']"]),
]


def snippet_symbols(code: Column, language: Column, strict: bool = True) -> Column:
    """Names a snippet defines, by its language, in order of pattern and place, each once; empty for other languages.

    ``strict`` keeps the known weakness that a method without a return type is named by its last character.
    """
    case = None
    for names, patterns in SYMBOL_PATTERNS:
        if not strict:
            patterns = [p.replace(r"\s+\w*\s*(\w+)\s*\(", r"\s+(?:[\w<>\[\]]+\s+)*(\w+)\s*\(") for p in patterns]
        found = F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in patterns]))
        case = (F.when if case is None else case.when)(language.isin(*names), found)
    return case.otherwise(F.array().cast("array<string>"))


