"""Reports as rows of text: JSON and Markdown of link checks and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    return F.substring(F.to_json(F.array(c)), 2, F.length(F.to_json(F.array(c))) - 2)


def _part(part: str, name: Column, text: Column) -> list[Column]:
    return [F.lit(part).alias("part"), name.alias("name"), text.alias("text")]


def _object(**values: Column) -> Column:
    """A JSON object of numbers and ready JSON texts, in order."""
    items = [F.concat(F.lit(f'"{k}":'), v.cast("string")) for k, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def scan_json(results: DataFrame) -> DataFrame:
    """(part, name, text): the parts of a JSON report of links: one ``summary``, each ``owner``, each ``owner_file`` and each ``file``.

    ``results`` has owner_key. A report of a large corpus is a table of parts, which ``write_report`` puts into files; its
    rows come from all executors. Files without links are left out; an owner's files are rows, since they may be most of all.
    """
    broken = F.col("status") == "broken"
    sums = results.agg(F.count_distinct("doc_path").alias("f"), F.count("*").alias("t"), F.count_if(broken).alias("b"), F.count_if(F.col("status") == "ok").alias("o"))
    summary = sums.select(*_part("summary", F.lit(""), _object(files_checked=F.col("f"), total_links=F.col("t"), broken_links=F.col("b"), ok_links=F.col("o"))))
    by_owner = results.groupBy("owner_key").agg(F.count_if(broken).alias("b"), F.count_distinct("doc_path").alias("n"))
    owners = by_owner.select(*_part("owner", F.col("owner_key"), _object(owner=_quoted(F.col("owner_key")), broken_count=F.col("b"), n_files=F.col("n"))))
    owned = results.select("owner_key", "doc_path").distinct().select(*_part("owner_file", F.col("owner_key"), _quoted(F.col("doc_path"))))
    files = link_json(results).select(*_part("file", F.col("doc_path"), F.col("json")))
    return summary.unionByName(owners).unionByName(owned).unionByName(files)


def scan_markdown(results: DataFrame) -> DataFrame:
    """(part, name, text): the parts of a Markdown report of links: the ``summary`` table and each ``file`` with broken links."""
    broken = F.col("status") == "broken"
    sums = results.agg(F.count_distinct("doc_path").alias("f"), F.count("*").alias("t"), F.count_if(broken).alias("b"), F.count_if(F.col("status") == "ok").alias("o"))
    row = lambda label, c: F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |\n"))
    table = F.concat(F.lit("| Metric | Count |\n|--------|-------|\n"), row("Files checked", "f"), row("Total links", "t"), row("OK", "o"), row("Broken", "b"))
    return sums.select(*_part("summary", F.lit(""), table)).unionByName(link_markdown(results).select(*_part("file", F.col("doc_path"), F.col("markdown"))))


def snippet_json(results: DataFrame) -> DataFrame:
    """(part, name, text): the parts of a JSON report of snippets: the ``summary`` and each ``file`` with its snippets in order.

    ``results``: doc_path, ord, line, status, similarity, source_path. Snippets without a status are left out.
    """
    rows = results.where("status is not null")
    counts = {s: F.count_if(F.col("status") == s) for s in ("valid", "outdated", "not_found", "invalid_syntax")}
    sums = rows.agg(F.count("*").alias("total"), *[c.alias(s) for s, c in counts.items()])
    summary = sums.select(*_part("summary", F.lit(""), _object(total=F.col("total"), **{s: F.col(s) for s in counts})))
    one = _object(
        line=F.coalesce(F.col("line").cast("string"), F.lit("null")), status=_quoted(F.col("status")),
        similarity=F.coalesce(F.format_number("similarity", 4), F.lit("null")), source=F.when(F.col("source_path").isNull(), "null").otherwise(_quoted(F.col("source_path"))),
    )
    lists = rows.withColumn("j", one).groupBy("doc_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "j"))), lambda x: x["j"]), ",").alias("l"))
    files = lists.select(*_part("file", F.col("doc_path"), F.concat(F.lit('{"path":'), _quoted(F.col("doc_path")), F.lit(',"snippets":['), "l", F.lit("]}"))))
    return summary.unionByName(files)


def exit_codes(links: DataFrame, snippets: DataFrame, *issues: DataFrame, fixed: bool = False) -> DataFrame:
    """(command, failed): a link scan fails with a broken link, a snippet run with an outdated one (unless they were ``fixed``),
    a semantic one with any row of ``issues``."""
    some = lambda df, condition, name: df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("failed")).select(F.lit(name).alias("command"), "failed")
    bad = (F.col("status") == "outdated") & F.lit(not fixed)
    any_ = None
    for df in issues:
        one = df.select(F.lit(1).alias("x")).limit(1)
        any_ = one if any_ is None else any_.unionByName(one)
    return (
        some(links, F.col("status") == "broken", "scan").unionByName(some(snippets, bad, "validate-snippets"))
        .unionByName(any_.agg((F.count("*") > 0).alias("failed")).select(F.lit("semantic").alias("command"), "failed"))
    )


def write_report(parts: DataFrame, path: str) -> None:
    """Write the parts of a report as lines of text, one folder for each kind of part; each executor writes its own."""
    parts.select("part", F.col("text").alias("value")).write.partitionBy("part").mode("overwrite").text(path)


def link_json(results: DataFrame) -> DataFrame:
    """(doc_path, json): each document's links in order; ``error`` and ``suggestion`` only where there is one, ``status_code`` always."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, F.length(F.to_json(F.array(c))) - 2)
    number = F.coalesce(F.col("status_code").cast("string"), F.lit("null"))
    optional = lambda key, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f',"{key}":'), quoted(c))).otherwise("")
    one = F.concat(
        F.lit('{"url":'), quoted(F.col("url")), F.lit(',"line":'), F.col("line").cast("string"), F.lit(',"status":'), quoted(F.col("status")),
        F.lit(',"status_code":'), number, optional("error", F.col("error_message")), optional("suggestion", F.col("suggestion")), F.lit("}"),
    )
    lists = results.where("url is not null and status is not null").withColumn("j", one).groupBy("doc_path").agg(F.array_sort(F.collect_list(F.struct("ord", "j"))).alias("l"), F.count_if(F.col("status") == "broken").alias("b"))
    links = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]"))
    return lists.select("doc_path", F.concat(F.lit('{"path":'), quoted(F.col("doc_path")), F.lit(',"broken":'), F.col("b").cast("string"), F.lit(',"links":'), links, F.lit("}")).alias("json"))


def link_markdown(results: DataFrame) -> DataFrame:
    """(doc_path, markdown): a table of each document's broken links, in order."""
    row = F.concat(F.lit("| "), F.col("line").cast("string"), F.lit(" | `"), _cell(F.col("url")), F.lit("` | "), _cell(F.coalesce("error_message", F.lit(""))), F.lit(" |"))
    broken = results.where((F.col("status") == "broken") & F.col("url").isNotNull()).withColumn("row", row)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "row"))), lambda x: x["row"]), "\n")
    return broken.groupBy("doc_path").agg(rows.alias("rows")).select("doc_path", F.concat(F.lit("### "), "doc_path", F.lit("\n\n| Line | URL | Error |\n|------|-----|-------|\n"), "rows").alias("markdown"))


def owner_summary(results: DataFrame) -> DataFrame:
    """(owner_key, broken, files_affected) of owners with broken links."""
    broken = results.where(F.col("status") == "broken")
    return broken.groupBy("owner_key").agg(F.count("*").alias("broken"), F.count_distinct("doc_path").alias("files_affected"))


def snippet_markdown(results: DataFrame) -> DataFrame:
    """(doc_path, markdown): a line for each snippet that isn't valid, with its similarity in percent."""
    line = F.concat(F.lit("- line "), F.col("line").cast("string"), F.lit(": "), "status", F.lit(" ("), F.format_number(F.col("similarity") * 100, 1), F.lit("%)"))
    rows = results.where("status is not null and status <> 'valid' and similarity is not null and line is not null").withColumn("row", line)
    return rows.groupBy("doc_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n").alias("markdown"))
