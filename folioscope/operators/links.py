"""Link checking as joins: dispatch, ignore patterns, path and anchor existence, external status rules, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import anchors, paths, similarity
from ..session import spread_join, stored

# Status codes that are worth another attempt.
RETRYABLE = (429, 502, 503, 504)


def kind(url: Column) -> Column:
    """What a url is by its prefix: external, mailto, anchor, absolute or relative; null for null."""
    return (
        F.when(url.startswith("http://") | url.startswith("https://"), "external")
        .when(url.startswith("mailto:"), "mailto")
        .when(url.startswith("#"), "anchor")
        .when(url.startswith("/"), "absolute")
        .when(url.isNotNull(), "relative")
    )


def ignored_by(url: Column, patterns: Sequence[str], internal_only: bool = False) -> Column:
    """The first pattern, in list order, that the url contains; null if there is none."""
    all_ = [*patterns, *(["http://", "https://"] if internal_only else [])]
    return F.coalesce(*[F.when(url.contains(p), F.lit(p)) for p in all_], F.lit(None).cast("string"))


def file_part(url: Column) -> Column:
    """What stands before the first ``#``."""
    return F.substring_index(url, "#", 1)


def anchor_part(url: Column) -> Column:
    """What stands behind the first ``#``; null if there is none."""
    return F.when(F.instr(url, "#") > 0, F.substring(url, F.instr(url, "#") + 1, F.length(url)))


def repository(url: Column) -> Column:
    """owner, name, branch and path of a repository url (https, blob links), as a struct; null fields where they don't apply."""
    pattern = r"^https://github\.com/([^/]+)/([^/#]+)(?:/blob/([^/]+)/([^#]+))?"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch"), part(4).alias("path"))


def target(doc_path: Column, base_path: Column, url: Column) -> Column:
    """The path a relative or absolute url resolves to."""
    file = file_part(url)
    return F.when(file.startswith("/"), paths.join(base_path, F.ltrim(file, F.lit("/")))).otherwise(paths.join(paths.directory(doc_path), file))


def inventory(files: DataFrame) -> DataFrame:
    """(path) of all files and of the directories they are in, each once."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where("path is not null").select(F.explode(above).alias("path")).distinct()


def anchor_flags(headings: DataFrame) -> DataFrame:
    """(doc_path, anchor, narrow) that headings (doc_path, ord, text) give, each once.

    ``narrow`` anchors, variants and numbered repetitions of the primary slug, count for links from anywhere; numbered
    variants and the raw lower-cased text with hyphens for spaces count for links within a page only.
    """
    primary = headings.where("text is not null").withColumn("slug", anchors.slug(F.col("text")))
    repeat = primary.withColumn("k", F.row_number().over(Window.partitionBy("doc_path", "slug").orderBy("ord")) - 1)
    forms = anchors.variants(F.col("text"))
    repeated = lambda xs: F.when(F.col("k") > 0, xs).otherwise(F.array().cast("array<string>"))
    number = lambda v: F.concat_ws("-", v, F.col("k").cast("string"))
    narrow = F.concat(forms, repeated(F.array(number(F.col("slug")))))
    wide = F.concat(repeated(F.transform(forms, number)), F.array(F.replace(F.lower("text"), F.lit(" "), F.lit("-"))))
    marked = lambda xs, flag: F.transform(xs, lambda v: F.struct(v.alias("anchor"), F.lit(flag).alias("narrow")))
    rows = repeat.select("doc_path", F.inline(F.concat(marked(narrow, True), marked(wide, False)))).where("anchor <> ''")
    return rows.groupBy("doc_path", "anchor").agg(F.bool_or("narrow").alias("narrow"))


def anchor_rows(headings: DataFrame, wide: bool) -> DataFrame:
    """(doc_path, anchor) that headings give: all for links within a page (``wide``), or those that count from anywhere."""
    rows = anchor_flags(headings)
    return (rows if wide else rows.where("narrow")).select("doc_path", "anchor")


def check_internal(links: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """Status, message and suggestion of relative, absolute and same-page links.

    ``links``: link_id, doc_path, base_path, url. A target exists if it is a file or directory, or with ``.md`` added. Anchors
    are checked in the page itself and in other Markdown pages, not behind absolute links. Of an anchor that isn't there,
    lost_page and lost_anchor say in which page it was looked for. Null urls give no rows.
    """
    url = F.col("url")
    base = links.where("url is not null").select("link_id", "doc_path", "base_path", "url", kind(url).alias("kind")).where(F.col("kind").isin("relative", "absolute", "anchor"))
    own = F.col("kind") == "anchor"
    base = base.select(
        "link_id", "doc_path", "url", "kind", file_part(url).alias("file"),
        F.when(own, F.substring(url, 2, 1 << 30)).otherwise(F.coalesce(anchor_part(url), F.lit(""))).alias("anchor"),
        F.coalesce(F.when(own, F.col("doc_path")).otherwise(target(F.col("doc_path"), F.col("base_path"), url)), F.lit("")).alias("target"),
    )
    # What doesn't depend on the link itself is settled once for each distinct kind, target and anchor.
    keys = base.select("kind", "target", "anchor").distinct()
    have = inventory(files)
    exact = have.select(F.col("path").alias("target"), F.lit(True).alias("exact"), F.lit(None).cast("boolean").alias("added"))
    added = have.where(F.col("path").endswith(".md")).select(F.regexp_replace("path", r"\.md$", "").alias("target"), F.lit(None).cast("boolean").alias("exact"), F.lit(True).alias("added"))
    known = exact.unionByName(added).groupBy("target").agg(F.bool_or("exact").alias("exact"), F.bool_or("added").alias("added"))
    found = F.when(own | F.col("exact"), F.col("target")).when(F.col("added"), F.concat("target", F.lit(".md")))
    placed = keys.join(known, "target", "left").select("kind", "target", "anchor", found.alias("found"))
    there = anchor_flags(headings).withColumnRenamed("doc_path", "found")
    met = placed.join(there, ["found", "anchor"], "left")
    lost = F.when(own, F.col("narrow").isNull()).otherwise((F.col("kind") == "relative") & (F.col("anchor") != "") & F.col("found").rlike(r"\.mdx?$") & ~F.coalesce("narrow", F.lit(False)))
    met = met.select("kind", "target", "anchor", "found", F.coalesce(lost, F.lit(False)).alias("lost"))
    met = met.withColumn("base", F.when(own & F.col("lost"), F.regexp_extract("anchor", r"^(.+)-(\d+)$", 1)))
    bases = there.select("found", F.col("anchor").alias("base"), F.lit(True).alias("has_base"))
    state = met.join(bases, ["found", "base"], "left").select("kind", "target", "anchor", "found", "lost", F.when(F.col("has_base"), F.col("base")).alias("stale"))
    rows = spread_join(base, state, ["kind", "target", "anchor"])
    absent, gone = F.col("found").isNull(), F.col("lost")
    message = (
        F.when(absent, F.concat(F.lit("File not found: "), "file"))
        .when(gone & ~own, F.concat(F.lit("Anchor #"), "anchor", F.lit(" not found in "), "file"))
        .when(gone & F.col("stale").isNotNull(), F.concat(F.lit("Anchor #"), "anchor", F.lit(" not found (numbered anchor may be outdated)")))
        .when(gone, F.concat(F.lit("Anchor #"), "anchor", F.lit(" not found")))
    )
    suggestion = (
        F.when(absent & (F.col("kind") == "relative") & ~F.col("file").endswith(".md"), F.concat(F.lit("Did you mean "), "file", F.lit(".md?")))
        .when(F.col("stale").isNotNull(), F.concat(F.lit("Did you mean #"), "stale", F.lit("?")))
    )
    return rows.select(
        "link_id", "doc_path", "url", F.when(absent | gone, "broken").otherwise("ok").alias("status"), message.alias("error_message"), suggestion.alias("suggestion"),
        F.when(gone, F.col("found")).alias("lost_page"), F.when(gone, F.col("anchor")).alias("lost_anchor"),
    )


def lost_anchors(checked: DataFrame) -> DataFrame:
    """(link_id, doc_path, anchor): anchors without a suggestion, of rows of ``check_internal``, with the page they should be in."""
    lost = checked.where("lost_anchor is not null and suggestion is null")
    return lost.select("link_id", F.col("lost_page").alias("doc_path"), F.col("lost_anchor").alias("anchor"))


def suggest_anchors(broken: DataFrame, headings: DataFrame, least: float = 0.5) -> DataFrame:
    """(link_id, suggestion): the page's primary slug most like a broken anchor (doc_path, anchor), if more than ``least``.

    Ties go to the smaller slug. Each distinct anchor of a page meets that page's slugs once, and a sequence matcher runs
    only where lengths and letters in common leave room for more than ``least``.
    """
    slugs = headings.where("text is not null").select("doc_path", anchors.slug(F.col("text")).alias("slug")).where("slug <> ''").distinct()
    broken = stored(broken.select("link_id", "doc_path", "anchor"))  # what finds them is computed once
    asked = broken.select("doc_path", "anchor").distinct()
    met = asked.join(slugs, "doc_path").withColumn("ratio", similarity.ratio_above(F.lower("anchor"), F.lower("slug"), least)).where("ratio is not null")
    best = met.groupBy("doc_path", "anchor").agg(F.min_by("slug", F.struct((-F.col("ratio")).alias("r"), "slug")).alias("slug"))
    return spread_join(broken, best, ["doc_path", "anchor"], "inner").select("link_id", F.concat(F.lit("Did you mean #"), "slug", F.lit("?")).alias("suggestion"))


def probe_status(probes: DataFrame, retries: int = 2) -> DataFrame:
    """(url, status, status_code, error_message, n_attempts) from a log of attempts (url, attempt, status_code, error).

    Attempts after the first that settles the matter, or after ``retries`` more, don't count. Below 400 is ok, other codes
    are broken; an error naming a timeout is a timeout, any other an error.
    """
    final = F.col("status_code").isNotNull() & ~F.col("status_code").isin(*RETRYABLE)
    settled = F.min(F.when(final, F.col("attempt"))).over(Window.partitionBy("url"))
    used = probes.where(F.col("attempt") <= retries + 1).withColumn("end", settled).where("end is null or attempt <= end")
    last = used.groupBy("url").agg(F.max_by(F.struct("status_code", "error"), "attempt").alias("l"), F.max("attempt").alias("n_attempts"))
    code, error = F.col("l.status_code"), F.col("l.error")
    status = F.when(code.isNotNull(), F.when(code < 400, "ok").otherwise("broken")).when(F.lower(error).contains("timeout"), "timeout").otherwise("error")
    message = F.when(code >= 400, F.format_string("HTTP %d", code)).when(code.isNull(), error)
    return last.select("url", status.alias("status"), code.alias("status_code"), message.alias("error_message"), "n_attempts")


def route(url: Column) -> Column:
    """Where an external url is checked, with the parts that the check needs: by the API of a repository host (``repository``
    or, for a link to a file, ``repository_file``) or by a plain request (``request``)."""
    r = repository(url)
    kind_ = F.when(r["path"].isNotNull(), "repository_file").when(r["repo"].isNotNull(), "repository").otherwise("request")
    return F.struct(kind_.alias("route"), r["owner"].alias("owner"), r["repo"].alias("repo"), r["branch"].alias("branch"), r["path"].alias("path"))


def repository_results(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """(url, status, status_code, suggestion) of repository links from answers (owner, repo, branch, path, repo_code, file_code,
    default_branch), one row per distinct owner, repo, branch and path; urls without an answer are errors.

    Where a file is missing on the branch of the link and the repository has another default branch, that is suggested.
    """
    parts = urls.where("url is not null").select("url", route(F.col("url")).alias("r")).select("url", "r.*").where("route <> 'request'")
    text = lambda c: F.coalesce(c, F.lit(""))
    key = ["owner", "repo", "branch", "path"]
    known = answers.select(*[text(F.col(c)).alias(c) for c in key], "repo_code", "file_code", "default_branch")
    rows = spread_join(parts.select("url", "route", *[text(F.col(c)).alias(c) for c in key]), known, key)
    status = F.coalesce(repository_status(F.col("repo_code"), F.col("file_code"), F.col("route") == "repository_file"), F.lit("error"))
    code = F.when(F.col("route") == "repository_file", F.coalesce(F.when(F.col("repo_code") == 200, F.col("file_code")), F.col("repo_code"))).otherwise(F.col("repo_code"))
    hint = F.when((status == "broken") & (F.col("repo_code") == 200) & (F.col("default_branch") != F.col("branch")), F.concat(F.lit("Try branch "), "default_branch"))
    return rows.select("url", status.alias("status"), code.alias("status_code"), hint.alias("suggestion"))


def repository_status(repo_code: Column, file_code: Column, has_path: Column) -> Column:
    """Status of a repository link by the answers of a REST API: missing repository or file broken, other failures error."""
    return (
        F.when(repo_code == 404, "broken").when(repo_code != 200, "error").when(has_path & (file_code == 404), "broken").when(repo_code == 200, "ok")
    )


def with_cache(links: DataFrame, live: DataFrame) -> DataFrame:
    """Links with the columns cached_status and cached_code of a live cache (url, status, status_code), null where there is none.

    ``live`` has one row per url. Urls that many links share are salted.
    """
    return spread_join(links, live.select("url", F.col("status").alias("cached_status"), F.col("status_code").alias("cached_code")), ["url"])


def counts(results: DataFrame, by: Sequence[str] = ("doc_path",)) -> DataFrame:
    """broken, ok and total per ``by``; cached, skipped, timeout and error are in the total only."""
    status = F.col("status")
    return results.groupBy(*by).agg(F.count_if(status == "broken").alias("broken"), F.count_if(status == "ok").alias("ok"), F.count("*").alias("total"))


def summary(results: DataFrame) -> DataFrame:
    """One row over all documents with at least one link."""
    status = F.col("status")
    return results.agg(F.count_distinct("doc_path").alias("files_checked"), F.count("*").alias("total"), F.count_if(status == "broken").alias("broken"), F.count_if(status == "ok").alias("ok"))


def fail_fast(results: DataFrame) -> DataFrame:
    """Results up to and with the first document, in path order, that has a broken link; all if none has."""
    order = F.split("doc_path", "/")
    first = results.where(F.col("status") == "broken").agg(F.min(order).alias("__first"))
    return results.join(F.broadcast(first), (F.col("__first").isNull()) | (order <= F.col("__first"))).drop("__first")  # one row


def annotations(results: DataFrame) -> DataFrame:
    """A workflow annotation for each broken link."""
    text = F.concat(
        F.lit("::error file="), "doc_path", F.lit(",line="), F.col("line").cast("string"), F.lit("::Broken link: "), "url",
        F.coalesce(F.concat(F.lit(" - "), "error_message"), F.lit("")),
    )
    return results.where(F.col("status") == "broken").select("link_id", text.alias("annotation"))
