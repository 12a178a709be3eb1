"""Proposed fixes of broken links and their application to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import links as L

#: Rounds of the fix loop at most.
ROUNDS = 5


def is_safe(original: Column, suggested: Column) -> Column:
    """Whether two anchors differ in case and hyphens only."""
    bare = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit(""))
    return bare(original) == bare(suggested)


def relative(directory: Column, path: Column) -> Column:
    """``./x`` of a path under the directory, the path as it is otherwise."""
    under = path.startswith(F.concat(directory, F.lit("/")))
    rest = F.substring(path, F.length(directory) + 2, F.length(path))
    return F.when(under, F.when(rest.startswith("."), rest).otherwise(F.concat(F.lit("./"), rest))).when(directory == "", F.concat(F.lit("./"), path)).otherwise(path)


def propose(broken: DataFrame, files: DataFrame) -> DataFrame:
    """A fix for each broken link that has one: link_id, file_path, line, original_url, suggested_url, description, auto_fixable.

    ``broken``: link_id, doc_path, base_path, line, url, suggestion, error_message. In this order: ``.md`` added to an
    internal url; the suggested anchor, by itself if it is safe and for review if not; the only name in the target's
    directory that differs in case (the smallest of several); external links for review. ``files``: (path).
    """
    url = F.col("url")
    inner = ~url.startswith("http") & ~url.startswith("#")
    have = files.where("path is not null").select("path").distinct()
    rows = broken.where("url is not null").withColumn("target", L.target(F.col("doc_path"), F.col("base_path"), url))
    added = have.where(F.col("path").endswith(".md")).select(F.regexp_replace("path", r"\.md$", "").alias("target"), F.lit(True).alias("has_md"))
    cased = have.groupBy(paths.directory(F.col("path")).alias("dir"), F.lower(paths.name(F.col("path"))).alias("low")).agg(F.min("path").alias("cased"))
    exact = have.select(F.col("path").alias("target"), F.lit(True).alias("exact"))
    rows = rows.join(added, "target", "left").join(exact, "target", "left")
    rows = rows.withColumn("dir", paths.directory(F.col("target"))).withColumn("low", F.lower(paths.name(F.col("target")))).join(cased, ["dir", "low"], "left")
    hint = F.nullif(F.regexp_extract(F.coalesce("suggestion", F.lit("")), r"Did you mean #([^?]+)\?", 1), F.lit(""))
    original = F.when(F.instr(url, "#") > 0, F.substring_index(F.substring(url, F.instr(url, "#") + 1, F.length(url)), "#", 1)).otherwise(url)
    one = lambda s, d, a: F.struct(s.alias("suggested_url"), d.alias("description"), F.lit(a).alias("auto_fixable"))
    text = F.lit
    fix = F.coalesce(
        F.when(inner & ~url.rlike(r"\.mdx?$") & F.col("has_md"), one(F.concat(url, text(".md")), text("Add .md extension"), True)),
        F.when(hint.isNotNull() & is_safe(original, hint), one(F.concat(F.when(F.instr(url, "#") > 0, L.file_part(url)).otherwise(""), text("#"), hint), F.concat(text("Fix anchor: #"), original, text(" → #"), hint), True)),
        F.when(hint.isNotNull(), one(F.concat(text("#"), hint), F.concat(text("Anchor not found (suggestion: #"), hint, text(") - needs manual review")), False)),
        F.when(inner & F.col("exact").isNull() & F.col("cased").isNotNull(), one(relative(paths.directory(F.col("doc_path")), F.col("cased")), F.concat(text("Fix case: "), paths.name(F.col("target")), text(" → "), paths.name(F.col("cased"))), True)),
        F.when(url.startswith("http"), one(url, F.concat(text("External link broken - needs manual review: "), F.coalesce("error_message", text("None"))), False)),
    )
    return rows.withColumn("fix", fix).where("fix is not null").select("link_id", F.col("doc_path").alias("file_path"), "line", F.col("url").alias("original_url"), "fix.*")


def remaining(broken: DataFrame, fixes: DataFrame) -> DataFrame:
    """Broken links (url and others) whose url no automatic fix has: what is left for people to look at.

    By url alone, as users know it: the same url is left out in other files, too.
    """
    return broken.join(fixes.where("auto_fixable").select(F.col("original_url").alias("url")).distinct(), "url", "left_anti")


def apply(documents: DataFrame, fixes: DataFrame) -> DataFrame:
    """Pages with their automatic fixes: doc_path, fixed_content, attempted, succeeded.

    Each fix replaces the first occurrence of its url on its line, one after the other in order of line and url. A url that
    isn't on its line leaves the page as it is and doesn't count as succeeded. Pages without fixes aren't returned.
    """
    auto = fixes.where("auto_fixable and original_url is not null and suggested_url is not null")
    lists = auto.groupBy(F.col("file_path").alias("doc_path")).agg(F.array_sort(F.collect_list(F.struct("line", "original_url", "suggested_url"))).alias("fixes"))
    start = lambda: F.struct(F.split("content", "\n").alias("rows"), F.lit(0).alias("n"))

    def step(s: Column, f: Column) -> Column:
        row = F.try_element_at(s["rows"], F.greatest(f["line"], F.lit(1)))
        at = F.call_function("instr", row, f["original_url"])
        fixed = F.concat(F.call_function("left", row, at - 1), f["suggested_url"], F.call_function("substring", row, at + F.length(f["original_url"]), F.length(row)))
        hit = F.coalesce(at > 0, F.lit(False)) & (f["line"] >= 1)
        changed = F.transform(s["rows"], lambda r, i: F.when(hit & (i + 1 == f["line"]), fixed).otherwise(r))
        return F.struct(changed.alias("rows"), (s["n"] + hit.cast("int")).alias("n"))

    done = documents.where("content is not null").join(lists, "doc_path").select("doc_path", F.size("fixes").alias("attempted"), F.aggregate("fixes", start(), step).alias("s"))
    return done.select("doc_path", F.array_join("s.rows", "\n").alias("fixed_content"), "attempted", F.col("s.n").alias("succeeded"))


def iterate(documents: DataFrame, check, propose_fixes, rounds: int = ROUNDS, keep=lambda df: df) -> tuple[DataFrame, list[dict]]:
    """Check, propose and apply until nothing is broken, nothing can be fixed or nothing was; the pages and a log of rounds.

    ``check(documents)`` gives broken links, ``propose_fixes(broken, documents)`` their fixes; ``keep`` cuts the lineage
    after each round (a checkpoint, for instance).
    """
    log = []
    for n in range(1, rounds + 1):
        broken = keep(check(documents))
        fixes = keep(propose_fixes(broken, documents)) if not broken.isEmpty() else None
        if fixes is None or fixes.where("auto_fixable").isEmpty():
            log.append({"round": n, "attempted": 0, "succeeded": 0})
            break
        applied = keep(apply(documents, fixes))
        sums = applied.agg(F.sum("attempted").alias("a"), F.sum("succeeded").alias("s")).first()
        log.append({"round": n, "attempted": sums["a"] or 0, "succeeded": sums["s"] or 0})
        if not sums["s"]:
            break
        fixed = applied.select("doc_path", "fixed_content")
        documents = keep(documents.join(fixed, "doc_path", "left").withColumn("content", F.coalesce("fixed_content", "content")).drop("fixed_content"))
    return documents, log
