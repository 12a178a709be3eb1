"""The commands of a documentation check as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import globs
from .operators import fixes, links, owners, reports, semantic, snippets
from .session import spread_join
from .sources import caches, markdown


def scan(
    documents: DataFrame,
    files: DataFrame,
    cache: DataFrame | None = None,
    now=None,
    probes: DataFrame | None = None,
    ignore: Sequence[str] = (),
    internal_only: bool = False,
    exclude: Sequence[str] = (),
    ttl_hours: float = 24,
    retries: int = 2,
    repositories: DataFrame | None = None,
) -> DataFrame:
    """Every link of the pages with its status.

    In this order: ignored and mailto links are skipped; internal ones are checked against ``files`` and headings; external
    ones are cached if a live cache row has them, else, for links to a repository host, as the answers of its API in
    ``repositories`` say, else as the log of ``probes`` says, else error. Columns: link_id,
    doc_path, ord, text, url, line, is_image, status, status_code, error_message, suggestion, from_cache.
    """
    pages = documents.where(~globs.excluded(F.col("doc_path"), exclude)) if exclude else documents
    scanned = markdown.scan(pages)
    all_ = markdown.links(scanned).withColumn("link_id", F.xxhash64("doc_path", "ord"))
    reason = links.ignored_by(F.col("url"), ignore, internal_only)
    all_ = all_.withColumn("kind", links.kind(F.col("url"))).withColumn("ignored", reason)
    inner = all_.where("ignored is null and kind in ('relative', 'absolute', 'anchor')")
    heads = markdown.headings(scanned)
    checked = links.check_internal(inner.select("link_id", "doc_path", "base_path", "url"), files.select("path"), heads)
    near = links.suggest_anchors(links.lost_anchors(checked), heads).withColumnRenamed("suggestion", "near")
    checked = checked.join(near, "link_id", "left").select("link_id", "status", "error_message", F.coalesce("suggestion", "near").alias("suggestion"))
    urls = all_.where("ignored is null and kind = 'external'").select("url").distinct()
    nothing = urls.sparkSession.createDataFrame([], "url string, status string, status_code int, error string, ts timestamp, response_time double")
    live = caches.lookup(cache if cache is not None else nothing, urls, now if now is not None else F.current_timestamp(), ttl_hours)
    probed = links.probe_status(probes if probes is not None else urls.sparkSession.createDataFrame([], "url string, attempt int, status_code int, error string, elapsed double"), retries)
    outer = (
        urls.join(live.select("url", F.col("status").alias("c_status"), F.col("status_code").alias("c_code"), F.col("error").alias("c_error")), "url", "left")
        .join(probed.select("url", F.col("status").alias("p_status"), F.col("status_code").alias("p_code"), F.col("error_message").alias("p_error")), "url", "left")
        .select(
            "url", F.when(F.col("c_status").isNotNull(), "cached").otherwise(F.coalesce("p_status", F.lit("error"))).alias("o_status"),
            F.coalesce(F.when(F.col("c_status").isNotNull(), F.col("c_code")), F.col("p_code")).alias("status_code"),
            F.when(F.col("c_status").isNotNull(), F.col("c_error")).otherwise(F.coalesce("p_error", F.when(F.col("p_status").isNull(), "not probed"))).alias("o_error"),
            F.col("c_status").isNotNull().alias("from_cache"),
        )
    )
    if repositories is not None:
        told = links.repository_results(urls, repositories).select("url", F.col("status").alias("r_status"), F.col("status_code").alias("r_code"), F.col("suggestion").alias("r_hint"))
        outer = outer.join(told, "url", "left")
        routed = F.col("r_status").isNotNull() & ~F.col("from_cache")
        outer = outer.select(
            "url", F.when(routed, F.col("r_status")).otherwise(F.col("o_status")).alias("o_status"), F.when(routed, F.col("r_code")).otherwise(F.col("status_code")).alias("status_code"),
            F.when(routed, None).otherwise(F.col("o_error")).alias("o_error"), "from_cache", F.when(routed, F.col("r_hint")).alias("o_hint"),
        )
    else:
        outer = outer.withColumn("o_hint", F.lit(None).cast("string"))
    both = spread_join(all_.join(checked, "link_id", "left"), outer, ["url"])
    skipped = F.col("ignored").isNotNull() | (F.col("kind") == "mailto")
    return both.select(
        "link_id", "doc_path", "ord", "text", "url", "line", "is_image",
        F.when(skipped, "skipped").otherwise(F.coalesce("status", "o_status")).alias("status"),
        F.when(~skipped, F.col("status_code")).alias("status_code"),
        F.when(F.col("ignored").isNotNull(), F.concat(F.lit("Ignored by pattern: "), "ignored")).otherwise(F.coalesce("error_message", "o_error")).alias("error_message"),
        F.coalesce("suggestion", "o_hint").alias("suggestion"), F.coalesce("from_cache", F.lit(False)).alias("from_cache"),
    )


def validate_snippets(documents: DataFrame, symbols: DataFrame, threshold: float = 0.8, by_content: bool | str = "shingles", vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Status of every snippet of the pages against source symbols.

    ``by_content``: True compares all codes, exactly and in quadratic time; ``shingles`` those with stretches in common.
    """
    blocks = markdown.code_blocks(markdown.scan(documents)).withColumn("code_id", F.xxhash64("doc_path", "ord"))
    return snippets.validate(blocks, symbols, threshold, by_content, vectors)


def orphaned_docs(docs: DataFrame, code: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pages that no code is similar to."""
    return semantic.orphans(docs, code, threshold)


def missing_docs(docs: DataFrame, code: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Code that no page is similar to."""
    return semantic.orphans(code, docs, threshold)


def related_code(docs: DataFrame, code: DataFrame, k: int = 5) -> DataFrame:
    """The code most similar to each page."""
    return semantic.related(docs, code, k)


def similar_code(snippets_: DataFrame, code: DataFrame, k: int = 3, threshold: float = 0.3) -> DataFrame:
    """The code nearest to each snippet's vector."""
    return semantic.nearest(snippets_, code, k, threshold, "distance")


def report(results: DataFrame, text: str, path: str, markdown_: bool = False) -> None:
    """Write the report of a scan, with owners by the text of an owners file, to a folder."""
    named = owners_of(results, text)
    reports.write_report(reports.scan_markdown(named) if markdown_ else reports.scan_json(named), path)


def owners_of(files: DataFrame, text: str, path: str = "doc_path") -> DataFrame:
    """Files with their owners, by the text of an owners file."""
    return owners.keyed(files, *owners.parse_rules(text), path=path)


def fix_plan(results: DataFrame, files: DataFrame, text: str, base: str = "", only: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """Per owner the plan of automatic fixes of broken links."""
    broken = results.where("status = 'broken'").withColumn("base_path", F.lit(base))
    proposed = fixes.propose(broken, files)
    named = owners.keyed(proposed, *owners.parse_rules(text), path="file_path")
    return owners.fix_plan(owners.chosen(named, only, skip))


def failed(results: DataFrame, strict: bool = False) -> bool:
    """Whether a scan fails: something is broken, or, if ``strict``, in error or timed out."""
    return not results.where(F.col("status").isin("broken", *(["error", "timeout"] if strict else []))).isEmpty()
