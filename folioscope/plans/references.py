"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references
from ..session import table
from .sql import path_sql, slug_sql


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Links in scope whose page or heading was missing when they were checked."""
    return references.link_orphans(table(spark, d, "link_results"), table(spark, d, "markdown_docs")).select("link_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts per repo and month, beside what the status had claimed."""
    return references.link_orphan_report(table(spark, d, "link_results"), table(spark, d, "markdown_docs"))


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references between tables, per table, reference and month where rows have a time."""
    t = lambda name: table(spark, d, name)
    pages = t("markdown_docs").select("doc_path")
    month, never = F.date_format("checked_ts", "yyyy-MM"), F.lit(None).cast("string")
    indexed = pages.select(F.col("doc_path").alias("path")).union(t("symbols").select("file_path"))
    references_ = [
        ("link_results.doc_path", t("link_results").select("doc_path", "checked_ts"), "doc_path", pages, "doc_path", month),
        ("code_blocks.doc_path", t("code_blocks").select("doc_path"), "doc_path", pages, "doc_path", never),
        ("snippet_results.code_id", t("snippet_results").select("code_id"), "code_id", t("code_blocks"), "code_id", never),
        ("snippet_results.source_path", t("snippet_results").select("source_path"), "source_path", t("symbols"), "file_path", never),
        ("embedding_cache.path", t("embedding_cache").select("path"), "path", indexed, "path", never),
    ]
    out = None
    for name, rows, key, parents, parent_key, period in references_:
        known = rows.where(F.col(key).isNotNull())
        one = references.orphan_counts(known, references.orphans(known, [key], parents, [parent_key]), period, name)
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_tables": p5_tables}

_DIR = "regexp_extract(doc_path, '^(.*)/[^/]*$', 1)"
_SCOPE = f"""
scoped as (select distinct on (link_id) link_id, repo, doc_path, status, checked_ts, split_part(url, '#', 1) as f, case when contains(url, '#') then nullif(substr(url, strpos(url, '#') + 1), '') end as a
  from link_results where url <> '' and not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*:')),
wanted as (select *, case when f = '' then doc_path when f like '/%' then {path_sql('repo', "ltrim(f, '/')")} else {path_sql(_DIR, 'f')} end as target
  from scoped where f = '' or regexp_matches(f, '\\.mdx?$') or not regexp_matches(f, '\\.[^/]*$')),
pages as (select row_number() over () as p, * from (select distinct doc_path, headings, added_ts, deleted_ts from markdown_docs)),
slugs as (select p, {slug_sql('h.text')} as slug, i from (select p, unnest(headings) as h, generate_subscripts(headings, 1) as i from pages)),
anchors as (select p, case when k = 0 then slug else slug || '-' || k end as anchor from (select p, slug, row_number() over (partition by p, slug order by i) - 1 as k from slugs)),
alive as (select w.link_id, min(case when g.doc_path = w.target then 0 else 1 end) as best from wanted w join pages g on g.doc_path in (w.target, w.target || '.md') and g.added_ts <= w.checked_ts and (g.deleted_ts is null or g.deleted_ts > w.checked_ts) group by 1),
fine as (select distinct w.link_id from wanted w join alive using (link_id) join pages g on g.doc_path = case when best = 0 then w.target else w.target || '.md' end
  and g.added_ts <= w.checked_ts and (g.deleted_ts is null or g.deleted_ts > w.checked_ts) left join anchors n on n.p = g.p and n.anchor = w.a where w.a is null or n.anchor is not null),
lost as (select w.*, case when alive.link_id is null then 'page' else 'anchor' end as reason from wanted w left join alive using (link_id) where w.link_id not in (select link_id from fine))"""

_INDEXED = "(select doc_path as path from markdown_docs union select file_path from symbols)"


def _count_sql(name: str, key: str, parents: str, parent_key: str, period: str = "null") -> str:
    lost = f"{key} not in (select {parent_key} from {parents} where {parent_key} is not null)"
    return f"select '{name}.{key}' as table_name, {period}::varchar as period, count(*) as n_rows, count(*) filter ({lost}) as n_orphans from {name} where {key} is not null group by 1, 2"


SQL = {
    "p5_tables": " union all ".join([
        _count_sql("link_results", "doc_path", "markdown_docs", "doc_path", "strftime(checked_ts, '%Y-%m')"),
        _count_sql("code_blocks", "doc_path", "markdown_docs", "doc_path"),
        _count_sql("snippet_results", "code_id", "code_blocks", "code_id"),
        _count_sql("snippet_results", "source_path", "symbols", "file_path"),
        _count_sql("embedding_cache", "path", _INDEXED, "path"),
    ]),
    "p5_found": f"with {_SCOPE} select link_id from lost",
    "p5_report": f"""with {_SCOPE}, every_row as (select repo, strftime(checked_ts, '%Y-%m') as month, 1 as n, null as reason, null as status from wanted
  union all select repo, strftime(checked_ts, '%Y-%m'), 0, reason, coalesce(status, 'none') from lost)
select repo, month, sum(n)::bigint as n_links, count(reason) as n_orphans, count(*) filter (reason = 'page') as n_page, count(*) filter (reason = 'anchor') as n_anchor,
  count(*) filter (status in ('ok', 'cached', 'skipped')) as n_claimed_fine, count(*) filter (status = 'broken') as n_claimed_broken, count(*) filter (status = 'none') as n_unclaimed
from every_row group by 1, 2""",
}
