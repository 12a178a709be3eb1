"""Queries on links, anchors, owners, caches, pages and snippets, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anchors, globs, paths, similarity
from ..operators import fixes, links, owners, reports, semantic, snippets, symbols
from ..session import checkpoint_dir, stored, table, temporary
from ..sources import caches, markdown
from ..sources.store import KeyedTable
from ..streaming import caches as streams
from .sql import path_sql, slug_sql

#: The time at which caches are looked at.
NOW = "2025-09-01 00:00:00"

#: An owners file over the pages' trees.
OWNERS = """
# owners of the documentation
*                @docs/everyone
*-cli/           @team/cli @docs/everyone
/lonen-stack/    @team/stack
docs/**          @docs/core
notes            @team/notes
*.mdx            @docs/web
**/api/*.md      @team/api
!**/howto/**     @nobody
"""


def _links(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "link_results").dropDuplicates(["link_id"])


def _pages(s: SparkSession, d: str) -> DataFrame:
    """One row per page: the version added last."""
    return caches.latest(table(s, d, "markdown_docs").select("doc_path", "base_path", "content", "headings", "added_ts"), ["doc_path"], ["added_ts"])


def _headings(s: SparkSession, d: str) -> DataFrame:
    pages = caches.latest(table(s, d, "markdown_docs").select("doc_path", "headings", "added_ts"), ["doc_path"], ["added_ts"])
    return pages.select("doc_path", F.posexplode("headings").alias("ord", "h")).select("doc_path", "ord", "h.level", "h.text", "h.line")


def _files(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "markdown_docs").select(F.col("doc_path").alias("path"))
    return a.union(table(s, d, "symbols").select("file_path")).distinct()


def link_classify(s, d):
    k = links.kind(F.col("url"))
    return _links(s, d).groupBy(k.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))


def ignore_filter(s, d):
    hit = links.ignored_by(F.col("url"), ["lanternfish", "badge", "/img/"], internal_only=True)
    return _links(s, d).select("link_id", hit.alias("pattern")).where("pattern is not null")


def exclude_globs(s, d):
    pages = table(s, d, "markdown_docs").select("doc_path").distinct()
    return pages.where(~globs.excluded(F.col("doc_path"), ["*/notes/*", "**/api/**", "README*"]))


def file_anchor_split(s, d):
    return _links(s, d).where("url is not null").select("link_id", links.file_part(F.col("url")).alias("file"), links.anchor_part(F.col("url")).alias("anchor"))


def link_check(s, d):
    rows = _links(s, d).select("link_id", "doc_path", F.col("repo").alias("base_path"), "url")
    return links.check_internal(rows, _files(s, d), _headings(s, d)).select("link_id", "status")


def _checked(s, d):
    rows = _links(s, d).select("link_id", "doc_path", F.col("repo").alias("base_path"), "url")
    return links.check_internal(rows, _files(s, d), _headings(s, d))


def link_broken(s, d):
    return _checked(s, d).where("status = 'broken'").drop("lost_page", "lost_anchor")


def anchor_slug(s, d):
    return _headings(s, d).select("text").distinct().select("text", anchors.slug(F.col("text")).alias("slug"))


def anchor_variants(s, d):
    return _headings(s, d).select("text").distinct().select("text", F.explode(anchors.variants(F.col("text"))).alias("variant"))


def anchor_numbering(s, d):
    return links.anchor_rows(_headings(s, d), False)


def anchor_suggest(s, d):
    rows = _links(s, d).select("link_id", "doc_path", F.col("repo").alias("base_path"), "url")
    lost = links.lost_anchors(links.check_internal(rows, _files(s, d), _headings(s, d)))
    return links.suggest_anchors(lost, _headings(s, d))


def safe_anchor(s, d):
    own = _links(s, d).where("url like '#%'").select("link_id", "doc_path", F.substring("url", 2, 1 << 30).alias("anchor"))
    slugs = _headings(s, d).select("doc_path", anchors.slug(F.col("text")).alias("slug")).distinct()
    return own.join(slugs, "doc_path").where(fixes.is_safe(F.col("anchor"), F.col("slug"))).select("link_id", "slug")


def doc_link_counts(s, d):
    return links.counts(_links(s, d))


def scan_summary(s, d):
    return links.summary(_links(s, d))


def fail_fast(s, d):
    return links.fail_fast(_links(s, d)).select("link_id", "doc_path", "status")


def annotations(s, d):
    return links.annotations(_links(s, d))


def case_insensitive_fix(s, d):
    """Broken links in the case of which the path is wrong: the files they could mean."""
    rows = _links(s, d).where("url is not null and url not like 'http%' and url not like '#%'")
    rows = rows.withColumn("target", F.lower(links.target(F.col("doc_path"), F.col("repo"), F.col("url"))))
    files = _files(s, d).groupBy(F.lower("path").alias("target")).agg(F.min("path").alias("path"))
    return rows.join(files, "target").select("link_id", "path")


def _broken(s, d):
    """What checking finds broken now, with the place of each link; the status of earlier runs plays no part."""
    places = _links(s, d).select("link_id", F.col("repo").alias("base_path"), "line", "ord")
    return link_broken(s, d).join(places, "link_id")


def fix_proposals(s, d):
    """Fixes of broken links by missing endings, case and outdated numbered anchors."""
    return fixes.propose(_broken(s, d).drop("ord", "status"), _files(s, d))


def fix_anchors(s, d):
    """Fixes of anchors by the most similar heading of their page."""
    checked = stored(_checked(s, d).where("status = 'broken'"))
    hints = links.suggest_anchors(links.lost_anchors(checked), _headings(s, d))
    places = _links(s, d).select("link_id", F.col("repo").alias("base_path"), "line")
    rows = checked.drop("suggestion", "lost_page", "lost_anchor", "status").join(hints, "link_id").join(places, "link_id")
    return fixes.propose(rows, _files(s, d))


def fixes_first(s, d):
    """The first ten fixes of each owner, in order of file and line, as a plan shows them."""
    return owners.first_fixes(owners.keyed(fix_proposals(s, d), *owners.parse_rules(OWNERS), path="file_path"), 10)


def fixes_remaining(s, d):
    """Broken links that no automatic fix covers."""
    return fixes.remaining(_broken(s, d).select("link_id", "doc_path", "line", "url"), fix_proposals(s, d)).select("link_id", "url")


def fix_loop(s, d):
    """Rounds of checking and fixing, up to five: pages that changed, with what they hold in the end."""
    files, base = _files(s, d), _pages(s, d).select("doc_path", "base_path", "content")

    def check(documents):
        scanned = stored(markdown.scan(documents))
        own = markdown.links(scanned).withColumn("link_id", F.xxhash64("doc_path", "ord"))
        found = links.check_internal(own.select("link_id", "doc_path", "base_path", "url"), files, markdown.headings(scanned)).where("status = 'broken'")
        return found.select("link_id", "suggestion", "error_message").join(own.select("link_id", "doc_path", "base_path", "line", "url"), "link_id")

    pages, log = fixes.iterate(stored(base), check, lambda broken, documents: fixes.propose(broken, files), keep=stored)
    changed = pages.join(base.select("doc_path", F.col("content").alias("before")), "doc_path").where("content <> before")
    return changed.select("doc_path", F.sha2("content", 256).alias("fixed_hash"), F.lit(len(log)).alias("n_rounds"))


def pr_plan(s, d):
    named = owners.keyed(fix_proposals(s, d), *owners.parse_rules(OWNERS), path="file_path")
    return owners.fix_plan(named).select("owner_key", "branch", "title", "n_fixes", "n_files")


def apply_line_fix(s, d):
    return fixes.apply(_pages(s, d), fix_proposals(s, d)).select("doc_path", F.sha2("fixed_content", 256).alias("fixed_hash"), "attempted", "succeeded")


def json_report(s, d):
    """The parts of a JSON report: summary, owners and files."""
    return reports.scan_json(owners.keyed(_links(s, d), *owners.parse_rules(OWNERS)))


def markdown_report(s, d):
    """The parts of a Markdown report: the summary and the files with broken links."""
    return reports.scan_markdown(_links(s, d))


def _results(s, d):
    lines = _blocks(s, d).select("code_id", "line")
    return table(s, d, "snippet_results").dropDuplicates(["code_id"]).join(lines, "code_id", "left")


def snippet_report(s, d):
    """The parts of a JSON report on snippets: the summary and the pages."""
    return reports.snippet_json(_results(s, d))


def snippet_markdown(s, d):
    return reports.snippet_markdown(_results(s, d))


def exit_codes(s, d):
    """Whether each command would fail: links, snippets and undocumented code."""
    return reports.exit_codes(_links(s, d), table(s, d, "snippet_results").dropDuplicates(["code_id"]), orphaned_docs(s, d), missing_docs(s, d))


def owner_files(s, d):
    """The pages of each owner."""
    return owners.files_of(owners.keyed(table(s, d, "markdown_docs").select("doc_path").distinct(), *owners.parse_rules(OWNERS)))


def owner_fixable(s, d):
    """Per owner: broken links, those with an automatic fix, and the files to change."""
    broken = _broken(s, d).select("link_id", "doc_path")
    named = owners.keyed(broken, *owners.parse_rules(OWNERS))
    return owners.fixable(named, fix_proposals(s, d))


def external_status(s, d):
    """Status of external urls by the rules for retries, from the log of attempts."""
    from pyspark.sql import Window

    log = table(s, d, "link_status").where("url like 'http%' and ts is not null")
    attempt = F.row_number().over(Window.partitionBy("url").orderBy("ts", "status_id")).alias("attempt")
    return links.probe_status(log.select("url", attempt, "status_code", "error"))


def repository_routes(s, d):
    """Which external links go to which check: a repository's, one of its files', or a plain request."""
    urls = _links(s, d).where("url like 'http%'").select("url").distinct()
    return urls.select("url", links.route(F.col("url")).alias("r")).select("url", "r.*")


def owners_last_match(s, d):
    pages = table(s, d, "markdown_docs").select("doc_path").distinct()
    return owners.keyed(pages, *owners.parse_rules(OWNERS)).select("doc_path", "owner_key")


def owner_group_counts(s, d):
    return owners.group_counts(owners.keyed(_links(s, d), *owners.parse_rules(OWNERS)))


def owner_filter(s, d):
    return owners.chosen(owner_group_counts(s, d), ["team", "core"], ["notes"]).select("owner_key", "broken")


def owner_distinct(s, d):
    rules, default = owners.parse_rules(OWNERS)
    return owners.distinct_owners(s.createDataFrame([(r["owners"],) for r in rules], "owners array<string>"), default)


def cache_upsert(s, d):
    return caches.latest(table(s, d, "link_status").select("url", "status", "status_code", "ts", "status_id"), ["url"], ["ts", "status_id"])


def cache_lookup(s, d):
    return caches.lookup(cache_upsert(s, d), _links(s, d), F.lit(NOW).cast("timestamp_ntz"), 24 * 60).select("url", "status", "status_code")


def cache_join(s, d):
    live = caches.lookup(cache_upsert(s, d), _links(s, d), F.lit(NOW).cast("timestamp_ntz"), 24 * 60)
    return links.with_cache(_links(s, d), live).groupBy("cached_status").agg(F.count("*").alias("n"))


def cache_stats(s, d):
    return caches.statistics(cache_upsert(s, d).join(table(s, d, "link_status").select("status_id", "response_time"), "status_id"), F.lit(NOW).cast("timestamp_ntz"), 24 * 60).withColumn("avg_response_ms", F.round("avg_response_ms", 6))


def cache_cleanup(s, d):
    stay, gone = caches.expired(table(s, d, "link_status"), F.lit(NOW).cast("timestamp_ntz"), 24 * 60)
    return stay.select(F.lit("kept").alias("what")).unionByName(gone.select(F.lit("deleted").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


def cache_broken_topn(s, d):
    return caches.newest_broken(table(s, d, "link_status"), F.lit(NOW).cast("timestamp_ntz"), 24 * 365, 50).select("status_id", "url", "ts")


def incremental_index(s, d):
    files = table(s, d, "embedding_cache").where("content_hash is not null").select(F.col("path").alias("file_path"), "content_hash").distinct()
    now = _pages(s, d).select(F.col("doc_path").alias("file_path"), caches.content_hash(F.col("content")).alias("content_hash"))
    same, other = caches.unchanged(now, files)
    return same.select("file_path", F.lit(True).alias("unchanged")).unionByName(other.select("file_path", F.lit(False).alias("unchanged")))


def md_headings(s, d):
    return markdown.headings(markdown.scan(_pages(s, d))).select("doc_path", "level", "text", "line")


def md_code_blocks(s, d):
    blocks = markdown.code_blocks(markdown.scan(_pages(s, d)))
    return blocks.select("doc_path", "ord", "language", F.sha2("code", 256).alias("code_hash"), "line")


def md_links(s, d):
    """Links and images of the pages with their texts; repeated ones once."""
    return markdown.links(markdown.scan(_pages(s, d))).select("doc_path", "url", "text", "is_image", "is_reference").distinct()


def _blocks(s, d):
    return table(s, d, "code_blocks").dropDuplicates(["code_id"])


def file_hint(s, d):
    return _blocks(s, d).select("code_id", markdown.file_hint(F.col("code")).alias("file_hint"))


def snippet_symbols(s, d):
    return _blocks(s, d).select("code_id", F.array_join(markdown.snippet_symbols(F.col("code"), F.coalesce("language", F.lit(""))), ",").alias("symbols"))


def code_normalize(s, d):
    return _blocks(s, d).select("code_id", F.sha2(similarity.normalise_code(F.col("code")), 256).alias("normal_hash"))


def snippet_status(s, d):
    """Snippets by file hint, by name and by content, with the difference from their source."""
    source = table(s, d, "symbols").dropDuplicates(["code_id"]).withColumnRenamed("code_id", "symbol_id")
    found = snippets.validate(_blocks(s, d), source)
    return found.select("code_id", "status", F.round("similarity", 6).alias("similarity"), "strategy", "source_path", "source_line", "diff")


def snippet_rewrite(s, d):
    """Pages whose outdated snippets, by the suggestions of an earlier run, are replaced by their source."""
    todo = _results(s, d).where("status = 'outdated' and suggestion is not null and line is not null")
    done = snippets.rewrite(_pages(s, d).select("doc_path", "content"), todo.select("doc_path", "line", F.col("suggestion").alias("code")))
    return done.select("doc_path", F.sha2("fixed_content", 256).alias("fixed_hash"), "n_fixed")


def symbol_extract(s, d):
    """Symbols that scanning finds in the code of each class, as if it were a file."""
    from ..sources import code

    files = table(s, d, "symbols").where("type = 'class' and code is not null").dropDuplicates(["code_id"])
    ending = F.regexp_extract("file_path", r"(\.[^./]+)$", 1)
    return code.symbols(files.select(F.concat(F.col("code_id").cast("string"), ending).alias("file_path"), F.col("code").alias("content"))).select("file_path", "ord", "name", "type", "start_line", "end_line")


def embedding_lookup(s, d):
    """Which files an embedding pass may skip: cached with the same hash, or not there any more (which counts as a hit)."""
    now = _pages(s, d).select(F.col("doc_path").alias("path"), caches.content_hash(F.col("content")).alias("content_hash"))
    kept = table(s, d, "embedding_cache").where("path is not null and file_type = 'doc'").groupBy("path").agg(F.max("content_hash").alias("cached_hash"))
    return caches.embedding_hits(kept, now)


def related_code(s, d):
    """The three code vectors nearest to each page's, of whatever similarity."""
    return semantic.related(*_sides(s, d), 3).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def similar_code(s, d):
    """For each vector of a snippet, the nearest of the code vectors of at least 0.3, by distance."""
    docs, code = _sides(s, d)
    return semantic.nearest(docs, code, 3, 0.3, "distance").where("rank = 1").select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def snippet_counts(s, d):
    return snippets.counts(table(s, d, "snippet_results").dropDuplicates(["code_id"]), "doc_path")


def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", caches.content_hash(F.col("text")).alias("content_hash"))


def chunk_greedy(s, d):
    return _pages(s, d).select("doc_path", F.posexplode(semantic.greedy_chunks(F.col("content"), 1000)).alias("ord", "chunk")).select("doc_path", "ord", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("chunk_hash"))


def code_chunks(s, d):
    files = table(s, d, "symbols").where("code is not null").dropDuplicates(["code_id"])
    ending = F.regexp_extract("file_path", r"(\.[^./]+)$", 1)
    return files.select("code_id", F.posexplode(semantic.code_chunks(F.col("code"), ending)).alias("ord", "chunk"))


def mean_pool(s, d):
    rows = semantic.mean_pool(table(s, d, "embeddings"), "label")
    return rows.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


def _sides(s, d):
    v = table(s, d, "embeddings").withColumnRenamed("vec_id", "id")
    return v.where("label < 5"), v.where("label >= 5")


def cosine_topk(s, d):
    return semantic.nearest(*_sides(s, d), 5, 0.2).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def l2_search(s, d):
    return semantic.nearest(*_sides(s, d), 5, 0.4, "distance").select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def typed_overfetch_search(s, d):
    docs, code = _sides(s, d)
    return semantic.typed_nearest(docs, code.withColumn("type", F.concat(F.lit("t"), F.col("label").cast("string"))), "t7", 5).select("query_id", "id", "rank")


def orphaned_docs(s, d):
    return semantic.orphans(*_sides(s, d), 0.3)


def missing_docs(s, d):
    docs, code = _sides(s, d)
    return semantic.orphans(code, docs, 0.3)


def vector_latest(s, d):
    rows = caches.latest(table(s, d, "vectors").select("id", "metadata", "ts"), ["id"], ["ts", "metadata"])
    return rows.select("id", "ts", F.get_json_object("metadata", "$.type").alias("type"))


def vector_count(s, d):
    return table(s, d, "vectors").agg(F.count_distinct("id").alias("n"))


def _folder(s: SparkSession, what: str) -> str:
    """A new folder beside the checkpoints, for a table that a query writes."""
    import uuid

    return temporary(s, f"{checkpoint_dir(s).rstrip('/')}/folioscope-{what}-{uuid.uuid4().hex}")


def stream_cache_upsert(s, d):
    """The latest status of each url, merged micro-batch by micro-batch: the table comes as a stream of four files, one at a time."""
    at = _folder(s, "stream")
    rows = table(s, d, "link_status").where("ts is not null").select("url", "status", "ts", "status_id")
    rows.repartition(4, "status_id").write.parquet(f"{at}/source")
    source = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/source")
    kept = KeyedTable(s, f"{at}/table", ["url"], ["ts", "status_id"])
    streams.upsert_stream(source, kept, f"{at}/checkpoint").awaitTermination()
    return kept.read().select("url", "status", "ts")


def stream_reindex(s, d):
    """An index of page hashes kept up to date by a stream of pages, starting from what the embedding cache knows."""
    at = _folder(s, "reindex")
    index = KeyedTable(s, f"{at}/index", ["doc_path"])
    known = table(s, d, "embedding_cache").where("file_type = 'doc' and content_hash is not null").groupBy(F.col("path").alias("doc_path")).agg(F.max("content_hash").alias("content_hash"))
    index.upsert(known.select("doc_path", "content_hash", F.lit(False).alias("renewed")))
    pages = _pages(s, d).select("doc_path", "content")
    pages.repartition(3, "doc_path").write.parquet(f"{at}/source")
    source = s.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/source")
    make = lambda changed: changed.select("doc_path", "content_hash", F.lit(True).alias("renewed"))
    streams.reindex_stream(source, index, make, f"{at}/checkpoint").awaitTermination()
    return index.read()


def _vectors(s, d) -> KeyedTable:
    """The vector store: the latest row of each id, in a table of its own."""
    store = KeyedTable(s, f"{_folder(s, 'vectors')}/table", ["id"], ["ts", "metadata"], 16)
    store.upsert(table(s, d, "vectors").select("id", "ts", "metadata", "embedding"))
    return store


def _stored_ids(s, d, kind: str) -> DataFrame:
    return table(s, d, "vectors").where(F.get_json_object("metadata", "$.type") == kind).select("id")


def vector_get(s, d):
    """The stored vectors of ids that were ever those of a class."""
    return _vectors(s, d).get(_stored_ids(s, d, "class")).select("id", "ts", F.size("embedding").alias("n"))


def vector_delete(s, d):
    """What stays when the vectors of all methods are deleted by id."""
    store = _vectors(s, d)
    store.delete(_stored_ids(s, d, "method"))
    return store.read().select("id", "ts")


def cache_clear(s, d):
    """A cleared cache takes entries again: what it holds after it was filled, cleared and given the broken ones."""
    cache = KeyedTable(s, f"{_folder(s, 'cache')}/table", ["url"], ["ts", "status_id"], 16)
    rows = table(s, d, "link_status").select("url", "status", "ts", "status_id")
    cache.upsert(rows)
    cache.clear()
    cache.upsert(rows.where("status = 'broken'"))
    return cache.read()


def symbol_lookup(s, d):
    return symbols.prefixed(table(s, d, "symbols").dropDuplicates(["code_id"]), "re", "method").select("code_id", "name")


def symbol_counts(s, d):
    return symbols.counts(table(s, d, "symbols").dropDuplicates(["code_id"]))


def path_normalise(s, d):
    rows = _links(s, d).where("url is not null and url not like '%:%' and url <> '' and url not like '#%' and url not like '/%'")
    return rows.select("link_id", paths.join(paths.directory(F.col("doc_path")), links.file_part(F.col("url"))).alias("path")).where("path is not null")


QUERIES = {
    f.__name__: f
    for f in (
        link_classify, ignore_filter, exclude_globs, file_anchor_split, link_check, link_broken, anchor_slug, anchor_variants, anchor_numbering,
        anchor_suggest, fix_anchors, fixes_first, fixes_remaining, fix_loop, snippet_report, snippet_markdown, exit_codes, owner_files, owner_fixable,
        external_status, repository_routes, snippet_rewrite, symbol_extract, embedding_lookup, related_code, similar_code, safe_anchor, doc_link_counts, scan_summary, fail_fast, annotations, case_insensitive_fix, fix_proposals, pr_plan,
        apply_line_fix, json_report, markdown_report, owners_last_match, owner_group_counts, owner_filter, owner_distinct, cache_upsert,
        cache_lookup, cache_join, cache_stats, cache_cleanup, cache_broken_topn, incremental_index, md_headings, md_code_blocks, md_links,
        file_hint, snippet_symbols, code_normalize, snippet_status, snippet_counts, content_hash, chunk_greedy, code_chunks, mean_pool,
        cosine_topk, l2_search, typed_overfetch_search, orphaned_docs, missing_docs, vector_latest, vector_count, stream_cache_upsert, stream_reindex, vector_get, vector_delete, cache_clear,
        path_normalise, symbol_lookup, symbol_counts,
    )
}

_L = "(select distinct on (link_id) * from link_results)"
_PAGES = "(select distinct on (doc_path) * from markdown_docs order by doc_path, added_ts desc)"
_HEADS = f"(select doc_path, h.level as level, h.text as text, h.line as line, i as ord from (select doc_path, unnest(headings) as h, generate_subscripts(headings, 1) - 1 as i from {_PAGES}))"


_V3 = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\(([^)]+)\)', '-\1-', 'g'), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-')"
_V4 = r"trim(replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s.-]', '', 'g'), '\s+', '-', 'g'), '.', ''), '-')"
_VARIANTS = f"select doc_path, ord, text, unnest([{slug_sql('text')}, {_V3}, {_V4}]) as v from {_HEADS}"


_REPOSITORY = r"^https://github\.com/([^/]+)/([^/#]+)(?:/blob/([^/]+)/([^#]+))?"
_DIR = "regexp_extract(doc_path, '^(.*)/[^/]*$', 1)"
_KIND = "case when url like 'http://%' or url like 'https://%' then 'external' when url like 'mailto:%' then 'mailto' when url like '#%' then 'anchor' when url like '/%' then 'absolute' when url is not null then 'relative' end"
_OWNER = r"""case
  when regexp_matches(doc_path, '^(?:.*/)?howto/.*$') then '_no_owner_'
  when regexp_matches(doc_path, '^(?:.*/)?api/[^/]*\.md$') or regexp_matches(doc_path, '^(?:.*/)?api/[^/]*\.md/.*$') then '@team/api'
  when regexp_matches(doc_path, '^(?:.*/)?[^/]*\.mdx$') or regexp_matches(doc_path, '^(?:.*/)?[^/]*\.mdx/.*$') then '@docs/web'
  when regexp_matches(doc_path, '^(?:.*/)?notes$') or regexp_matches(doc_path, '^(?:.*/)?notes/.*$') then '@team/notes'
  when regexp_matches(doc_path, '^docs/.*$') then '@docs/core'
  when regexp_matches(doc_path, '^lonen-stack(/.*)?$') then '@team/stack'
  when regexp_matches(doc_path, '^[^/]*-cli(/.*)?$') then '@docs/everyone,@team/cli'
  else '@docs/everyone' end"""
_UPSERT = "(select distinct on (url) * from (select distinct * from link_status) order by url, ts desc nulls last, status_id desc)"
_VECTORS = "(select distinct on (id) * from vectors where id is not null order by id, ts desc nulls last, metadata desc nulls last)"
_LIVE = f"ts > timestamp '{NOW}' - interval 1440 hours"
_CHECK = f"""
inv as (select distinct array_to_string(p[1:n], '/') as path from (select string_split(path, '/') as p, unnest(generate_series(1, len(string_split(path, '/')))) as n
  from (select doc_path as path from markdown_docs union select file_path from symbols))),
heads as (select *, row_number() over (partition by doc_path, slug order by ord) - 1 as k from (select *, {slug_sql('text')} as slug from {_HEADS})),
var as (select doc_path, ord, v from ({_VARIANTS}) where v <> ''),
narrow as (select doc_path, v as anchor from var union select doc_path, slug || '-' || k from heads where k > 0),
wide as (select * from narrow union select h.doc_path, v || '-' || k from heads h join var using (doc_path, ord) where k > 0 union select doc_path, replace(lower(text), ' ', '-') from heads where text <> ''),
base as (select *, {_KIND} as kind, split_part(url, '#', 1) as f, nullif(case when contains(url, '#') then substr(url, strpos(url, '#') + 1) end, '') as a from {_L} where url is not null),
away as (select *, case when f like '/%' then {path_sql('repo', "ltrim(f, '/')")} else {path_sql(_DIR, 'f')} end as target from base where kind in ('relative', 'absolute')),
found as (select *, case when target in (select path from inv) then target when target || '.md' in (select path from inv) then target || '.md' end as hit from away),
checked as (
  select link_id, case when hit is null or (kind = 'relative' and a is not null and regexp_matches(hit, '\\.mdx?$') and (hit, a) not in (select (doc_path, anchor) from narrow)) then 'broken' else 'ok' end as status from found
  union all select link_id, case when (doc_path, substr(url, 2)) in (select (doc_path, anchor) from wide) then 'ok' else 'broken' end from base where kind = 'anchor')"""

_FULL = f"""{_CHECK},
told as (
  select link_id, doc_path, url, case when hit is null then 'File not found: ' || f else 'Anchor #' || a || ' not found in ' || f end as error_message,
    case when hit is null and kind = 'relative' and not ends_with(f, '.md') then 'Did you mean ' || f || '.md?' end as suggestion from found join checked using (link_id) where checked.status = 'broken'
  union all
  select link_id, doc_path, url, 'Anchor #' || x || ' not found' || case when stale then ' (numbered anchor may be outdated)' else '' end, case when stale then 'Did you mean #' || b || '?' end
  from (select *, substr(url, 2) as x, regexp_extract(substr(url, 2), '^(.+)-([0-9]+)$', 1) as b, (doc_path, regexp_extract(substr(url, 2), '^(.+)-([0-9]+)$', 1)) in (select (doc_path, anchor) from wide) as stale from base where kind = 'anchor') w
  join checked using (link_id) where checked.status = 'broken')"""
_FIX = rf"""{_FULL},
files as (select doc_path as path from markdown_docs union select file_path from symbols),
seen as (select t.*, l.repo, l.line, l.ord, {path_sql('l.repo', "ltrim(split_part(t.url, '#', 1), '/')")} as t1, {path_sql(_DIR.replace('doc_path', 't.doc_path'), "split_part(t.url, '#', 1)")} as t2 from told t join {_L} l using (link_id)),
aimed as (select *, case when starts_with(url, '/') then t1 else t2 end as target from seen),
cased as (select {_DIR.replace('doc_path', 'path')} as dir, lower(regexp_extract(path, '([^/]*)$', 1)) as low, min(path) as cased from files group by 1, 2),
hinted as (select a.*, nullif(regexp_extract(coalesce(suggestion, ''), 'Did you mean #([^?]+)\?', 1), '') as hint, target || '.md' in (select path from files) as has_md, target in (select path from files) as exact, c.cased,
    not starts_with(url, 'http') and not starts_with(url, '#') as inner_, case when contains(url, '#') then split_part(substr(url, strpos(url, '#') + 1), '#', 1) else url end as original
  from aimed a left join cased c on c.dir = {_DIR.replace('doc_path', 'target')} and c.low = lower(regexp_extract(target, '([^/]*)$', 1))),
fixed as (select link_id, doc_path as file_path, line, url as original_url, f.u as suggested_url, f.d as description, f.a as auto_fixable from (select *,
  case when inner_ and not regexp_matches(url, '\.mdx?$') and has_md then {{'u': url || '.md', 'd': 'Add .md extension', 'a': true}}
    when hint is not null and replace(lower(original), '-', '') = replace(lower(hint), '-', '') then {{'u': case when contains(url, '#') then split_part(url, '#', 1) else '' end || '#' || hint, 'd': 'Fix anchor: #' || original || ' → #' || hint, 'a': true}}
    when hint is not null then {{'u': '#' || hint, 'd': 'Anchor not found (suggestion: #' || hint || ') - needs manual review', 'a': false}}
    when inner_ and not exact and cased is not null then {{'u': case when starts_with(cased, {_DIR} || '/') then case when starts_with(substr(cased, length({_DIR}) + 2), '.') then substr(cased, length({_DIR}) + 2) else './' || substr(cased, length({_DIR}) + 2) end when {_DIR} = '' then './' || cased else cased end,
      'd': 'Fix case: ' || regexp_extract(target, '([^/]*)$', 1) || ' → ' || regexp_extract(cased, '([^/]*)$', 1), 'a': true}} end as f from hinted) where f is not null)"""
_OWNER_OF = _OWNER.replace("doc_path", "file_path")
_SORTED = "order by file_path, line, original_url, link_id"
_STRIP = r"regexp_replace(regexp_replace(code, '^\s+', ''), '\s+$', '')"
_OPENER = r"(?:def|class)\s+\w+[^:]*:"
_JSON_LINK = """'{"url":' || to_json(url) || ',"line":' || line || ',"status":' || to_json(status) || ',"status_code":' || coalesce(status_code::varchar, 'null')
  || case when coalesce(error_message, '') <> '' then ',"error":' || to_json(error_message) else '' end || case when coalesce(suggestion, '') <> '' then ',"suggestion":' || to_json(suggestion) else '' end || '}'"""
_SUMS = f"(select count(distinct doc_path) as f, count(*) as t, count(*) filter (status = 'broken') as b, count(*) filter (status = 'ok') as o from {_L})"
_SNIPPETS = "(select distinct on (code_id) r.*, b.line from snippet_results r left join (select distinct on (code_id) code_id, line from code_blocks) b using (code_id))"

_NAMES = markdown.SYMBOL_PATTERNS


def _names_sql() -> str:
    """The names of a snippet, by language, in order of pattern and place."""
    case = "case"
    for languages, patterns in _NAMES:
        found = " || ".join(f"regexp_extract_all(code, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in patterns)
        case += f" when language in ({', '.join(repr(x) for x in languages)}) then {found}"
    return case + " else [] end"


SQL = {
    "link_broken": f"with {_FULL} select link_id, doc_path, url, 'broken' as status, error_message, suggestion from told",
    "case_insensitive_fix": f"select link_id, c.path from (select link_id, lower(case when url like '/%' then {path_sql('repo', "ltrim(split_part(url, '#', 1), '/')")} else {path_sql(_DIR, "split_part(url, '#', 1)")} end) as target from {_L} where url is not null and url not like 'http%' and url not like '#%') join (select lower(path) as target, min(path) as path from (select doc_path as path from markdown_docs union select file_path from symbols) group by 1) c using (target)",
    "fix_proposals": f"with {_FIX} select * from fixed",
    "fixes_first": f"with {_FIX} select owner_key, n::int as n, file_path, line, original_url, suggested_url from (select *, row_number() over (partition by owner_key {_SORTED}) as n from (select *, {_OWNER_OF} as owner_key from fixed where auto_fixable)) where n <= 10",
    "fixes_remaining": f"with {_FIX} select link_id, url from told where url not in (select original_url from fixed where auto_fixable)",
    "pr_plan": f"with {_FIX} select owner_key, 'docs/fix-' || case when owner_key = '_no_owner_' then 'no-owner' else replace(ltrim(first, '@'), '/', '-') end as branch, case when owner_key <> '_no_owner_' then 'fix(docs): Fix ' || count(*) || ' broken links in ' || first || ' owned files' end as title, count(*) as n_fixes, count(distinct file_path) as n_files from (select *, case owner_key when '@docs/everyone,@team/cli' then '@team/cli' else owner_key end as first from (select *, {_OWNER_OF} as owner_key from fixed where auto_fixable)) group by owner_key, first",
    "owner_fixable": f"with {_FIX} select owner_key, count(*) as broken, count(*) filter (auto) as fixable, count(distinct doc_path) as files, count(distinct case when auto then doc_path end) as files_to_fix from (select *, {_OWNER} as owner_key, link_id in (select link_id from fixed where auto_fixable) as auto from told) group by 1",
    "apply_line_fix": f"""with recursive {_FIX},
todo as (select file_path as doc_path, line, original_url as o, suggested_url as s, row_number() over (partition by file_path, line order by original_url, suggested_url) as n from fixed where auto_fixable),
text_rows as (select doc_path, unnest(string_split(content, chr(10))) as r, generate_subscripts(string_split(content, chr(10)), 1) as line from {_PAGES} where doc_path in (select doc_path from todo)),
steps as (select doc_path, line, 0::bigint as n, r, 0 as hits from text_rows
  union all select t.doc_path, t.line, todo.n, case when contains(r, o) then substr(r, 1, strpos(r, o) - 1) || s || substr(r, strpos(r, o) + length(o)) else r end, hits + contains(r, o)::int from steps t join todo on todo.doc_path = t.doc_path and todo.line = t.line and todo.n = t.n + 1),
ends as (select doc_path, line, arg_max(r, n) as r, max(hits) as hits from steps group by 1, 2)
select doc_path, sha256(string_agg(r, chr(10) order by line)) as fixed_hash, (select count(*) from todo where todo.doc_path = ends.doc_path)::int as attempted, sum(hits)::int as succeeded from ends group by 1""",
    "json_report": f"""select 'summary' as part, '' as name, '{{"files_checked":' || f || ',"total_links":' || t || ',"broken_links":' || b || ',"ok_links":' || o || '}}' as text from {_SUMS}
union all select 'owner', owner_key, '{{"owner":' || to_json(owner_key) || ',"broken_count":' || count(*) filter (status = 'broken') || ',"n_files":' || count(distinct doc_path) || '}}' from (select *, {_OWNER} as owner_key from {_L}) group by owner_key
union all select distinct 'owner_file', {_OWNER}, to_json(doc_path)::varchar from {_L}
union all select 'file', doc_path, '{{"path":' || to_json(doc_path) || ',"broken":' || count(*) filter (status = 'broken') || ',"links":[' || string_agg(j, ',' order by ord, j) || ']}}' from (select *, {_JSON_LINK} as j from {_L} where url is not null and status is not null) group by doc_path""",
    "markdown_report": rf"""select 'summary' as part, '' as name, '| Metric | Count |' || chr(10) || '|--------|-------|' || chr(10) || '| Files checked | ' || f || ' |' || chr(10) || '| Total links | ' || t || ' |' || chr(10) || '| OK | ' || o || ' |' || chr(10) || '| Broken | ' || b || ' |' || chr(10) as text from {_SUMS}
union all select 'file', doc_path, '### ' || doc_path || chr(10) || chr(10) || '| Line | URL | Error |' || chr(10) || '|------|-----|-------|' || chr(10) || string_agg(r, chr(10) order by ord, r) from (select *, '| ' || line || ' | `' || replace(url, '|', '\|') || '` | ' || replace(coalesce(error_message, ''), '|', '\|') || ' |' as r from {_L} where status = 'broken' and url is not null) group by doc_path""",
    "snippet_report": f"""select 'summary' as part, '' as name, '{{"total":' || count(*) || ',"valid":' || count(*) filter (status = 'valid') || ',"outdated":' || count(*) filter (status = 'outdated') || ',"not_found":' || count(*) filter (status = 'not_found') || ',"invalid_syntax":' || count(*) filter (status = 'invalid_syntax') || '}}' as text from {_SNIPPETS} where status is not null
union all select 'file', doc_path, '{{"path":' || to_json(doc_path) || ',"snippets":[' || string_agg(j, ',' order by ord, j) || ']}}' from (select *, '{{"line":' || coalesce(line::varchar, 'null') || ',"status":' || to_json(status) || ',"similarity":' || coalesce(printf('%.4f', similarity), 'null') || ',"source":' || coalesce(to_json(source_path)::varchar, 'null') || '}}' as j from {_SNIPPETS} where status is not null) group by doc_path""",
    "snippet_markdown": f"select doc_path, string_agg(r, chr(10) order by line, r) as markdown from (select *, '- line ' || line || ': ' || status || printf(' (%.1f%%)', similarity * 100) as r from {_SNIPPETS} where status is not null and status <> 'valid' and similarity is not null and line is not null) group by 1",
    "exit_codes": f"select 'scan' as command, bool_or(status = 'broken') as failed from {_L} union all select 'validate-snippets', bool_or(status = 'outdated') from snippet_results union all select 'semantic', exists (select 1 from embeddings a where not exists (select 1 from embeddings b where (a.label < 5) <> (b.label < 5) and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3))",
    "owner_files": f"select distinct {_OWNER} as owner_key, doc_path as path from markdown_docs",
    "external_status": """with log as (select *, row_number() over (partition by url order by ts, status_id) as attempt from link_status where url like 'http%' and ts is not null),
ended as (select *, min(case when status_code is not null and status_code not in (429, 502, 503, 504) then attempt end) over (partition by url) as e from log where attempt <= 3),
last as (select distinct on (url) *, attempt as n_attempts from ended where e is null or attempt <= e order by url, attempt desc)
select url, case when status_code < 400 then 'ok' when status_code >= 400 then 'broken' when contains(lower(error), 'timeout') then 'timeout' else 'error' end as status, status_code,
  case when status_code >= 400 then 'HTTP ' || status_code when status_code is null then error end as error_message, n_attempts::int as n_attempts from last""",
    "repository_routes": rf"""select url, case when path <> '' then 'repository_file' when repo <> '' then 'repository' else 'request' end as route, nullif(owner, '') as owner, nullif(repo, '') as repo, nullif(branch, '') as branch, nullif(path, '') as path
from (select url, regexp_extract(url, '{_REPOSITORY}', 1) as owner, regexp_extract(url, '{_REPOSITORY}', 2) as repo, regexp_extract(url, '{_REPOSITORY}', 3) as branch, regexp_extract(url, '{_REPOSITORY}', 4) as path from (select distinct url from link_results where url like 'http%'))""",
    "embedding_lookup": f"select c.path, p.h is null or p.h = c.cached_hash as hit from (select path, max(content_hash) as cached_hash from embedding_cache where path is not null and file_type = 'doc' group by 1) c left join (select doc_path as path, left(sha256(content), 32) as h from {_PAGES}) p using (path)",
    "related_code": "select * from (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id)::int as rank from embeddings a join embeddings b on a.label < 5 and b.label >= 5) where rank <= 3 and similarity >= 0",
    "similar_code": "select query_id, id, similarity from (select a.vec_id as query_id, b.vec_id as id, round(greatest(0, 1 - list_distance(a.embedding::double[], b.embedding::double[]) / 2), 6) as similarity, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank from embeddings a join embeddings b on a.label < 5 and b.label >= 5) where rank = 1 and similarity >= 0.3",
    "md_code_blocks": "select distinct doc_path, ord, coalesce(language, '') as language, sha256(code || chr(10)) as code_hash, line from code_blocks",
    "snippet_rewrite": rf"""with todo as (select doc_path, line as l, suggestion as code from {_SNIPPETS} where status = 'outdated' and suggestion is not null and line is not null),
text_rows as (select doc_path, unnest(string_split(content, chr(10))) as r, generate_subscripts(string_split(content, chr(10)), 1) as line from {_PAGES} where doc_path in (select doc_path from todo) and content is not null),
opened as (select t.*, regexp_extract(r, '^(\s*)(`{{3,}})', 1) as indent, regexp_extract(r, '^(\s*)(`{{3,}})', 2) as ticks from todo t join text_rows x on x.doc_path = t.doc_path and x.line = t.l),
closed as (select o.doc_path, l, code, indent, ticks, min(line) as e from opened o join text_rows x on x.doc_path = o.doc_path and x.line > o.l and ticks <> '' and regexp_matches(r, '^\s*`{{' || length(ticks) || ',}}\s*$') group by all),
parts as (select doc_path, line, 0 as sub, r from text_rows x where not exists (select 1 from closed c where c.doc_path = x.doc_path and x.line > c.l and x.line <= c.e)
  union all select doc_path, l, 1, rtrim(code, chr(10)) || chr(10) || indent || ticks from closed)
select p.doc_path, sha256(string_agg(r, chr(10) order by line, sub)) as fixed_hash, (select count(*) from closed c where c.doc_path = p.doc_path)::int as n_fixed from parts p group by 1""",
    "snippet_symbols": f"select code_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as symbols from (select code_id, {_names_sql()} as l from (select distinct on (code_id) * from code_blocks))",
    "code_chunks": rf"""with files as (select distinct on (code_id) code_id, code, regexp_extract(file_path, '(\.[^./]+)$', 1) as ending from symbols where code is not null),
cut as (select *, string_split_regex(code, '{_OPENER}') as b, regexp_extract_all(code, '{_OPENER}') as o from files),
raw as (select code_id, code, case when ending in ('.py', '.pyx') then regexp_extract_all(code, '(?s)"{{3}}(.*?)"{{3}}', 1) || list_transform(o, lambda x, i: substr(code, greatest(length(array_to_string(b[1:i], '')) + length(array_to_string(o[1:i - 1], '')) - 100, 0) + 1, length(array_to_string(b[1:i], '')) + length(array_to_string(o[1:i - 1], '')) + 500 - greatest(length(array_to_string(b[1:i], '')) + length(array_to_string(o[1:i - 1], '')) - 100, 0)))
  when ending in ('.js', '.ts', '.jsx', '.tsx') then regexp_extract_all(code, '(?s)/\*\*(.*?)\*/', 1) else [] end as r from cut),
kept as (select code_id, code, list_transform(list_filter(r, lambda c: length(c) > 50), lambda c: left(c, 2000)) as k from raw),
done as (select code_id, case when len(k) > 0 then k else [left(code, 5000)] end as k from kept)
select code_id, (generate_subscripts(k, 1) - 1)::int as ord, unnest(k) as chunk from done""",
    "chunk_greedy": f"""with recursive paras as (select doc_path, unnest(string_split(content, chr(10) || chr(10))) as p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) as i from {_PAGES} where content is not null),
walk as (select doc_path, i, 0 as c, length(p) as n from paras where i = 1
  union all select w.doc_path, p.i, case when w.n + length(p.p) > 1000 then w.c + 1 else w.c end, case when w.n + length(p.p) > 1000 then length(p.p) else w.n + length(p.p) end from walk w join paras p on p.doc_path = w.doc_path and p.i = w.i + 1)
select doc_path, c::int as ord, length(string_agg(p, chr(10) || chr(10) order by i))::int as n, sha256(string_agg(p, chr(10) || chr(10) order by i)) as chunk_hash from walk join paras using (doc_path, i) group by doc_path, c""",
    "link_classify": f"select {_KIND} as kind, count(*) as n, count(distinct url) as n_urls from {_L} group by 1",
    "ignore_filter": f"select link_id, pattern from (select link_id, case when contains(url, 'lanternfish') then 'lanternfish' when contains(url, 'badge') then 'badge' when contains(url, '/img/') then '/img/' when contains(url, 'http://') then 'http://' when contains(url, 'https://') then 'https://' end as pattern from {_L}) where pattern is not null",
    "exclude_globs": r"select distinct doc_path from markdown_docs where not (doc_path like '%/notes/%' or regexp_matches(doc_path, '/api/') or contains(doc_path, 'api') or doc_path like 'README%' or regexp_extract(doc_path, '([^/]*)$', 1) like 'README%')",
    "file_anchor_split": f"select link_id, split_part(url, '#', 1) as file, case when contains(url, '#') then substr(url, strpos(url, '#') + 1) end as anchor from {_L} where url is not null",
    "link_check": f"with {_CHECK} select link_id, status from checked",
    "anchor_slug": f"select distinct text, {slug_sql('text')} as slug from {_HEADS}",
    "anchor_variants": f"select distinct text, v as variant from ({_VARIANTS}) where v <> ''",
    "anchor_numbering": f"with {_CHECK} select doc_path, anchor from narrow",
    "safe_anchor": f"select distinct l.link_id, {slug_sql('h.text')} as slug from {_L} l join {_HEADS} h using (doc_path) where url like '#%' and replace(lower(substr(url, 2)), '-', '') = replace(lower({slug_sql('h.text')}), '-', '')",
    "doc_link_counts": f"select doc_path, count(*) filter (status = 'broken') as broken, count(*) filter (status = 'ok') as ok, count(*) as total from {_L} group by 1",
    "scan_summary": f"select count(distinct doc_path) as files_checked, count(*) as total, count(*) filter (status = 'broken') as broken, count(*) filter (status = 'ok') as ok from {_L}",
    "fail_fast": f"select link_id, doc_path, status from {_L} where string_split(doc_path, '/') <= (select min(string_split(doc_path, '/')) from link_results where status = 'broken')",
    "annotations": f"select link_id, '::error file=' || doc_path || ',line=' || line || '::Broken link: ' || url || coalesce(' - ' || error_message, '') as annotation from {_L} where status = 'broken'",
    "owners_last_match": f"select distinct doc_path, {_OWNER} as owner_key from markdown_docs",
    "owner_group_counts": f"select {_OWNER} as owner_key, count(*) filter (status = 'broken') as broken, count(distinct case when status = 'broken' then doc_path end) as files_affected, count(distinct doc_path) as files from {_L} group by 1",
    "owner_filter": f"select owner_key, broken from (select {_OWNER} as owner_key, count(*) filter (status = 'broken') as broken from {_L} group by 1) where (contains(owner_key, 'team') or contains(owner_key, 'core')) and not contains(owner_key, 'notes')",
    "owner_distinct": "select unnest(['@docs/everyone', '@team/cli', '@team/stack', '@docs/core', '@team/notes', '@docs/web', '@team/api', '@nobody']) as owner",
    "cache_upsert": f"select url, status, status_code, ts, status_id from {_UPSERT}",
    "cache_lookup": f"select url, status, status_code from {_UPSERT} where {_LIVE} and url in (select url from link_results where url is not null)",
    "cache_join": f"select c.status as cached_status, count(*) as n from {_L} l left join (select url, status from {_UPSERT} where {_LIVE}) c using (url) group by 1",
    "cache_stats": f"select count(*) as total, count(*) filter ({_LIVE}) as valid, count(*) - count(*) filter ({_LIVE}) as expired, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'broken') as broken, round(coalesce(avg(response_time) * 1000, 0), 6) as avg_response_ms from {_UPSERT}",
    "cache_cleanup": f"select case when ts < timestamp '{NOW}' - interval 1440 hours then 'deleted' else 'kept' end as what, count(*) as n from link_status group by 1",
    "cache_broken_topn": f"select status_id, url, ts from link_status where status = 'broken' and ts > timestamp '{NOW}' - interval 8760 hours order by ts desc, url limit 50",
    "incremental_index": f"select doc_path as file_path, (doc_path, left(sha256(content), 32)) in (select (path, content_hash) from embedding_cache where content_hash is not null) as unchanged from {_PAGES}",
    "md_headings": f"select doc_path, level, text, line from {_HEADS}",
    "file_hint": r"select distinct on (code_id) code_id, coalesce(nullif(regexp_extract(code, '(?://|#)[\s]*(?:File:\s*)?(\S+\.[a-zA-Z]+)', 1), ''), nullif(regexp_extract(code, '/\*\s*(?:File:\s*)?(\S+\.[a-zA-Z]+)\s*\*/', 1), '')) as file_hint from code_blocks",
    "snippet_counts": "select doc_path, count(*) as total, count(*) filter (status = 'valid') as valid, count(*) filter (status = 'outdated') as outdated, count(*) filter (status = 'not_found') as not_found, count(*) filter (status = 'invalid_syntax') as invalid_syntax from (select distinct on (code_id) * from snippet_results) group by 1",
    "code_normalize": r"select distinct on (code_id) code_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(code, '^\s+', ''), '\s+$', ''), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: regexp_matches(x, '\S') and not regexp_matches(x, '^\s*(//|#|\*)')), chr(10))) as normal_hash from code_blocks",
    "content_hash": "select doc_id, left(sha256(text), 32) as content_hash from documents",
    "mean_pool": "select label, pos::int as pos, round(avg(x::double), 6) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2",
    "cosine_topk": "select * from (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id)::int as rank from embeddings a join embeddings b on a.label < 5 and b.label >= 5) where rank <= 5 and similarity >= 0.2",
    "l2_search": "select * from (select a.vec_id as query_id, b.vec_id as id, round(greatest(0, 1 - list_distance(a.embedding::double[], b.embedding::double[]) / 2), 6) as similarity, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id)::int as rank from embeddings a join embeddings b on a.label < 5 and b.label >= 5) where rank <= 5 and similarity >= 0.4",
    "typed_overfetch_search": "select query_id, id, row_number() over (partition by query_id order by r)::int as rank from (select a.vec_id as query_id, b.vec_id as id, b.label, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as r from embeddings a join embeddings b on a.label < 5 and b.label >= 5) where r <= 10 and label = 7 qualify rank <= 5",
    "orphaned_docs": "select vec_id as id from embeddings a where label < 5 and not exists (select 1 from embeddings b where b.label >= 5 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3)",
    "missing_docs": "select vec_id as id from embeddings a where label >= 5 and not exists (select 1 from embeddings b where b.label < 5 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3)",
    "vector_latest": "select distinct on (id) id, ts, metadata::json ->> '$.type' as type from vectors order by id, ts desc, metadata desc nulls last",
    "symbol_lookup": "select distinct code_id, name from symbols where starts_with(name, 're') and type = 'method'",
    "symbol_counts": "select language, type, count(*) as n_symbols, count(distinct file_path) as n_files from (select distinct on (code_id) * from symbols) group by 1, 2",
    "vector_count": "select count(distinct id) as n from vectors",
    "stream_cache_upsert": "select url, status, ts from (select distinct on (url) * from link_status where ts is not null and url is not null order by url, ts desc, status_id desc)",
    "stream_reindex": f"select coalesce(p.doc_path, c.path) as doc_path, coalesce(p.h, c.content_hash) as content_hash, coalesce(p.h is distinct from c.content_hash and p.h is not null, false) as renewed from (select doc_path, left(sha256(content), 32) as h from {_PAGES}) p full join (select path, max(content_hash) as content_hash from embedding_cache where file_type = 'doc' and content_hash is not null group by 1) c on p.doc_path = c.path",
    "vector_get": f"select id, ts, len(embedding)::int as n from {_VECTORS} where id in (select id from vectors where metadata::json ->> '$.type' = 'class')",
    "vector_delete": f"select id, ts from {_VECTORS} where id not in (select id from vectors where metadata::json ->> '$.type' = 'method')",
    "cache_clear": "select distinct on (url) url, status, ts, status_id from link_status where status = 'broken' and url is not null order by url, ts desc nulls last, status_id desc",
    "path_normalise": f"select link_id, {path_sql(_DIR, 'f')} as path from (select *, split_part(url, '#', 1) as f from {_L} where url is not null and not contains(url, ':') and url <> '' and url not like '#%' and url not like '/%')",
}
