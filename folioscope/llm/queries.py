"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small, table
from . import bpe, chunks, mixing, nearest, prose, spans, url_groups, validity

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records with at least 120 characters in common."""
    return spans.pairs(spans.records(table(spark, d, "code_blocks"), table(spark, d, "symbols")))


def p1_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record is shared elsewhere."""
    return spans.coverage(spans.records(table(spark, d, "code_blocks"), table(spark, d, "symbols")))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal text and how many other classes each shares a stretch with, without writing out pairs."""
    return spans.linked(spans.records(table(spark, d, "code_blocks"), table(spark, d, "symbols")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that aren't a complete, valid file of their language."""
    return validity.checked(table(spark, d, "code_blocks")).where("not valid").select("code_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per repo and language."""
    return validity.rates(table(spark, d, "code_blocks"), table(spark, d, "snippet_results"))


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of the invalid blocks, the first of each being its cause."""
    return validity.causes(table(spark, d, "code_blocks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that came out in pieces."""
    found = chunks.split_corpus(table(spark, d, "markdown_docs"), table(spark, d, "embedding_cache"))
    return found.where("piece_no = 1").select("item_table", "item_key", "chunk_no").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_corpus(table(spark, d, "markdown_docs"), table(spark, d, "embedding_cache"))


def p3_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized item put together again from its pieces, and whether they keep to the limit and the overlap."""
    pieces = p3_pieces(spark, d)
    page = F.col("item_table") == "markdown_docs"
    limit, overlap = F.when(page, 8000).otherwise(1000), F.when(page, 200).otherwise(100)
    fits = (F.length("piece") <= limit) & (F.col("n_repeated") <= overlap) & ((F.col("piece_no") == 0) | (F.col("n_repeated") >= overlap * 3 / 4))
    item = ["item_table", "item_key", "chunk_no", "item_hash"]
    own = F.expr("substring(piece, n_repeated + 1)")
    whole = pieces.groupBy(*item).agg(F.bool_and(fits).alias("fits"), F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("l"))
    return whole.select("item_table", "item_key", "chunk_no", "fits", F.sha2(F.array_join(F.transform("l", lambda x: x["own"]), ""), 256).alias("text_hash"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which one is among the 5 most similar of the other, with a cosine of 0.85 or more."""
    return nearest.pairs(nearest.neighbours(nearest.collection(table(spark, d, "vectors"), table(spark, d, "embedding_cache"))), 0.85)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar others of every usable vector."""
    return nearest.neighbours(nearest.collection(table(spark, d, "vectors"), table(spark, d, "embedding_cache")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return url_groups.members(table(spark, d, "link_status"))


def p6_resources(spark: SparkSession, d: str) -> DataFrame:
    return url_groups.collapsed(table(spark, d, "link_status"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the texts that the ids of each document stand for."""
    return bpe.decode(p7_ids(spark, d)).select("doc_id", F.sha2("text", 256).alias("text_hash"))


def _mix(spark: SparkSession, d: str):
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").join(small(targets.select("source").distinct()), "source", "left_semi")
    counted = mixing.counted_documents(docs, ["source"], bpe.token_counts)
    leaves, total = mixing.plan(counted, targets, ["source"])
    return mixing.mix(counted, leaves, ["source"]), leaves, total


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with the number of times each is used."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares per source."""
    mixed, leaves, total = _mix(spark, d)
    return mixing.shares(mixed, leaves, total, ["source"])


#: A tree over the sources of the test data: domains, and the weights of languages within each source.
DOMAINS = {
    "api_ref": "reference", "spec": "reference", "changelog": "reference", "guide": "learning", "tutorial": "learning", "handbook": "learning",
    "readme": "learning", "forum": "talk", "issue": "talk", "crawl": "web",
}
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.12, "fr": 0.1, "es": 0.1, "ja": 0.05, "und": 0.03}
TREE = ["domain", "language", "source"]


def p8_tree(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mix by domain, language and source: what a leaf can't give its siblings give first, then the rest of its domain."""
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    languages = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(w).alias("weight")) for k, w in LANGUAGE_WEIGHTS.items()])
    domain = F.try_element_at(pairs(DOMAINS), F.col("source")).alias("domain")
    targets = table(spark, d, "mix_targets").distinct().select("source", domain, "target_share", "max_repeats", F.inline(languages))
    targets = targets.withColumn("target_share", F.col("target_share") * F.col("weight"))
    lower = F.lower("lang")
    language = F.when(lower.isin(*LANGUAGE_WEIGHTS), lower).otherwise("und").alias("language")
    docs = table(spark, d, "documents").select("doc_id", "text", "source", domain, language).where("domain is not null")
    counted = mixing.counted_documents(docs, TREE, bpe.token_counts)
    leaves, total = mixing.plan(counted, targets, TREE)
    return mixing.shares(mixing.mix(counted, leaves, TREE), leaves, total, TREE)


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Share of characters in abnormal lines, and mean bits under the two models, of every document."""
    return prose.spam_scores(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents mostly of keywords, links, menus, tags or codes."""
    return prose.spam(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_shared": p1_shared,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_errors": p2_errors,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_round_trip": p3_round_trip,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p6_found": p6_found,
    "p6_resources": p6_resources,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_tree": p8_tree,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}

_CANON = r"""
canon as (
  select url,
    regexp_replace(lower(split_part(url, '?', 1)), '[^\p{L}\p{N}]', '', 'g') as head,
    case when contains(url, '?') then list_sort(list_filter(list_transform(
      regexp_split_to_array(substr(url, strpos(url, '?') + 1), '[&;]'),
      lambda f: regexp_replace(lower(f), '[^\p{L}\p{N}]', '', 'g')), lambda f: f <> '')) else [] end as fields
  from (select distinct url from link_status where url is not null)
), grouped as (
  select l.status_id, l.url, min(l.status_id) over (partition by c.head, c.fields) as keep_id
  from (select distinct status_id, url from link_status) l join canon c on l.url = c.url
)"""

_GRAMS = """
recs as (select distinct code_id, code from (select code_id, code from code_blocks union all select code_id, code from symbols) where code_id is not null and code is not null),
grams as (select code_id, p, md5(substr(code, p, 120)) as g from (select code_id, code, unnest(generate_series(1, length(code) - 119)) as p from recs where length(code) >= 120))"""
_USABLE = """
latest as (select distinct on (id) id as key, embedding from vectors where id is not null order by id, ts desc nulls last, embedding desc nulls last),
every_row as (select key, embedding from latest union all select distinct on (path) path, embedding from embedding_cache where path is not null order by path, embedding desc nulls last),
usable as (select key, embedding::double[] as e from every_row where len(embedding) = 128 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

SQL: dict[str, str] = {
    "p1_found": f"with {_GRAMS} select distinct a.code_id as code_id_a, b.code_id as code_id_b from (select distinct code_id, g from grams) a join (select distinct code_id, g from grams) b on a.g = b.g and a.code_id < b.code_id",
    "p1_shared": f"""with {_GRAMS},
hot as (select g from grams group by g having count(distinct code_id) > 1),
places as (select distinct code_id, p from grams where g in (select g from hot)),
marked as (select code_id, p, lag(p) over (partition by code_id order by p) as before from places),
per_id as (select code_id, sum(least(120, coalesce(p - before, 120))) as shared, count(*) filter (before is null or p > before + 120) as n from marked group by 1)
select r.code_id, max(length(code))::int as n_chars, coalesce(max(shared), 0)::bigint as shared_chars, coalesce(max(n), 0)::bigint as n_spans from recs r left join per_id using (code_id) group by 1""",
    "p1_classes": f"""with {_GRAMS},
named as (select code_id, code, min(code_id) over (partition by code) as class_id from recs where length(code) >= 120),
links as (select a.class_id, count(distinct b.class_id) as n from (select distinct class_id, g from grams join named using (code_id)) a join (select distinct class_id, g from grams join named using (code_id)) b on a.g = b.g and a.class_id <> b.class_id group by 1)
select code_id, n.class_id, count(*) over (partition by n.class_id) as n_copies, coalesce(l.n, 0)::bigint as n_links from named n left join links l using (class_id)""",
    "p3_round_trip": """
select distinct 'markdown_docs' as item_table, doc_path as item_key, 0::int as chunk_no, true as fits, sha256(content) as text_hash from markdown_docs where length(content) > 8000
union select 'embedding_cache', path, (i - 1)::int, true, sha256(chunk) from (select path, unnest(chunks) as chunk, generate_subscripts(chunks, 1) as i from embedding_cache) where length(chunk) > 1000""",
    "p4_found": f"""with {_USABLE},
near as (select a.key as x, b.key as y, list_cosine_similarity(a.e, b.e) as c, row_number() over (partition by a.key order by list_cosine_similarity(a.e, b.e) desc, b.key) as n from usable a join usable b on a.key <> b.key)
select distinct least(x, y) as key_a, greatest(x, y) as key_b from near where n <= 5 and c >= 0.85""",
    "p7_round_trip": "select doc_id, sha256(coalesce(text, '')) as text_hash from documents",
    "p3_found": """
select 'markdown_docs' as item_table, doc_path as item_key, 0::int as chunk_no from markdown_docs where length(content) > 8000
union
select 'embedding_cache', path, (i - 1)::int from (select path, unnest(chunks) as chunk, generate_subscripts(chunks, 1) as i from embedding_cache)
where length(chunk) > 1000""",
    "p6_found": f"with {_CANON} select keep_id, status_id from grouped where status_id <> keep_id",
    "p6_resources": f"""with {_CANON}
select keep_id, arg_min(url, status_id) as url, count(*)::bigint as n_rows, count(distinct url)::bigint as n_urls from grouped group by keep_id
union all select distinct status_id, null, 1, 0 from link_status where url is null""",
}
