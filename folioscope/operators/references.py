"""References to records that do not exist: orphan foreign keys per row, and their counts per table and period.

``orphans`` is the general operator: a distributed left anti-join of the distinct non-null foreign keys against the
parent keys (``missing_keys``), joined back to the rows; ``orphan_counts`` counts them per table and period.
``link_orphans`` does the same for links into a documentation tree, where the key is a resolved path plus an anchor and a
parent exists only for a while.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anchors, paths
from ..session import hot_keys, once

#: Into how many salted copies a foreign key is divided, so that no single key fills a task.
SALTS = 16


def missing_keys(keyed: DataFrame, names: list[str], have: DataFrame) -> DataFrame:
    """The distinct keys of ``keyed`` that ``have`` (the same columns, distinct, non-null) lacks: a left anti-join."""
    return keyed.select(*names).distinct().join(have, names, "left_anti")


def orphans(rows: DataFrame, keys: list[str], parents: DataFrame, parent_keys: list[str], salts: int = SALTS) -> DataFrame:
    """The rows of ``rows`` whose key, none of its parts null, is in no row of ``parents``; all columns and duplicates stay.

    Nulls: a row with a null key part refers to nothing and is no orphan; null parent keys are ignored. An empty parent
    table makes every reference an orphan; an empty ``rows`` gives no rows. Column names may clash: parents are
    projected to internal names. A hot key is salted on the way back, so it is spread over ``salts`` tasks.
    """
    taken = {c.lower() for c in rows.columns}
    mark = next(m for m in ("__", *(f"__{i}_" for i in range(len(taken) + 1))) if not any(c.startswith(m) for c in taken))
    names, salt_name = [f"{mark}k{i}" for i in range(len(keys))], f"{mark}salt"
    own = [F.col(f"`{c}`") for c in rows.columns]
    salt = F.pmod(F.xxhash64(*([F.col(f"`{c}`") for c, t in rows.dtypes if t in _HASHABLE] or [F.lit(0)])), F.lit(salts)).cast("int")
    keyed = rows.select(*own, *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], salt.alias(salt_name))
    known = keyed.where(" and ".join(f"{n} is not null" for n in names))
    have = parents.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(parent_keys, names)]).dropna().distinct()
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt_name)
    missing = missing_keys(known, names, have).select(*names, copies)
    return known.join(missing, [*names, salt_name], "left_semi").select(*own)


_HASHABLE = {"string", "int", "bigint", "double", "float", "boolean", "timestamp", "timestamp_ntz", "date", "smallint"}


def orphan_counts(rows: DataFrame, lost: DataFrame, period: Column, table: str, by: list[str] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """Per table, ``by`` columns and period: number of rows and of orphans among them, and of orphans that ``more`` conditions hold for.

    Rows meet their orphans through a union, not a join. ``period`` is an expression over columns that both sides have.
    """
    more = more or {}
    shape = lambda df, o: df.select(*by, period.alias("period"), F.lit(o).alias("o"), *[(c if o else F.lit(False)).alias(n) for n, c in more.items()])
    return (
        shape(rows, 0).unionByName(shape(lost, 1))
        .groupBy(F.lit(table).alias("table_name"), *by, "period")
        .agg(F.count_if(F.col("o") == 0).alias("n_rows"), F.sum("o").alias("n_orphans"), *[F.count_if(n).alias(n) for n in more])
    )


def link_keys(links: DataFrame, distinct: bool = True) -> DataFrame:
    """Links in scope with the page path and anchor they point at, one row per ``link_id`` (all rows if not ``distinct``).

    In scope: a non-empty url without a scheme whose part before the first ``#`` is empty, or ends in ``.md`` or
    ``.mdx``, or has no dot in its last segment. Null and empty urls are out of scope. Rows sent twice count once.
    ``anchor`` is null where none has to exist.
    """
    url = F.col("url")
    file = F.substring_index(url, "#", 1)
    anchor = F.when(F.instr(url, "#") > 0, F.expr("substring(url, instr(url, '#') + 1)"))
    scope = (url != "") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    page = (F.col("__file") == "") | F.col("__file").rlike(r"(?s)\.mdx?\z") | ~F.col("__file").rlike(r"(?s)\.[^/]*\z")
    target = (
        F.when(F.col("__file") == "", F.col("doc_path"))
        .when(F.col("__file").startswith("/"), paths.join(F.col("repo"), F.col("__file")))
        .otherwise(paths.join(paths.directory(F.col("doc_path")), F.col("__file")))
    )
    keys = (
        links.where(scope)
        .select("link_id", "repo", "doc_path", "status", "checked_ts", file.alias("__file"), F.nullif(anchor, F.lit("")).alias("anchor"))
        .where(page)
        .select("link_id", "repo", "status", "checked_ts", "anchor", target.alias("target"))
    )
    return once(keys, ["link_id"]) if distinct else keys


def page_keys(pages: DataFrame) -> DataFrame:
    """Parent keys: each page under its own path (rank 0) and, without ``.md``, as the fallback (rank 1), with its life span.

    ``slugs`` are the slugs of its headings in order; a null list of headings, or a null text in it, has none.
    """
    heads = F.coalesce(F.transform(F.filter("headings", lambda h: h["text"].isNotNull()), lambda h: anchors.slug(h["text"])), F.array().cast("array<string>"))
    own = pages.where("doc_path is not null and added_ts is not null").select("doc_path", "added_ts", "deleted_ts", heads.alias("slugs"))
    names = F.array(
        F.struct(F.col("doc_path").alias("key"), F.lit(0).alias("rank")),
        F.struct(F.when(F.col("doc_path").endswith(".md"), F.expr("left(doc_path, length(doc_path) - 3)")).alias("key"), F.lit(1).alias("rank")),
    )
    return own.select("added_ts", "deleted_ts", "slugs", F.inline(names)).where("key is not null").dropDuplicates()


def link_orphans(links: DataFrame, pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """Links in scope whose page or heading did not exist at ``checked_ts``: link_id, repo, status, checked_ts, target, anchor, reason.

    The foreign keys are the distinct (target, anchor, time). Which of them existed is settled against the pages that
    lived by then: the page of the exact path is preferred to that of the path plus ``.md``, and the anchor has to be in a
    row of the preferred page. The others are what a left anti-join leaves, and are joined back to their rows. ``reason``
    is ``page`` or ``anchor``. A link without ``checked_ts`` meets no page.
    """
    hot = hot_keys(link_keys(links, distinct=False), "target")
    links = link_keys(links)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("link_id"), F.lit(salts))).otherwise(0).cast("int")
    keyed = links.join(hot, "target", "left").withColumn("salt", salt).drop("hot")
    # As texts without nulls, so that a key without an anchor or a time can be compared.
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = ["target", "salt", "anchor", "at"]
    keyed = keyed.select(*[c for c in keyed.columns if c not in ("target", "anchor")], text("target").alias("target"), text("anchor").alias("anchor"), text("checked_ts").alias("at"))
    wanted = keyed.select(*key, "checked_ts").distinct()
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    parents = page_keys(pages).withColumnRenamed("key", "target").join(hot, "target", "left").withColumn("salt", copies).drop("hot")
    alive = (F.col("added_ts") <= F.col("checked_ts")) & (F.col("deleted_ts").isNull() | (F.col("deleted_ts") > F.col("checked_ts")))
    hit = (F.col("anchor") == "") | anchors.has_anchor(F.col("slugs"), F.col("anchor"))
    state = (
        wanted.join(parents, ["target", "salt"])
        .where(alive)
        .select(*key, "rank", hit.alias("hit"))
        .groupBy(*key)
        .agg(F.min("rank").alias("rank"), F.bool_or(F.when(F.col("rank") == 0, F.col("hit"))).alias("h0"), F.bool_or(F.when(F.col("rank") == 1, F.col("hit"))).alias("h1"))
        .select(*key, F.when(F.col("rank") == 0, F.col("h0")).otherwise(F.col("h1")).alias("hit"))
    )
    lost = missing_keys(wanted, key, state.where("hit").select(*key))
    reasons = lost.join(state.where("not hit").select(*key, F.lit("anchor").alias("reason")), key, "left").withColumn("reason", F.coalesce("reason", F.lit("page")))
    back = keyed.join(reasons, key)
    return back.select("link_id", "repo", "status", "checked_ts", F.nullif("target", F.lit("")).alias("target"), F.nullif("anchor", F.lit("")).alias("anchor"), "reason")


def link_orphan_report(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Per repo and month of ``checked_ts``: links in scope, orphans by reason, and what ``status`` had claimed of the orphans."""
    status = F.coalesce("status", F.lit("none"))
    more = {
        "n_page": F.col("reason") == "page", "n_anchor": F.col("reason") == "anchor", "n_claimed_fine": status.isin("ok", "cached", "skipped"),
        "n_claimed_broken": status == "broken", "n_unclaimed": status == "none",
    }
    out = orphan_counts(link_keys(links), link_orphans(links, pages), F.date_format("checked_ts", "yyyy-MM"), "link_results", ["repo"], more)
    return out.select("repo", F.col("period").alias("month"), F.col("n_rows").alias("n_links"), "n_orphans", *more)
