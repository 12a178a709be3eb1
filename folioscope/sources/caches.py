"""Keyed tables with a time stamp: lookups with a time to live, upserts, deletions, statistics.

These are expressions over frames; ``store`` keeps such a table in a folder. "Now" is always a parameter, so results are
reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _span(hours: float) -> Column:
    """An interval of so many hours; fractions count, to the microsecond."""
    return F.make_dt_interval(secs=F.lit(round(hours * 3600, 6)).cast("decimal(18,6)"))


def lookup(cache: DataFrame, keys: DataFrame, now: Column, ttl_hours: float = 24, key: str = "url") -> DataFrame:
    """The live rows of ``cache`` for the distinct non-null ``keys``; a row exactly ``ttl_hours`` old is no longer live."""
    live = cache.where(F.col("ts") > now - _span(ttl_hours))
    return live.join(keys.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first, later columns break ties), by hash aggregation and not by a sort."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)) if rest else None
    got = rows.groupBy(*keys).agg(picked.alias("__r"))
    return got.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those of the same keys; within a batch the largest ``ord`` wins.

    ``batch`` has the columns of ``table`` and may have ``ord``.
    """
    order = "ord" if "ord" in batch.columns else None
    new = batch if order else batch.withColumn("ord", F.lit(0))
    both = table.select("*", F.lit(0).alias("__new"), F.lit(0).cast("long").alias("ord")).unionByName(new.withColumn("ord", F.col("ord").cast("long")).withColumn("__new", F.lit(1)))
    return latest(both, keys, ["__new", "ord"]).drop("__new", "ord")


def expired(cache: DataFrame, now: Column, ttl_hours: float = 24) -> tuple[DataFrame, DataFrame]:
    """What stays and what a clean-up deletes; a row exactly ``ttl_hours`` old stays (though it is no longer live)."""
    old = F.col("ts") < now - _span(ttl_hours)
    return cache.where(~old | F.col("ts").isNull()), cache.where(old)


def statistics(cache: DataFrame, now: Column, ttl_hours: float = 24) -> DataFrame:
    """One row: total, valid, expired, ok, broken and the mean response time in milliseconds (0 without any)."""
    live = F.col("ts") > now - _span(ttl_hours)
    return cache.agg(
        F.count("*").alias("total"), F.count_if(live).alias("valid"), (F.count("*") - F.count_if(live)).alias("expired"),
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "broken").alias("broken"),
        F.coalesce(F.avg("response_time") * 1000, F.lit(0.0)).alias("avg_response_ms"),
    )


def newest_broken(cache: DataFrame, now: Column, ttl_hours: float = 24, limit: int = 100) -> DataFrame:
    """The newest live broken entries, ``limit`` of them at most (the limit is the feature)."""
    live = cache.where((F.col("status") == "broken") & (F.col("ts") > now - _span(ttl_hours)))
    return live.orderBy(F.desc("ts"), "url").limit(limit)


def unchanged(files: DataFrame, index: DataFrame, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Files (key, content_hash) that an index has with the same hash, and those that have to be indexed anew."""
    same = [key, "content_hash"]
    known = index.select(*same).distinct()
    return files.join(known, same, "left_semi"), files.join(known, same, "left_anti")


def embedding_hits(cache: DataFrame, files: DataFrame) -> DataFrame:
    """(path, hit) of cached paths: their file (path, content_hash) has the cached hash, or isn't there at all; otherwise stale.

    ``cache``: path, cached_hash. Paths that aren't cached have no row: they are misses.
    """
    both = cache.join(files, "path", "left")
    return both.select("path", (F.col("content_hash").isNull() | F.coalesce(F.col("content_hash") == F.col("cached_hash"), F.lit(False))).alias("hit"))


def content_hash(content: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of a text."""
    return F.left(F.sha2(content, 256), F.lit(32))


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of ``path:name:line``."""
    return F.left(F.sha2(F.concat_ws(":", path, name, line.cast("string")), 256), F.lit(16))
