"""Streaming forms of the cached tables: continuous upserts, expiry by watermark, re-indexing of what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import caches
from ..sources.store import KeyedTable


def latest_by_key(stream: DataFrame, key: str, time: str = "ts", keep: tuple[str, ...] = ("status",), lateness: str | None = None) -> DataFrame:
    """A streaming aggregate: for each key the row with the latest time (ties: the larger values), for update or complete mode.

    With ``lateness``, keys are dropped from the state once the watermark has passed their window of that length.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    by = [F.col(key)]
    if lateness:
        rows = rows.withWatermark(time, lateness)
        by.append(F.window(time, lateness).alias("window"))
    best = rows.groupBy(*by).agg(F.max(F.struct(time, *keep)).alias("r"))
    return best.select(key, "r.*")


def first_within(stream: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """The first row of each key within a time to live; repeats inside it are dropped, state expires with the watermark."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def _each(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge every micro-batch into ``table``: by its order the latest row of each key stays, however late it comes.

    A micro-batch that is sent again after a failure is merged once.
    """
    return _each(stream, lambda batch, n: table.upsert(batch, n) and None, checkpoint, trigger)


def reindex_stream(files: DataFrame, index: KeyedTable, make: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``index`` up to date with a stream of files (key, content and further columns).

    Of each micro-batch only files whose content hash the index doesn't have are given to ``make``, which returns rows of
    the index (key, content_hash and what is derived); files that are as they were cost a comparison of hashes. Of several
    versions of one file in a micro-batch the largest by the index's order counts; null contents are left out.
    """
    key = index.keys[0]

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.where(F.col("content").isNotNull() & F.col(key).isNotNull())
        rows = caches.latest(rows, [key], [*index.order, "content"]).withColumn("content_hash", caches.content_hash(F.col("content")))
        changed = rows
        if index.exists():
            known = index.get(rows).select(key, "content_hash")
            changed = rows.join(known, [key, "content_hash"], "left_anti")
        index.upsert(make(changed), n)

    return _each(files, step, checkpoint, trigger)
