"""Splitting oversized items at natural boundaries, as one bounded-quantifier regular expression.

The expression consumes at most ``limit - overlap`` characters per match. Its alternatives are ordered by the strength of
the boundary they end at (before a heading, after a blank line, line end, sentence end, white space); the last one takes
any characters, so nothing is ever lost. Each piece is then led by the end of the one before: a lookback of ``overlap``
characters, shortened to begin at a boundary where its first quarter has one. All of it is native array and string SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end a sentence, with closing marks after them.
SENTENCE_END = "[.!?\\x{3002}\\x{ff01}\\x{ff1f}\\x{964}\\x{61f}]"
CLOSERS = "[\"')\\]\\x{201d}\\x{2019}\\x{bb}]"


def core_pattern(body: int) -> str:
    """Matches of at most ``body`` characters that together are the whole text.

    They are cut at the strongest boundary in their second half; if there is none, at the strongest in their first half; by
    character only if there is none at all.
    """
    low = max(1, body // 2)
    head = "(?=[ ]{0,3}#{1,6}[ \\t])"

    def bounded(least: int, most: int) -> list[str]:
        any_ = f"[\\s\\S]{{{least},{most}}}"
        return [
            f"{any_}(?<=\\n){head}",
            f"{any_}(?<=\\n[ \\t\\r]{{0,8}}\\n)(?![ \\t\\r]*\\n)",
            f"{any_}(?<=\\n)",
            f"{any_}(?<={SENTENCE_END}{CLOSERS}{{0,3}}\\s)",
            f"{any_}(?<=[\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}])",
            f"{any_}(?<=\\s)(?=\\S)",
            f"{any_}(?<=\\s)",
        ]

    whole = [f"[\\s\\S]{{1,{body}}}\\z"]
    by_character = [f"[\\s\\S]{{1,{body - 1}}}[^\\r](?!\\p{{M}})", f"[\\s\\S]{{1,{body}}}"]
    return "|".join([*whole, *bounded(low, body), *(bounded(1, low - 1) if low > 1 else []), *by_character])


def lookback(before: Column, overlap: int) -> Column:
    """The last ``overlap`` characters of ``before``, or fewer (three quarters at least) so as to begin after a line end, sentence end or space."""
    tail = F.substring(before, -overlap, overlap)
    lead = max(0, overlap // 4 - 2)
    cuts = [f"(?s)^.{{0,{lead}}}?\\n(.*)\\z", f"(?s)^.{{0,{lead}}}?{SENTENCE_END}\\s(.*)\\z", f"(?s)^.{{0,{lead}}}?\\s(.*)\\z"]
    begun = [F.nullif(F.regexp_extract(tail, c, 1), F.lit("")) for c in cuts]
    return F.when(F.length(before) <= overlap, before).otherwise(F.coalesce(*begun, tail))


def split_items(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of the oversized items of (item_table, item_key, chunk_no, text): one row per piece.

    Columns: item_table, item_key, chunk_no, item_chars, piece_no (from 0), start, n_repeated, piece. Items within the
    limit, empty ones and null ones give no rows. Items repeated in full count once; other items under the same key are
    told apart by ``item_hash``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 up to limit - 1")
    over = items.where(F.length("text") > limit).dropDuplicates(["item_table", "item_key", "chunk_no", "text"])
    cores = over.select(
        "item_table", "item_key", "chunk_no", F.xxhash64("text").alias("item_hash"), F.length("text").alias("item_chars"),
        F.regexp_extract_all("text", F.lit(core_pattern(limit - overlap)), F.lit(0)).alias("cores"),
    )
    ends = F.aggregate(
        F.transform("cores", lambda c: F.length(c)), F.array().cast("array<int>"), lambda a, n: F.array_append(a, n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))
    )
    # Each piece gets what it needs before the array is taken apart, so that no row carries the whole of it.
    before = F.concat(F.array(F.lit("")), F.slice("cores", 1, F.size("cores") - 1))
    zipped = F.arrays_zip(F.col("cores").alias("core"), before.alias("before"), ends.alias("end"))
    each = cores.where(F.size("cores") > 0).select("item_table", "item_key", "chunk_no", "item_hash", "item_chars", F.posexplode(zipped).alias("piece_no", "z"))
    each = each.select("*", F.col("z.core").alias("core"), F.col("z.before").alias("before"), F.col("z.end").alias("end"))
    lead = each.withColumn("lead", lookback(F.col("before"), overlap))
    return lead.select(
        "item_table", "item_key", "chunk_no", "item_hash", "item_chars", "piece_no",
        (F.col("end") - F.length("core") - F.length("lead")).alias("start"),
        F.length("lead").alias("n_repeated"), F.concat("lead", "core").alias("piece"),
    )


def items_of(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two kinds of items: page contents under (markdown_docs, doc_path, 0), cached chunks under (embedding_cache, path, position)."""
    docs = pages.select(F.lit("markdown_docs").alias("item_table"), F.col("doc_path").alias("item_key"), F.lit(0).alias("chunk_no"), F.col("content").alias("text"))
    chunks = cache.select(F.lit("embedding_cache").alias("item_table"), F.col("path").alias("item_key"), F.posexplode("chunks").alias("chunk_no", "text"))
    return docs, chunks


def split_corpus(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """All oversized items: contents over 8,000 characters with an overlap of 200, chunks over 1,000 with one of 100."""
    docs, chunks = items_of(pages, cache)
    return split_items(docs, 8000, 200).unionByName(split_items(chunks, 1000, 100))
