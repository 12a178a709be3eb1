"""Duplicates hidden by formatting differences: urls dictionary-encoded to sorted integer tuples and grouped.

A url is cut into its raw values, the first part and the fields. The dictionary has each distinct raw value once, with the
integer identifier of its canonical form; so every value is canonicalised once, however many urls have it. A url becomes
the tuple of its first part's identifier and its sorted field identifiers, and equal tuples are one resource. Identifiers
are hashes of canonical values, 96 bits in two integers: they need no numbering and no exchange, and are the same when a
task runs again. Urls are reduced to distinct ones first and then stand for themselves by such a hash, so beyond the
dictionary only integers are shuffled. Values, tuples and urls that very many rows have are salted where they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread_join, stored


def bare(text: Column) -> Column:
    """Letters lowered, everything but letters and digits deleted."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def values(url: Column) -> Column:
    """Raw values of a url: the first part (always there, maybe empty) and its non-empty fields, as an array of (kind, raw)."""
    at = F.instr(url, "?")
    first = F.struct(F.lit(0).cast("byte").alias("kind"), F.when(at > 0, F.left(url, at - 1)).otherwise(url).alias("raw"))
    fields = F.transform(F.split(F.substring(url, at + 1, F.length(url)), "[&;]"), lambda f: F.struct(F.lit(1).cast("byte").alias("kind"), f.alias("raw")))
    return F.when(at > 0, F.concat(F.array(first), F.filter(fields, lambda f: f["raw"] != ""))).otherwise(F.array(first))


def _hashed(*columns: str | Column, names: tuple[str, str]) -> list[Column]:
    """A hash of 96 bits: one of 64 and another, of a different kind, of 32."""
    return [F.xxhash64(*columns).alias(names[0]), F.hash(*columns).alias(names[1])]


def dictionary(urls: DataFrame) -> DataFrame:
    """(r1, r2, kind, i1, i2): each distinct raw value of (url), by its hash, with the identifier of its canonical form.

    Fields without a letter or digit have no identifier and no row here; a first part without any has that of the empty text.
    """
    raw = urls.select(F.inline(values(F.col("url")))).distinct()
    canonical = raw.withColumn("value", bare(F.col("raw"))).where("kind = 0 or value <> ''")
    return canonical.select(*_hashed("kind", "raw", names=("r1", "r2")), "kind", *_hashed("value", names=("i1", "i2")))


def resources(rows: DataFrame) -> DataFrame:
    """(u1, u2, keep_id): each distinct non-null url of (status_id, url), by its hash, with the smallest status_id of its resource.

    A null url names no resource and has no row here; an empty one is a resource of its own. Urls whose canonical values
    are equal share one keep_id.
    """
    known = rows.where("url is not null and status_id is not null")
    urls = stored(known.groupBy("url").agg(F.min("status_id").alias("first_id")))
    parts = urls.select(*_hashed("url", names=("u1", "u2")), "first_id", F.explode(values(F.col("url"))).alias("v"))
    coded = spread_join(parts.select("u1", "u2", "first_id", *_hashed("v.kind", "v.raw", names=("r1", "r2"))), dictionary(urls), ["r1", "r2"], "inner")
    tuples = coded.groupBy("u1", "u2", "first_id").agg(F.array_sort(F.collect_list(F.struct("kind", "i1", "i2"))).alias("t"))
    tuples = stored(tuples.select("u1", "u2", "first_id", *_hashed("t", names=("t1", "t2"))))
    kept = tuples.groupBy("t1", "t2").agg(F.min("first_id").alias("keep_id"))
    return spread_join(tuples, kept, ["t1", "t2"], "inner").select("u1", "u2", "keep_id")


def _own(rows: DataFrame) -> DataFrame:
    """(status_id, u1, u2) of rows with a url, once each."""
    return rows.where("url is not null and status_id is not null").select("status_id", *_hashed("url", names=("u1", "u2"))).distinct()


def collapsed(rows: DataFrame) -> DataFrame:
    """One row per resource: keep_id, the kept row's url, n_rows, n_urls. Rows with a null url stay single (n_urls 0).

    A status_id sent twice counts once. Of a status_id that comes with several urls each counts.
    """
    placed = spread_join(_own(rows), resources(rows), ["u1", "u2"], "inner")
    sizes = placed.groupBy("keep_id", "u1", "u2").agg(F.count("*").alias("n")).groupBy("keep_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_urls"))
    first = rows.where("url is not null and status_id is not null").groupBy(F.col("status_id").alias("keep_id")).agg(F.min("url").alias("url"))
    named = sizes.join(first, "keep_id")
    single = rows.where("url is null and status_id is not null").select(F.col("status_id").alias("keep_id")).distinct()
    return named.select("keep_id", "url", "n_rows", "n_urls").unionByName(
        single.select("keep_id", F.lit(None).cast("string").alias("url"), F.lit(1).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_urls"))
    )


def members(rows: DataFrame) -> DataFrame:
    """(keep_id, status_id): the smallest status_id of each resource with each of the others, once each."""
    own = rows.where("url is not null and status_id is not null").select("status_id", *_hashed("url", names=("u1", "u2")))
    return spread_join(own, resources(rows), ["u1", "u2"], "inner").where("status_id <> keep_id").select("keep_id", "status_id").distinct()
