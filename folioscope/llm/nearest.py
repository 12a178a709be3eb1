"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are made unit length and rotated at random. Each is put into the cell of its nearest centre; of its residual only
the signs are kept, packed into bits, with two correction scalars. A query visits its nearest cells, estimates every inner
product there from the packed bits and its own four-bit coordinates, and reranks by real inner products only those whose
error bound reaches the k-th best. Centres are fitted on bounded samples; every vector is indexed and every vector is a
query. Beyond ``MOST_CELLS`` cells there are two levels: coarse centres are fitted on the driver, and within each coarse
cell the executors fit fine ones, so that cells stay small however many vectors there are. Cells are cut into blocks of
bounded size on both sides, so a crowded cell is many tasks and none of it is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, small, spread_join, stored

DIMENSIONS = 128
#: Vectors of the sample that centres are fitted on, and rounds of fitting.
SAMPLE = 20_000
ROUNDS = 6
#: Members of a cell on average, and the most cells of one level.
MEMBERS = 128
MOST_CELLS = 1024
#: Coarse cells a vector looks into for its cells, and the most fine cells of a coarse one (fitted on eight times as many vectors).
COARSE_PROBES = 6
MOST_FINE = 8192
#: Cells a query visits. Measured against brute force on 37,000 vectors: 0.98 of the 5 nearest.
PROBES = 8
#: Largest blocks of a cell's members and of its queries that meet in one task.
MEMBER_BLOCK = 4096
QUERY_BLOCK = 8192
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 1.9


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres by spherical k-means; a centre that loses its members keeps its place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        of = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), centres).astype(np.float32)
    return centres


def codes(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of rotated residuals, their lengths, and each residual direction's inner product with its code."""
    d = residuals.shape[1]
    length = np.linalg.norm(residuals, axis=1)
    bits = np.packbits(residuals > 0, axis=1, bitorder="little")
    inner = np.abs(residuals).sum(1) / np.sqrt(d) / np.maximum(length, 1e-12)
    return bits, length.astype(np.float32), inner.astype(np.float32)


def estimate(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated queries with residuals, and the half width of their error bounds.

    Queries are rounded to four bits a coordinate, so that each inner product is four popcounts of packed words.
    """
    d = queries.shape[1]
    low = queries.min(1, keepdims=True)
    step = np.maximum((queries.max(1, keepdims=True) - low) / 15, 1e-12)
    level = np.rint((queries - low) / step).astype(np.uint8)
    words = bits.view(np.uint64)
    dots = np.zeros((len(queries), len(bits)), np.uint32)
    for j in range(4):
        plane = np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(words.shape[1]):
            dots += np.bitwise_count(plane[:, w, None] & words[None, :, w]).astype(np.uint32) << np.uint32(j)
    ones = np.bitwise_count(words).sum(1).astype(np.float32)
    # <q, signs> with q = low + step * level and signs = 2 * bits - 1
    sums = low * d + step * level.sum(1, keepdims=True)
    signed = 2 * (low * ones[None, :] + step * dots) - sums
    norm = np.linalg.norm(queries, axis=1, keepdims=True)
    scale = length / np.maximum(inner, 1e-6)
    width = EPSILON * length * np.sqrt(np.maximum(1 - inner**2, 0)) / np.maximum(inner, 1e-6) / np.sqrt(d - 1)
    return signed / np.sqrt(d) * scale, norm * width


def usable(d: int = DIMENSIONS):
    """Condition on a column ``embedding``: exactly ``d`` finite components, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("embedding").isNotNull() & (F.size("embedding") == d) & fine & F.exists("embedding", lambda x: x != 0)


def collection(vectors: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, embedding) of both tables: of an id the row with the latest ts (null first), of a path its one row; null keys are left out.

    If rows tie, the larger embedding is taken. Usability is judged afterwards, so a late bad row replaces an early good one.
    """
    kind = "array<float>"
    a = vectors.select(F.col("id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("embedding").cast(kind).alias("embedding"))
    b = cache.select(F.col("path").alias("key"), F.lit(None).cast("timestamp").alias("ts"), F.col("embedding").cast(kind).alias("embedding"))
    rows = a.unionByName(b).where("key is not null")
    return rows.groupBy("key").agg(F.max(F.struct("ts", "embedding")).alias("r")).select("key", F.col("r.embedding").alias("embedding"))


def neighbours(rows: DataFrame, k: int = 5, probes: int = PROBES, floor: float = -2.0, d: int = DIMENSIONS) -> DataFrame:
    """(key, neighbour, cosine, rank): for each usable vector of (key, embedding) its ``k`` most similar others.

    Unusable vectors (null, another length, a null, NaN or infinite component, all zero) neither ask nor answer. Vectors
    equal in every component are indexed once and are each other's nearest, in order of key; other ties go to the smaller
    key. Neighbours under ``floor`` are left out. A collection of one vector, or of none, has no rows. Cosines are those
    of half-precision queries, within 1e-4.
    """
    spark = rows.sparkSession
    ship(spark)
    # Equal vectors are a class, known by a hash of 128 bits; the vector itself is carried once.
    good = rows.where(usable(d)).select("key", "embedding", *[F.xxhash64(F.lit(seed), "embedding").alias(n) for seed, n in enumerate(("e1", "e2"))])
    per = Window.partitionBy("e1", "e2").orderBy("key")
    ranked = good.withColumn("__n", F.row_number().over(per)).where(F.col("__n") <= k + 1)
    classes = ranked.groupBy("e1", "e2").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("key")).alias("keys"))
    base = stored(_units(classes, d).withColumn("cid", F.monotonically_increasing_id()))
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], "key string, neighbour string, cosine float, rank int")
    rate = min(1.0, SAMPLE / n)  # so about SAMPLE vectors reach the driver, whatever the size
    sample = base.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("unit").toArrow()
    points = np.frombuffer(b"".join(sample.column("unit").to_pylist()), np.float32).reshape(-1, d)
    cells = max(1, n // MEMBERS)
    if cells <= MOST_CELLS:
        centres = fit_centres(points, cells)
        placed = _placed(base, centres, min(probes, len(centres)), d)  # cheaper to place again than to keep
    else:
        placed = stored(_placed_finely(base, fit_centres(points, min(MOST_CELLS, int(np.ceil(np.sqrt(cells))))), probes, d))
    found = _searched(placed, k, floor, d)
    best = found.groupBy("cid").agg(F.flatten(F.collect_list("hits")).alias("hits"))  # at most probes times blocks of k each
    top = best.select("cid", F.slice(F.sort_array("hits", asc=False), 1, k).alias("hits"))
    return _named(base.select("cid", "e1", "e2", "keys"), top, good, k, floor)


def _units(classes: DataFrame, d: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            x /= np.abs(x).max(1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([v.tobytes() for v in x], pa.binary())], ["e1", "e2", "keys", "unit"])

    return classes.select("embedding", "e1", "e2", "keys").mapInArrow(run, "e1 bigint, e2 bigint, keys array<string>, unit binary")


def _placed(base: DataFrame, centres: np.ndarray, probes: int, d: int) -> DataFrame:
    """cid, unit, half (for use as a query) and its nearest cells, nearest first; the first is its home."""

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, d)
            near = x @ centres.T
            part = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(x), 1))
            part = np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * probes + 1, probes, dtype=np.int32)), pa.array(part.astype(np.int32).ravel()))
            half = [v.tobytes() for v in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(half, pa.binary()), cells], ["cid", "unit", "half", "cells"])

    return base.select("cid", "unit").mapInArrow(run, "cid bigint, unit binary, half binary, cells array<int>")


def _placed_finely(base: DataFrame, centres: np.ndarray, probes: int, d: int) -> DataFrame:
    """Like ``_placed``, with cells of two levels: the fine centres of the nearest coarse cells decide.

    Each coarse cell's fine centres are fitted in one task, on a sample that is bounded however crowded the cell is. The
    vectors that look into a coarse cell meet its centres in blocks.
    """
    spark = base.sparkSession
    near = _placed(base, centres, min(COARSE_PROBES, len(centres)), d)
    home = F.col("cells")[0].alias("cell")
    members = {r["cell"]: r["count"] for r in near.select(home).groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    visits = {r["cell"]: r["count"] for r in near.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    fine = {c: max(1, min(MOST_FINE, m // MEMBERS)) for c, m in members.items()}
    plan = [(c, fine[c], int(min(1.0, 8 * fine[c] / m) * (1 << 30)), -(-visits[c] // QUERY_BLOCK)) for c, m in members.items()]
    by_cell = F.broadcast(spark.createDataFrame(plan, "cell int, fine int, rate int, blocks int"))  # at most MOST_CELLS rows
    sample = near.select("cid", "unit", home).join(by_cell, "cell").where(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(1 << 30)) < F.col("rate"))

    def fit(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float32).reshape(-1, d)
        got = fit_centres(x, t.column("fine")[0].as_py())
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()], pa.int32()), "centres": pa.array([got.astype(np.float16).tobytes()], pa.binary())})

    fitted = stored(sample.select("cell", "fine", "unit").groupBy("cell").applyInArrow(fit, "cell int, centres binary"))
    part = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")
    asking = near.select("cid", "half", F.explode("cells").alias("cell")).join(by_cell, "cell").select("cid", "half", "cell", part)
    answering = fitted.join(by_cell, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def place(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, sims, cells, counts = [], [], [], []
        if a.num_rows and b.num_rows:
            y = np.frombuffer(b"".join(a.column("half").to_pylist()), np.float16).reshape(-1, d).astype(np.float32)
            c = np.frombuffer(b.column("centres")[0].as_py(), np.float16).reshape(-1, d).astype(np.float32)
            cell, cid, keep = b.column("cell")[0].as_py(), a.column("cid").to_numpy(), min(probes, len(c))
            step = max(1, (1 << 22) // len(c))
            for i in range(0, len(y), step):
                s = y[i : i + step] @ c.T
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                ids.append(cid[i : i + step])
                sims.append(np.take_along_axis(s, top, 1).ravel())
                cells.append(((cell << 20) + top.astype(np.int64)).ravel())
                counts.append(np.full(len(s), keep))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        ends = np.r_[0, np.cumsum(cat(counts, np.int64))].astype(np.int32)
        lists = pa.StructArray.from_arrays([pa.array(cat(sims, np.float32)), pa.array(cat(cells, np.int64))], ["sim", "cell"])
        return pa.table({"cid": pa.array(cat(ids, np.int64)), "near": pa.ListArray.from_arrays(pa.array(ends), lists)})

    met = asking.groupBy("cell", "block").cogroup(answering.groupBy("cell", "block")).applyInArrow(place, "cid bigint, near array<struct<sim:float,cell:bigint>>")
    best = met.groupBy("cid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), asc=False), 1, probes).alias("near"))  # at most COARSE_PROBES lists each
    return near.select("cid", "unit", "half").join(best.select("cid", F.transform("near", lambda x: x["cell"]).alias("cells")), "cid")


def _searched(placed: DataFrame, k: int, floor: float, d: int) -> DataFrame:
    """(cid, hits): for each query and block of members it meets, its at most ``k`` best there."""
    homes = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("m"))
    visits = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    sizes = visits.join(homes, "cell").select("cell", F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb"))
    blocks = small(stored(sizes))
    part = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.select("cid", F.col("unit").alias("v"), F.col("cells")[0].alias("cell")).join(blocks, "cell").select("cid", "v", "cell", part(F.col("mb")).alias("m"), every("qb").alias("q"), F.lit(True).alias("is_member"))
    queries = placed.select("cid", F.col("half").alias("v"), F.explode("cells").alias("cell")).join(blocks, "cell").select("cid", "v", "cell", every("mb").alias("m"), part(F.col("qb")).alias("q"), F.lit(False).alias("is_member"))
    turn = rotation(d)

    def meet(t: pa.Table) -> pa.Table:
        is_member = t.column("is_member").to_numpy(zero_copy_only=False)
        ids, raw = t.column("cid").to_numpy(), t.column("v").to_pylist()
        mi, qi = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        out_ids, offsets, others, cosines = [], [0], [], []
        if len(mi) and len(qi):
            x = np.frombuffer(b"".join(raw[i] for i in mi), np.float32).reshape(-1, d)
            y = np.frombuffer(b"".join(raw[i] for i in qi), np.float16).reshape(-1, d).astype(np.float32)
            centre = x.mean(0)  # residuals may be taken from any vector; that of the members themselves makes them small
            bits, length, inner = codes((x - centre) @ turn.T)
            at_centre = y @ centre
            rotated = y @ turn.T
            step = max(1, (1 << 18) // len(mi))
            for s in range(0, len(qi), step):
                e = slice(s, s + step)
                about, width = estimate(rotated[e], bits, length, inner)
                about += at_centre[e, None]
                self_ = ids[mi][None, :] == ids[qi[e]][:, None]
                sure = about - width
                sure[self_] = -4
                kth = np.partition(sure, -k, axis=1)[:, -k] if len(mi) > k else np.full(len(sure), -3.0, np.float32)
                r, c = np.nonzero((about + width >= np.maximum(kth, floor)[:, None]) & ~self_)
                real = np.empty(len(r), np.float32)
                for z in range(0, len(r), 1 << 15):
                    w = slice(z, z + (1 << 15))
                    real[w] = np.einsum("ij,ij->i", y[e][r[w]], x[c[w]])
                keep = real >= floor - 1e-4
                r, c, real = r[keep], c[keep], real[keep]
                order = np.lexsort((c, -real, r))
                r, c, real = r[order], c[order], real[order]
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
                place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                r, c, real = r[place < k], c[place < k], real[place < k]
                rows, count = np.unique(r, return_counts=True)
                out_ids.append(ids[qi[e]][rows])
                offsets.extend((offsets[-1] + np.cumsum(count)).tolist())
                others.append(ids[mi][c])
                cosines.append(real)
        cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        hits = pa.StructArray.from_arrays([pa.array(cat(cosines, np.float32)), pa.array(cat(others, np.int64))], ["cos", "other"])
        return pa.table({"cid": pa.array(cat(out_ids, np.int64)), "hits": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)})

    return members.unionByName(queries).groupBy("cell", "m", "q").applyInArrow(meet, "cid bigint, hits array<struct<cos:float,other:bigint>>")


def _named(keys: DataFrame, top: DataFrame, good: DataFrame, k: int, floor: float) -> DataFrame:
    """Classes back to keys: copies of a vector first, then the members of its neighbours, in order of cosine and key."""
    one = top.select("cid", F.posexplode("hits").alias("at", "h")).select("cid", F.col("h.cos").alias("cos"), F.col("h.other").alias("other"))
    met = one.join(keys.select(F.col("cid").alias("other"), F.slice("keys", 1, k).alias("theirs")), "other")
    near = met.groupBy("cid").agg(F.flatten(F.collect_list(F.transform("theirs", lambda t: F.struct((-F.col("cos")).alias("far"), t.alias("name"))))).alias("near"))  # at most k * k
    own = F.transform("keys", lambda t: F.struct(F.lit(-2.0).cast("float").alias("far"), t.alias("name")))
    lists = keys.join(near, "cid", "left").select("cid", "keys", F.array_sort(F.concat(F.when(F.lit(1.0) >= floor, own).otherwise(F.array().cast("array<struct<far:float,name:string>>")), F.coalesce("near", F.array().cast("array<struct<far:float,name:string>>")))).alias("all"))
    few = lists.select(F.explode("keys").alias("key"), "all")  # classes of up to k + 1 keys are whole; larger ones are completed below
    large = keys.where(F.size("keys") > k).select("e1", "e2", "keys")
    rest = spread_join(good.select("key", "e1", "e2"), large, ["e1", "e2"], "inner").where(~F.array_contains("keys", F.col("key")))
    rest = rest.select("key", F.transform("keys", lambda t: F.struct(F.lit(-2.0).cast("float").alias("far"), t.alias("name"))).alias("all"))
    both = few.unionByName(rest) if floor <= 1.0 else few
    picked = both.select("key", F.slice(F.filter("all", lambda x: x["name"] != F.col("key")), 1, k).alias("all"))
    out = picked.select("key", F.posexplode("all").alias("rank", "x"))
    cosine = F.when(F.col("x.far") == -2.0, F.lit(1.0)).otherwise(-F.col("x.far")).cast("float")
    return out.select("key", F.col("x.name").alias("neighbour"), cosine.alias("cosine"), (F.col("rank") + 1).alias("rank")).where(F.col("cosine") >= floor)


def pairs(found: DataFrame, least: float) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of which one is a neighbour of the other with a cosine of at least ``least``."""
    far = found.where(F.col("cosine") >= least)
    return far.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
