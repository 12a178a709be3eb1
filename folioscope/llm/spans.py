"""Long exact spans shared between records, by relative Lempel-Ziv parsing against every other record.

Reference index: every record is a reference block. It is indexed by anchors, the windowed minima of the hashes of its
``k``-character strings, chosen so that any ``min_length`` characters contain one and that equal text gives equal anchors.

Parsing: a document is read from left to right against each reference block that the index names for one of its anchors.
Where an anchor is found in the block, a factor begins, and it is extended greedily, from anchor to anchor, for as long as
the hashed text between them is the same (``factors_of``). At both boundaries of a factor the characters themselves are
compared; what is then at least ``min_length`` characters long becomes a span. Of a document all factors against a block
are kept, one for each offset between them, and not only the longest at a place: with the longest alone, records that
share a shorter stretch of it would be lost.

Anchors that very many records have are refined with more of the text around them, in the end to exact strings of
``min_length`` characters, before anything is paired.

Records of equal text are one class. A task parses one of a class, and texts are looked at again by one member each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, small, spread_join, stored

MIN_LENGTH = 120
#: Characters of an anchor; the window is ``min_length - K + 1`` anchors wide.
K = 30
#: An anchor that more places than this share is refined, with more of the text around it, instead of being paired.
COLD = 48
#: Characters hashed at a time.
_BLOCK = 1 << 18
#: Texts that a task remembers having parsed.
_SEEN = 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = _MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def anchors(texts: list[str], min_length: int, k: int, powers=None) -> tuple[np.ndarray, ...]:
    """(text number, position, anchor hash, position of the next anchor or -1, hash of the text from this anchor to the end of
    the next, hashes of what stands before and after it in 32 bits each, 0 where too little does).

    Periodic text gives many anchors of one hash, which are then shared enough to be refined to exact strings.
    """
    w = min_length - k + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars)
    empty = np.zeros(0, np.int64)
    if n < min_length:
        return empty, empty, empty, empty, empty, empty
    up, down = powers if powers is not None and len(powers[0]) > n else _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    # 40 bits of hash order the anchors; the other 24 are the position from the right, so ties go to the last in a window.
    where = np.arange(len(grams), dtype=np.uint64)
    order = (_mixed(grams) >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - where)
    width, least = 1, order
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.arange(len(least))
    inside = owner[first] == owner[first + min_length - 1]
    chosen = np.unique((np.uint64(0xFFFFFF) - (least[inside] & np.uint64(0xFFFFFF))).astype(np.int64))
    of, value = owner[chosen], grams[chosen]
    begin = chosen - (ends - lengths)[of]
    follow = np.full(len(chosen), -1, np.int64)
    link = np.zeros(len(chosen), np.uint64)
    linked = np.flatnonzero(of[1:] == of[:-1])
    follow[linked] = begin[linked + 1]
    a, b = chosen[linked], chosen[linked + 1] + k
    link[linked] = _mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    half = (min_length - k + 1) // 2
    left, right = np.zeros(len(chosen), np.uint64), np.zeros(len(chosen), np.uint64)
    there = np.flatnonzero(begin >= half)
    a = chosen[there]
    left[there] = _mixed((sums[a] - sums[a - half]) * down[a - half]) >> np.uint64(32) | np.uint64(1)
    there = np.flatnonzero(begin + k + half <= lengths[of])
    a = chosen[there] + k
    right[there] = _mixed((sums[a + half] - sums[a]) * down[a]) >> np.uint64(32) | np.uint64(1)
    return of, begin, _mixed(value).view(np.int64), follow, link.view(np.int64), (left << np.uint64(32) | right).view(np.int64)


def _pieces(text: str, min_length: int):
    """A text in overlapping pieces of at most a block, so that every window lies in one of them."""
    if len(text) <= 8 * _BLOCK:
        yield 0, text
        return
    for i in range(0, len(text) - min_length + 1, 8 * _BLOCK - min_length):
        yield i, text[i : i + 8 * _BLOCK]


def anchor_table(texts: DataFrame, min_length: int = MIN_LENGTH, k: int = K) -> DataFrame:
    """(cid, at, h, g, e) of every anchor of (cid, code): place, hash, hash of the text to the end of the next one, and of its sides.

    ``at`` holds the position in its upper and the distance to the next anchor (0: there is none) in its lower 32 bits. A
    task parses a text only once, so copies add at most one set of anchors for each task.
    """
    ship(texts.sparkSession)

    def run(batches):
        powers = _powers(2 * _BLOCK)
        seen: set[int] = set()
        ids, held = [], []

        def flush():
            # A very long text comes in pieces; a link is lost where a piece ends, never an anchor.
            of, pos, h, follow, g, e = anchors([t for _, t in held], min_length, k, powers)
            base, cid = np.array([o for o, _ in held], np.int64)[of], np.array(ids, np.int64)[of]
            at = (pos + base) << 32 | np.where(follow < 0, 0, follow - pos)
            return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(at), pa.array(h), pa.array(g), pa.array(e)], ["cid", "at", "h", "g", "e"])

        size = 0
        for batch in batches:
            for cid, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if cid in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(cid)
                for offset, piece in _pieces(code, min_length):
                    if size and size + len(piece) > _BLOCK:
                        yield flush()
                        ids, held, size = [], [], 0
                    ids.append(cid)
                    held.append((offset, piece))
                    size += len(piece)
        if held:
            yield flush()

    return texts.select("cid", "code").mapInArrow(run, "cid bigint, at bigint, h bigint, g bigint, e bigint")


def records(*tables: DataFrame) -> DataFrame:
    """(code_id, code) of several tables together; null ids and null texts have no spans."""
    parts = [t.select(F.col("code_id").cast("long").alias("code_id"), "code") for t in tables]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("code_id is not null and code is not null")


def classes(rows: DataFrame, min_length: int = MIN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(code_id, cid) of each record of at least ``min_length`` characters, where equal texts have equal cid, and (code_id, cid, code).

    The class is a hash of the text; a SHA-256 beside it proves that no two texts share one, else another seed is taken.
    """
    long = rows.where(F.length("code") >= min_length)
    for seed in range(8):
        cid = F.xxhash64(F.lit(seed), "code").alias("cid")
        members = stored(long.select("code_id", cid, F.unhex(F.sha2("code", 256)).alias("sha")).distinct())
        if members.groupBy("cid").agg(F.min("sha").alias("x"), F.max("sha").alias("y")).where("x <> y").isEmpty():
            break
    return members.select("code_id", "cid"), long.select("code_id", cid, "code")


def factors_of(a: np.ndarray, b: np.ndarray, shift: np.ndarray, pa: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where factors begin among the places at which document ``a`` meets block ``b``, in order of a, b, shift and place.

    ``gap`` is the distance to the next anchor where the text up to its end is the same on both sides, else 0. The parse
    goes on with a factor as long as the next place is where the one before said it would be.
    """
    begins = np.ones(len(a), bool)
    begins[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (shift[1:] != shift[:-1]) | (gap[:-1] == 0) | (pa[:-1] + gap[:-1] != pa[1:])
    return begins


def parsed(met: DataFrame) -> DataFrame:
    """Factors (a, b, shift, first, last) of (a, b, shift, pa, gap): each document parsed against each block it meets."""
    names = ["a", "b", "shift", "first", "last"]

    def run(batches):
        held = None  # the factor that may go on in the next batch: a, b, shift, first, last place, its gap
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, shift, pa_, gap = (batch.column(i).to_numpy() for i in range(5))
            first = pa_
            if held is not None:
                a, b, shift, pa_, gap = (np.insert(x, 0, v) for x, v in zip((a, b, shift, pa_, gap), (*held[:3], held[4], held[5])))
                first = np.insert(first, 0, held[3])
            at = np.flatnonzero(factors_of(a, b, shift, pa_, gap))
            ends = np.r_[at[1:], len(a)] - 1
            held = (a[-1], b[-1], shift[-1], first[at[-1]], pa_[-1], gap[-1])
            done, end = at[:-1], ends[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[done], b[done], shift[done], first[done], pa_[end])], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([v], np.int64 if i < 2 else np.int32)) for i, v in enumerate(held[:5])], names)

    placed = met.repartition("a", "b").sortWithinPartitions("a", "b", "shift", "pa").select("a", "b", "shift", "pa", "gap")
    return placed.mapInArrow(run, "a bigint, b bigint, shift int, first int, last int")


def spans(members: DataFrame, texts: DataFrame, min_length: int = MIN_LENGTH, k: int = K, cold: int = COLD, whole: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(factors, strings): where the classes of (code_id, cid), with their texts (code_id, cid, code), share text.

    ``factors``: (a, b, a_start, b_start, n) with a < b, a stretch of n >= min_length characters around common anchors; it
    is maximal if ``whole``; otherwise it is enough of it, and of each pair, to tell that they share one.
    ``strings``: (s, cid, pos, paired), exact strings of ``min_length`` characters over much-shared anchors that at least
    two classes have; those with equal s are equal. None if no anchor is shared that much.
    """
    ship(texts.sparkSession)
    found = stored(anchor_table(texts, min_length, k))
    groups = stored(grouped(found, "h", cold))
    one_each = members.groupBy("cid").agg(F.min("code_id").alias("code_id"))
    position = lambda c: F.shiftright(c, 32).cast("int")
    gap = F.col("x.at").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    met = met_in(groups, cold).where(reaching("x.e", "y.e")).select(
        F.col("x.cid").alias("a"),
        F.col("y.cid").alias("b"),
        (position(F.col("y.at")) - position(F.col("x.at"))).alias("shift"),
        position(F.col("x.at")).alias("pa"),
        F.when(F.col("x.g") == F.col("y.g"), gap).otherwise(0).alias("gap"),
    )
    factor = parsed(met)
    strings = None
    hot = groups.where(F.size("p") > cold).select("h")
    if not hot.isEmpty():
        again, strings = refined(among(found, hot).select("h", "cid", position(F.col("at")).alias("pos"), "e"), one_each, texts, min_length, k, cold)
        factor = factor.unionByName(again)
    inside = F.col("last") - F.col("first") + k
    if whole:
        return bounded(factor, one_each, texts, min_length, k), strings
    sure = inside >= min_length
    decided = factor.withColumn("sure", F.max(sure).over(Window.partitionBy("a", "b")))
    decided = stored(decided.where(sure | ~F.col("sure")))
    kept = decided.where("sure").select("a", "b", F.col("first").alias("a_start"), (F.col("first") + F.col("shift")).alias("b_start"), inside.alias("n"))
    return kept.unionByName(bounded(decided.where("not sure").drop("sure"), one_each, texts, min_length, k)), strings


def among(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows whose ``h`` is in ``hot``, which has it once: by a broadcast if that is small, else salted, for these are the hottest keys."""
    side = small(hot)
    return rows.join(side, "h") if side is not hot else spread_join(rows, hot, ["h"], "inner")


def reaching(x: str, y: str):
    """Whether two anchors may lie in a common stretch: half of the rest of it is on one side of them, and alike."""
    same = F.col(x).bitwiseXOR(F.col(y))
    low = F.lit(0xFFFFFFFF)
    left = (F.shiftright(same, 32) == 0) & (F.shiftright(F.col(x), 32) != 0)
    return left | (same.bitwiseAND(low) == 0) & (F.col(x).bitwiseAND(low) != 0)


def grouped(rows: DataFrame, key: str, cold: int) -> DataFrame:
    """(key, p): what rows of one key have besides it, at most ``cold + 1`` of them and at least two.

    Each map task sends at most ``cold + 1`` different rows of a key on, so no key is ever gathered in one place; a list of
    ``cold + 1`` entries says that the key is much shared and has to be refined.
    """
    rest = [c for c in rows.columns if c != key]
    ranked = rows.withColumn("__n", F.dense_rank().over(Window.partitionBy(key).orderBy(*rest)))
    kept = ranked.where(F.col("__n") <= cold + 1).groupBy(key).agg(F.collect_set(F.struct(*rest)).alias("p"))
    return kept.where("size(p) > 1")


def met_in(groups: DataFrame, cold: int) -> DataFrame:
    """(x, y): the pairs, x.cid < y.cid, in groups that aren't much shared."""
    partners = F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y["cid"] > x["cid"]), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return groups.where(F.size("p") <= cold).select(F.inline(F.flatten(partners)))


def refined(places: DataFrame, one_each: DataFrame, texts: DataFrame, min_length: int, k: int, cold: int) -> tuple[DataFrame, DataFrame | None]:
    """Much-shared anchors, as (a, b, shift, first, last) where they meet, and as exact strings where even more is shared.

    A stretch of ``min_length`` characters over an anchor has half of the rest on one side of it at least; so the anchor
    with that half to its left, or to its right, is the next key.
    """
    left, right = F.shiftright("e", 32), F.col("e").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = F.array(F.when(left != 0, F.struct(F.xxhash64("h", left, F.lit(0)).alias("h"))), F.when(right != 0, F.struct(F.xxhash64("h", right, F.lit(1)).alias("h"))))
    longer = stored(places.distinct().select("cid", "pos", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("x")).select("x.h", "cid", "pos"))
    groups = stored(grouped(longer, "h", cold))
    factor = met_in(groups, cold).select(
        F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), (F.col("y.pos") - F.col("x.pos")).alias("shift"), F.col("x.pos").alias("first"), F.col("x.pos").alias("last")
    )
    hot = groups.where(F.size("p") > cold).select("h")
    strings = None if hot.isEmpty() else exact_strings(among(longer, hot).select("h", "cid", "pos").distinct(), one_each, texts, min_length, k)
    return factor.distinct(), strings


def bounded(factor: DataFrame, one_each: DataFrame, texts: DataFrame, min_length: int, k: int) -> DataFrame:
    """Factors extended at both boundaries by comparing characters, as (a, b, a_start, b_start, n) of at least ``min_length``.

    Both sides of a factor ask one member of their class for their context, in one join, and then meet.
    """
    ship(texts.sparkSession)
    reach = 2 * min_length
    shift = F.col("shift")
    sides = F.array(
        F.struct(F.col("a").alias("cid"), F.lit(0).alias("side"), F.col("first").alias("x"), F.col("last").alias("y")),
        F.struct(F.col("b").alias("cid"), F.lit(1).alias("side"), (F.col("first") + shift).alias("x"), (F.col("last") + shift).alias("y")),
    )
    asked = factor.select("a", "b", "shift", "first", "last", F.inline(sides)).distinct()
    asked = small(stored(spread_join(asked, one_each, ["cid"], "inner")))
    left = F.greatest(F.col("x") - reach, F.lit(0))
    context = F.struct("side", F.col("code").substr(left + 1, F.col("x") - left).alias("l"), F.col("code").substr(F.col("y") + k + 1, F.lit(reach)).alias("r"))
    both = asked.join(texts, ["cid", "code_id"]).groupBy("a", "b", "shift", "first", "last").agg(F.min(context).alias("p"), F.max(context).alias("q"))
    two = both.select("a", "b", "shift", "first", "last", F.col("p.l").alias("la"), F.col("p.r").alias("ra"), F.col("q.l").alias("lb"), F.col("q.r").alias("rb"))

    def run(batches):
        for batch in batches:
            la, ra, lb, rb = (batch.column(i).to_pylist() for i in range(5, 9))
            x, y = (batch.column(i).to_numpy() for i in (3, 4))
            left = np.array([common(p[::-1], q[::-1]) for p, q in zip(la, lb)], np.int32)
            right = np.array([common(p, q) for p, q in zip(ra, rb)], np.int32)
            n = y - x + k + left + right
            keep = np.flatnonzero(n >= min_length)
            kept = batch.take(pa.array(keep))
            begin = (x - left)[keep]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(begin), pa.array(begin + kept.column(2).to_numpy()), pa.array(n[keep])], ["a", "b", "a_start", "b_start", "n"])

    return two.mapInArrow(run, "a bigint, b bigint, a_start int, b_start int, n int")


def common(x: str, y: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def exact_strings(hot: DataFrame, one_each: DataFrame, texts: DataFrame, min_length: int, k: int) -> DataFrame:
    """(s, cid, pos, paired): strings of ``min_length`` characters over much-shared anchors that at least two classes have.

    ``s`` is a hash of 128 bits. Of neighbouring strings that the same classes share, one is ``paired``: the others would
    only give the same pairs.
    """
    low = F.greatest(F.col("pos") + k - min_length, F.lit(0))
    high = F.least(F.col("pos"), F.length("code") - min_length)
    asked = hot.select("cid", "pos", "h").join(one_each, "cid")
    starts = asked.join(texts, ["cid", "code_id"]).where(low <= high).select("cid", "h", "code", F.explode(F.sequence(low, high)).alias("at"))
    piece = F.col("code").substr(F.col("at") + 1, F.lit(min_length))
    string = F.struct(F.xxhash64(piece, F.lit(min_length)).alias("x"), F.xxhash64(F.lit(1), piece).alias("y")).alias("s")
    strings = stored(starts.select(string, "cid", F.col("at").alias("pos"), "h").groupBy("s", "cid", "pos").agg(F.min("h").alias("h")))
    owners = strings.groupBy("s", "cid").agg(F.min("h").alias("h"))
    who = [F.count("*").alias("n"), F.sum(F.xxhash64("cid") % 1000000007).alias("who"), F.bit_xor(F.xxhash64("cid")).alias("who2"), F.min("h").alias("h")]
    sets = owners.groupBy("s").agg(*who).where("n > 1")
    one = sets.groupBy("h", "n", "who", "who2").agg(F.min("s").alias("keep"))
    marked = sets.join(one, ["h", "n", "who", "who2"]).select("s", (F.col("s") == F.col("keep")).alias("paired"))
    return strings.select("s", "cid", "pos").join(marked, "s")


def class_pairs(members: DataFrame, texts: DataFrame, min_length: int = MIN_LENGTH, **options) -> DataFrame:
    """(a, b), a < b: all pairs of classes that share a stretch, once each."""
    factors, strings = spans(members, texts, min_length, whole=False, **options)
    between = factors.select("a", "b")
    if strings is not None:
        s = strings.where("paired").select("s", "cid").distinct()
        between = between.unionByName(s.withColumnRenamed("cid", "a").join(s.withColumnRenamed("cid", "b"), "s").where("a < b").select("a", "b"))
    return between.distinct()


def linked(rows: DataFrame, min_length: int = MIN_LENGTH, **options) -> DataFrame:
    """The form without pairs of records: code_id, class_id (the smallest code_id of equal text), n_copies and n_links, one row each.

    ``n_links`` counts the classes of other texts that share a stretch with this one, so the links of copies aren't written
    out; whoever wants them joins classes. Records of less than ``min_length`` characters have no row.
    """
    members, texts = classes(rows, min_length)
    both = class_pairs(members, texts, min_length, **options)
    links = both.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    named = members.groupBy("cid").agg(F.min("code_id").alias("class_id"), F.count_distinct("code_id").alias("n_copies")).join(links, "cid", "left")
    return spread_join(members, named, ["cid"], "inner").select("code_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pairs(rows: DataFrame, min_length: int = MIN_LENGTH, **options) -> DataFrame:
    """(code_id_a, code_id_b), a < b: all pairs of records that share a stretch of at least ``min_length`` characters.

    Records with a null code_id or code, or shorter than ``min_length``, are in no pair. A record sent twice counts once;
    an id that comes with several texts stands for all of them. Exact copies are pairs as well.
    """
    members, texts = classes(rows, min_length)
    between = class_pairs(members, texts, min_length, **options)
    left = members.select(F.col("cid").alias("a"), F.col("code_id").alias("x"))
    right = members.select(F.col("cid").alias("b"), F.col("code_id").alias("y"))
    across = between.join(left, "a").join(right, "b").select("x", "y")
    within = members.select("cid", F.col("code_id").alias("x")).join(members.select("cid", F.col("code_id").alias("y")), "cid").where("x < y").select("x", "y")
    both = across.unionByName(within).where("x <> y")
    return both.select(F.least("x", "y").alias("code_id_a"), F.greatest("x", "y").alias("code_id_b")).distinct()


def coverage(rows: DataFrame, min_length: int = MIN_LENGTH, **options) -> DataFrame:
    """Per code_id: n_chars, shared_chars (characters in stretches that some other record has), n_spans (merged stretches).

    Records shorter than ``min_length`` share nothing; a text that another record repeats in full is shared throughout.
    Records with a null code have no row. Of an id with several texts, the largest figures count.
    """
    members, texts = classes(rows, min_length)
    factors, strings = spans(members, texts, min_length, **options)
    end = lambda x: (F.col(x) + F.col("n")).alias("y")
    covered = factors.select(F.col("a").alias("cid"), F.col("a_start").alias("x"), end("a_start")).unionByName(
        factors.select(F.col("b").alias("cid"), F.col("b_start").alias("x"), end("b_start"))
    )
    if strings is not None:
        covered = covered.unionByName(strings.select("cid", F.col("pos").alias("x"), (F.col("pos") + min_length).alias("y")))
    line = Window.partitionBy("cid").orderBy("x", "y")
    reach = F.max("y").over(line.rowsBetween(Window.unboundedPreceding, -1))
    merged = covered.groupBy("cid", "x").agg(F.max("y").alias("y")).withColumn("reach", F.coalesce(reach, F.lit(-1)))
    per_class = merged.groupBy("cid").agg(
        F.sum(F.greatest(F.col("y") - F.greatest("x", "reach"), F.lit(0))).alias("shared"), F.count_if(F.col("x") > F.col("reach")).alias("n_spans")
    )
    copies = members.groupBy("cid").agg(F.count_distinct("code_id").alias("copies"))
    known = members.join(copies.join(per_class, "cid", "left"), "cid")
    sizes = rows.select("code_id", F.length("code").alias("n_chars")).groupBy("code_id").agg(F.max("n_chars").alias("n_chars"))
    best = known.groupBy("code_id").agg(
        F.max("copies").alias("copies"), F.max("shared").alias("shared"), F.max("n_spans").alias("n_spans")
    )
    out = sizes.join(best, "code_id", "left")
    return out.select(
        "code_id", "n_chars",
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("long").alias("shared_chars"),
        F.when(F.col("copies") > 1, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
    )
