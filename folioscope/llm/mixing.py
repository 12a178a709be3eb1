"""Mixing sources to target weights by hierarchical budgeting.

Targets are leaves of a tree (domain, language, source, or any other levels). Weights are propagated from the root;
a leaf that can't take its budget, since all its epochs are used up, passes the shortage to its siblings first and, when
these are full as well, to the siblings of its ancestors. Each leaf then takes whole seeded epochs of its documents and,
from one more, the prefix in seeded order that its remaining tokens allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, once, small

#: The most leaves a target table may have; the tree is budgeted on the driver.
MAX_LEAVES = 100_000
#: Ranges of the seeded order per leaf; a leaf's prefix is found by ranges first, then within the one it ends in.
RANGES = 4096


def budgets(leaves: Sequence[tuple[tuple, float, float]], total: float) -> dict[tuple, float]:
    """Tokens for each leaf (path, weight, capacity), of ``total`` in all.

    A node's weight is the sum of its leaves'. Among siblings, what a full node can't take goes to the others in
    proportion to their weights; only what a whole family can't take goes up. Leaves without weight get nothing.
    """

    class Node:
        def __init__(self) -> None:
            self.children: dict = {}
            self.weight = self.capacity = 0.0
            self.path: tuple | None = None

    root = Node()
    for path, weight, capacity in leaves:
        node = root
        for step in path:
            node.weight, node.capacity = node.weight + weight, node.capacity + (capacity if weight > 0 else 0)
            node = node.children.setdefault(step, Node())
        node.weight, node.capacity, node.path = node.weight + weight, node.capacity + (capacity if weight > 0 else 0), path
    out: dict[tuple, float] = {}

    def spend(node: Node, amount: float) -> None:
        if node.path is not None:
            out[node.path] = min(amount, node.capacity)
            return
        open_ = [c for c in node.children.values() if c.weight > 0]
        given = {id(c): 0.0 for c in open_}
        left = min(amount, node.capacity)
        while open_ and left > 1e-9 * max(1.0, amount):
            weight = sum(c.weight for c in open_)
            full = [c for c in open_ if given[id(c)] + left * c.weight / weight >= c.capacity]
            if not full:
                for c in open_:
                    given[id(c)] += left * c.weight / weight
                break
            for c in full:
                left -= c.capacity - given[id(c)]
                given[id(c)] = c.capacity
            open_ = [c for c in open_ if c not in full]
        for c in node.children.values():
            spend(c, given.get(id(c), 0.0))

    spend(root, total)
    return out


def plan(counted: DataFrame, targets: DataFrame, levels: Sequence[str], share: str = "target_share", repeats: str = "max_repeats") -> tuple[list[dict], float]:
    """For each leaf its available tokens, budget, whole epochs and rest, and the total aimed at.

    ``counted`` has the levels and n_tokens. Leaves whose name is null, whose share is null or not positive, or that may
    not be used at all get no budget; documents of sources without a target are left out of the total. Repeated target
    rows count once. Only one row per leaf reaches the driver, at most ``MAX_LEAVES``.
    """
    t = targets.select(*levels, F.col(share).cast("double").alias("__share"), F.col(repeats).cast("int").alias("__repeats")).dropna(subset=list(levels))
    t = t.groupBy(*levels).agg(F.max("__share").alias("__share"), F.max("__repeats").alias("__repeats"))
    have = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("__tokens"), F.count_if(F.col("n_tokens") > 0).alias("__docs"))
    rows = t.join(have, list(levels), "left").orderBy(*levels).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    total = float(sum(r["__tokens"] or 0 for r in rows))
    leaves = [(tuple(r[x] for x in levels), max(r["__share"] or 0.0, 0.0), float((r["__tokens"] or 0) * max(r["__repeats"] or 0, 0))) for r in rows]
    got = budgets(leaves, total)
    out = []
    for r, (path, weight, capacity) in zip(rows, leaves):
        tokens, budget = r["__tokens"] or 0, round(got.get(path, 0.0))
        epochs = min(int(budget // tokens), max(r["__repeats"] or 0, 0)) if tokens else 0
        rest = budget - epochs * tokens if tokens and epochs < (r["__repeats"] or 0) else 0
        out.append({"path": path, "weight": weight, "tokens": tokens, "docs": r["__docs"] or 0, "budget": budget, "epochs": epochs, "rest": rest, "repeats": r["__repeats"] or 0})
    return out, total


def mix(counted: DataFrame, leaves: list[dict], levels: Sequence[str], seed: int = 17) -> DataFrame:
    """The chosen documents: doc_id, the levels, n_tokens and copies (how often each is used, at least 1).

    ``counted`` has one row per document. The order of a leaf's last, partial epoch is a hash of seed, epoch and doc_id;
    of it come all documents before the first that would exceed the budget. Documents without tokens are never chosen.
    """
    spark = counted.sparkSession
    kinds = dict(counted.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in levels) + ", epochs int, rest long"
    wanted = [(*x["path"], x["epochs"], x["rest"]) for x in leaves if x["epochs"] or x["rest"]]
    chosen = counted.where("n_tokens > 0").join(small(spark.createDataFrame(wanted, schema)), list(levels))
    order = chosen.withColumn("__h", F.xxhash64(F.lit(seed), "epochs", "doc_id")).withColumn("__r", F.shiftrightunsigned("__h", 64 - RANGES.bit_length() + 1).cast("int"))
    per_range = order.where("rest > 0").groupBy(*levels, "__r").agg(F.sum("n_tokens").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*levels).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = per_range.withColumn("__before", F.coalesce(before, F.lit(0)))
    placed = order.join(ranges, [*levels, "__r"], "left")
    within = placed.where("rest > 0 and __before <= rest and __before + __n > rest")
    running = F.sum("n_tokens").over(Window.partitionBy(*levels, "__r").orderBy("__h", "doc_id"))
    partial = within.withColumn("__extra", (F.col("__before") + running <= F.col("rest")).cast("int"))
    other = placed.where("not (rest > 0 and __before <= rest and __before + __n > rest) or rest = 0")
    whole = other.withColumn("__extra", F.when((F.col("rest") > 0) & (F.col("__before") + F.col("__n") <= F.col("rest")), 1).otherwise(0))
    both = partial.unionByName(whole).withColumn("copies", F.col("epochs") + F.col("__extra"))
    return both.where("copies > 0").select("doc_id", *levels, "n_tokens", "copies")


def shares(mixed: DataFrame, leaves: list[dict], total: float, levels: Sequence[str]) -> DataFrame:
    """Per leaf: wanted and actual share, budget and actual tokens, available tokens, documents and copies used, most copies of one."""
    spark = mixed.sparkSession
    kinds = dict(mixed.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in levels) + ", wanted_share double, available_tokens long, wanted_tokens long, budget_tokens long, max_repeats int"
    weights = sum(x["weight"] for x in leaves) or 1.0
    rows = [(*x["path"], x["weight"] / weights, x["tokens"], round(total * x["weight"] / weights), x["budget"], x["repeats"]) for x in leaves]
    used = mixed.groupBy(*levels).agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies")
    )
    out = small(spark.createDataFrame(rows, schema)).join(used, list(levels), "left").fillna(0, ["actual_tokens", "n_docs", "n_copies", "most_copies"])
    whole = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))  # one row per leaf
    return out.withColumn("actual_share", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0))


def counted_documents(docs: DataFrame, levels: Sequence[str], counts) -> DataFrame:
    """doc_id, levels and n_tokens of each document, once per doc_id, kept in a checkpoint: the text is tokenized only once.

    Rows are made single after they are counted, when they are small; of rows that differ the least one stays.
    """
    named = docs.where(" and ".join(f"`{x}` is not null" for x in ["doc_id", *levels]))
    return cut(once(counts(named, ["doc_id", *levels]), ["doc_id"]))
