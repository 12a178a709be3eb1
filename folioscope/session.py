"""What every operator needs of a session: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that is ever broadcast by hint.
BROADCAST_BYTES = 8 << 20
#: One row in so many is looked at to find hot keys.
HOT_RATE = 32


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` where the session names one, else one of our own."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"folioscope-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it from reliable storage from then on (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def temporary(spark: SparkSession, path: str) -> str:
    """``path``, removed when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared checkpoint folder and read from there; removed when the driver ends."""
    spark = df.sparkSession
    path = temporary(spark, f"{checkpoint_dir(spark).rstrip('/')}/folioscope-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's own size estimate is within ``limit``; otherwise ``df`` as it is.

    Beyond the limit the planner is left to a shuffle join, so nothing that grows with the data is broadcast.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of rows that differ the least one, so that the choice doesn't depend on the order of rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def hot_keys(df: DataFrame, key: str, most: int = 64) -> DataFrame:
    """The ``most`` most frequent values of ``key`` (non-null), as a broadcast side: its size is bounded by ``most`` rows.

    A value outside them holds less than ``1 / most`` of all rows, so salting only these is enough against skew.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return F.broadcast(counts.orderBy(F.desc("__n"), key).limit(most).select(key, F.lit(True).alias("hot")))


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``side`` on ``keys``; the 64 most frequent keys of ``rows`` are salted, so none fills a task.

    They are looked for among one row in ``HOT_RATE``, chosen by a hash: only where rows go depends on that, never which
    rows come out. Salts are hashes of the rows themselves, so a task that runs again gives the same ones. ``side`` should be distinct by
    its keys; its rows of hot keys are repeated ``salts`` times.
    """
    key = F.when(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x), F.xxhash64(*keys))
    plain = [f"`{c}`" for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    some = rows.where(F.pmod(F.xxhash64(F.lit(5), *plain), F.lit(HOT_RATE)) == 0)
    hot = hot_keys(some.select(key.alias("__k")), "__k")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*plain), F.lit(salts))).otherwise(0).cast("int")
    left = rows.withColumn("__k", key).join(hot, "__k", "left").withColumn("__salt", salt).drop("__k", "hot")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = side.withColumn("__k", key).join(hot, "__k", "left").withColumn("__salt", copies).drop("__k", "hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_folioscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=f"{root.name}-code-")  # only the driver reads it, to serve it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(out)
    sc._folioscope_shipped = True
