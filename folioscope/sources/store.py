"""Keyed tables in a folder: point lookups, upserts, deletions and clearing, each an atomic step.

A table is cut into buckets by a hash of its key. A write replaces only the buckets it touches, in a new folder, and then
publishes a new manifest, which names the folder of each bucket; readers go by the newest manifest. So a write that fails
half-way leaves the old table as it was, and a table is never read while it is being moved. All file access is by Hadoop
paths: a local folder, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import caches

#: Manifests that are kept, so that readers of the one before aren't cut off.
KEPT = 2


class KeyedTable:
    """A table at ``path`` with one row per key; one writer at a time (a second one fails when it publishes).

    Rows with a null in the key are left out. Of rows of one key in a batch, and against the stored one, the largest by
    ``order`` stays; without ``order`` the batch wins. The number of buckets is fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), list(order), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests
    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{versions[-1]}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {**json.loads(text), "version": versions[-1]}

    def _publish(self, old: dict | None, schema: T.StructType, folders: dict[str, str], batch: int) -> None:
        version = (old["version"] if old else 0) + 1
        text = json.dumps({"schema": schema.jsonValue(), "folders": folders, "batch": batch, "buckets": old["buckets"] if old else self.buckets})
        fresh = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._path(f"{self.path}/_manifests/{version}.json")
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            raise OSError(f"another writer has published version {version} of {self.path}")
        self._tidy()

    def _tidy(self) -> None:
        """Remove older manifests and the folders that none of the kept ones names."""
        versions = self._versions()
        for v in versions[:-KEPT]:
            self._fs.delete(self._path(f"{self.path}/_manifests/{v}.json"), False)
        used = set()
        for v in versions[-KEPT:]:
            stream = self._fs.open(self._path(f"{self.path}/_manifests/{v}.json"))
            used |= {f.split("/")[0] for f in json.loads(bytes(stream.readAllBytes()).decode())["folders"].values()}
            stream.close()
        data = self._path(f"{self.path}/data")
        if self._fs.exists(data):
            for f in self._fs.listStatus(data):
                if str(f.getPath().getName()) not in used:
                    self._fs.delete(f.getPath(), True)

    def _typed(self, rows: DataFrame, manifest: dict | None) -> DataFrame:
        """``rows`` with keys of the table's types, since equal numbers of other types would hash to other buckets."""
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(manifest["schema"])} if manifest else {}
        return rows.withColumns({k: F.col(k).cast(kinds[k]) for k in self.keys if k in kinds})

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _rows(self, manifest: dict | None, only: set[int] | None = None) -> DataFrame | None:
        if manifest is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # the table
    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        """All rows; a table that was never written is an error."""
        rows = self._rows(self._manifest())
        if rows is None:
            raise FileNotFoundError(self.path)
        return rows

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of the distinct non-null keys in ``keys``; only the buckets they are in are read."""
        manifest = self._manifest()
        if manifest is None:
            raise FileNotFoundError(self.path)
        wanted = self._typed(keys.select(*self.keys), manifest).dropna().distinct()
        touched = {r[0] for r in wanted.select(self._bucket(manifest["buckets"])).distinct().collect()}  # at most one row a bucket
        return self._rows(manifest, touched).join(wanted, self.keys, "left_semi")

    def _write(self, manifest: dict | None, rows: DataFrame, touched: set[int], batch: int) -> None:
        n = manifest["buckets"] if manifest else self.buckets
        name = uuid.uuid4().hex
        placed = rows.withColumn("__bucket", self._bucket(n))
        placed.repartition(min(n, max(1, len(touched))), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        written = {str(f.getPath().getName()) for f in self._fs.listStatus(self._path(f"{self.path}/data/{name}"))}
        folders = {b: f for b, f in (manifest["folders"] if manifest else {}).items() if int(b) not in touched}
        folders |= {str(b): f"{name}/__bucket={b}" for b in touched if f"__bucket={b}" in written}
        self._publish(manifest, rows.schema, folders, batch)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Merge ``rows``; False if ``batch``, the number of a micro-batch, has been merged before."""
        manifest = self._manifest()
        if batch is not None and manifest is not None and batch <= manifest["batch"]:
            return False
        n = manifest["buckets"] if manifest else self.buckets
        fresh = self._typed(rows, manifest).dropna(subset=self.keys)
        touched = {r[0] for r in fresh.select(self._bucket(n)).distinct().collect()}  # at most one row a bucket
        old = self._rows(manifest, touched)
        both = fresh.withColumn("__new", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("__new", F.lit(0)))
        order = [*self.order, "__new"]
        rest = [c for c in rows.columns if c not in self.keys]
        merged = caches.latest(both, self.keys, [*order, *(c for c in rest if c not in order)]).drop("__new")
        self._write(manifest, merged, touched, batch if batch is not None else manifest["batch"] if manifest else -1)
        return True

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of these keys; keys that aren't there change nothing."""
        manifest = self._manifest()
        if manifest is None:
            return
        gone = self._typed(keys.select(*self.keys), manifest).dropna().distinct()
        touched = {r[0] for r in gone.select(self._bucket(manifest["buckets"])).distinct().collect()}  # at most one row a bucket
        touched &= {int(b) for b in manifest["folders"]}
        if touched:
            self._write(manifest, self._rows(manifest, touched).join(gone, self.keys, "left_anti"), touched, manifest["batch"])

    def clear(self) -> None:
        """Remove all rows; the table stays."""
        manifest = self._manifest()
        if manifest is not None:
            self._publish(manifest, T.StructType.fromJson(manifest["schema"]), {}, manifest["batch"])
