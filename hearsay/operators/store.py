"""Stored tables: versions under a manifest (K7, K8), and reuse of what was built from the same input.

A table is a folder of version folders, written whole and never changed, and a manifest: append-only rows
(seq, version, key, state). A version exists once its manifest row is committed, so a writer that dies leaves
nothing that a reader could see. Readers hold the version they opened; a refresh adds a version beside it, and
``expire`` removes versions that are neither the newest nor within the number that is kept.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

MANIFEST = "seq long, version string, key string, state string"


def table_root(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "tables", name)


def _path(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as Hadoop objects: any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no folder."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


class Versions:
    """The versions of one table below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.manifest = os.path.join(root, "manifest")

    def _log(self, rows: list[tuple]) -> None:
        # Literals of the plan: rows made in Python would start a worker for each commit.
        lines = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, (c.split() for c in MANIFEST.split(", ")))]) for r in rows])
        self.spark.range(1, numPartitions=1).select(F.inline(lines)).write.mode("append").parquet(self.manifest)

    def entries(self) -> list[tuple[int, str, str]]:
        """(seq, version, key) of the live versions, oldest first; the manifest has a row or two a version."""
        if not exists(self.spark, self.manifest):
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(self.manifest).groupBy("version").agg(
            F.min("seq").alias("seq"), F.max("key").alias("key"), F.bool_or(F.col("state") == "expired").alias("gone"))
        return sorted((r["seq"], r["version"], r["key"]) for r in rows.filter(~F.col("gone")).collect())

    def publish(self, df: DataFrame, key: str = "", row_group_bytes: int | None = None) -> str:
        """Write ``df`` as a new version and make it the current one; the version's folder."""
        version = f"v={uuid.uuid4().hex}"
        path = os.path.join(self.root, version)
        w = df.write.mode("errorifexists")
        if row_group_bytes:
            w = w.option("parquet.block.size", str(row_group_bytes))
        w.parquet(path)
        seq = max([s for s, _, _ in self.entries()], default=0) + 1
        self._log([(seq, version, key, "live")])
        return path

    def current(self, key: str | None = None) -> str | None:
        """The newest version's folder (of ``key``, if one is asked for)."""
        found = [v for _, v, k in self.entries() if key is None or k == key]
        return os.path.join(self.root, found[-1]) if found else None

    def read(self, path: str | None = None) -> DataFrame:
        """A reader of one version, the current one unless a folder is given."""
        path = path or self.current()
        if path is None:
            raise FileNotFoundError(f"no version below {self.root}")
        return self.spark.read.parquet(path)

    def expire(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions; how many went."""
        old = self.entries()[:-keep] if keep else self.entries()
        if old:
            self._log([(s, v, k, "expired") for s, v, k in old])  # first the manifest: nobody opens it any more
            for _, v, _ in old:
                remove(self.spark, os.path.join(self.root, v))
        return len(old)


class RunLog:
    """An append-only table of runs: a folder ``run_id=...`` each, written once and as a whole.

    A run counts when its folder is complete, so the same run a second time adds nothing, and one that died while it
    wrote is written again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def _folder(self, run_id: str) -> str:
        return os.path.join(self.root, f"run_id={run_id}")

    def has_run(self, run_id: str) -> bool:
        return exists(self.spark, os.path.join(self._folder(run_id), "_SUCCESS"))

    def append(self, run_id: str, rows: Callable[[], DataFrame] | DataFrame) -> bool:
        """Write a run's rows once; whether they were new."""
        if self.has_run(run_id):
            return False
        rows = rows() if callable(rows) else rows
        rows.select(*self.schema.names).coalesce(1).write.mode("overwrite").parquet(self._folder(run_id))
        return True

    def runs(self) -> list[str]:
        """The complete runs."""
        names = [n[len("run_id="):] for n in children(self.spark, self.root) if n.startswith("run_id=")]
        return [n for n in names if self.has_run(n)]

    def rows(self) -> DataFrame:
        """The rows of all complete runs, with their run_id."""
        schema = T.StructType([*self.schema.fields, T.StructField("run_id", T.StringType())])
        folders = [self._folder(r) for r in self.runs()]
        if not folders:
            # Literals, as in the manifest: no rows made in Python.
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)


def input_version(*tables: DataFrame) -> str:
    """A key of the tables' files: their paths, sizes and times of change. No column is read."""
    files = None
    for t in tables:
        f = t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").groupBy(
            "file_path", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("n"))
        files = f if files is None else files.unionByName(f)
    h = F.xxhash64("file_path", "file_size", "file_modification_time", "n").cast("decimal(38,0)")
    n, total = files.agg(F.count(F.lit(1)), F.sum(h)).first()
    return f"{n}-{total}"


def stored_path(spark: SparkSession, name: str, key: str) -> str | None:
    """The folder of the version of ``name`` that was built from the input ``key``."""
    known = spark.sparkContext.__dict__.setdefault("_hearsay_versions", {})
    if (name, key) not in known:
        path = Versions(spark, table_root(spark, name)).current(key)
        if path is None:
            return None
        known[name, key] = path  # a version never changes; this session doesn't expire those it reads
    return known[name, key]


def stored(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame], row_group_bytes: int | None = None) -> DataFrame:
    """The table ``name`` built from the input ``key``: read where it is stored, built and published where not."""
    path = stored_path(spark, name, key) or Versions(spark, table_root(spark, name)).publish(build(), key, row_group_bytes)
    return spark.read.parquet(path)
