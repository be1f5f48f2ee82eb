"""A keyed table of newest rows that a stream keeps in buckets of files.

Keys are dealt to a fixed number of buckets.  A micro-batch reads, merges and
writes only the buckets that its rows touch; the files of all others stay as
they are.  What is current stands in a manifest, one small file for each
micro-batch, with the version of every bucket::

    table/bucket=7/version=12/part-....parquet
    table/_manifests/version=12/part-....parquet      (bucket, at)

A version is the number of its micro-batch, so a repeated micro-batch overwrites
its own files and starts from the manifest before it.  Readers see the newest
complete manifest.  Files that neither of the two newest manifests names are
dropped after each write.  All buckets of a micro-batch are written by one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.intake import latest_state


@dataclass(frozen=True)
class LatestTable:
    """path of the table, its key columns, the columns that order the rows of a key, and its number of buckets.

    Choose the number so that one bucket of the expected state is a few hundred
    megabytes at most; it cannot change once the table holds rows.
    """

    path: str
    keys: Sequence[str]
    order: Sequence[str]
    buckets: int = 256

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, spark: SparkSession, *parts: str):
        return spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self, spark: SparkSession, *parts: str, done: bool = False) -> list[int]:
        """Versions in a folder; ``done``: only those that were written to the end."""
        files, folder = self._files(spark), self._path(spark, *parts)
        if not files.exists(folder):
            return []
        found = [s.getPath().getName() for s in files.listStatus(folder)]
        found = [n for n in found if n.startswith("version=")]
        if done:
            found = [n for n in found if files.exists(self._path(spark, *parts, n, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in found)

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Version of each bucket in the newest manifest, or in the newest before a version; at most ``buckets`` rows."""
        versions = [v for v in self._numbers(spark, "_manifests", done=True) if before is None or v < before]
        if not versions:
            return {}
        rows = spark.read.schema("bucket int, at long, buckets int").parquet(f"{self.path}/_manifests/version={versions[-1]}").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError(f"the table has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: r["at"] for r in rows}

    def _of(self, spark: SparkSession, current: dict[int, int], schema: T.StructType) -> DataFrame | None:
        paths = [f"{self.path}/bucket={b}/version={v}" for b, v in sorted(current.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, version: int) -> set[int]:
        """Take the rows of one micro-batch in; returns the buckets that were rewritten."""
        spark = batch.sparkSession
        current = self.manifest(spark, version)
        fresh = latest_state(batch, self.keys, self.order).select(batch.columns).persist()
        try:
            touched = {r[0] for r in fresh.select(self.bucket()).distinct().collect()}  # at most ``buckets``
            if not touched:
                return touched
            held = self._of(spark, {b: v for b, v in current.items() if b in touched}, batch.schema)
            merged = fresh if held is None else latest_state(held.unionByName(fresh), self.keys, self.order).select(batch.columns)
            placed = merged.withColumns({"bucket": self.bucket(), "version": F.lit(version)})
            # a bucket is one file, or several if it is large: rows of a bucket meet in one task unless it is split for its size
            placed.hint("rebalance", "bucket").write.partitionBy("bucket", "version").option(
                "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        finally:
            fresh.unpersist()
        now = current | dict.fromkeys(touched, version)
        rows = spark.createDataFrame([(b, v, self.buckets) for b, v in sorted(now.items())], "bucket int, at long, buckets int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifests/version={version}")
        self._drop_old(spark, now, current, touched)
        return touched

    def _drop_old(self, spark: SparkSession, now: dict[int, int], before: dict[int, int], touched: set[int]) -> None:
        files = self._files(spark)
        for bucket in touched:
            for version in self._numbers(spark, f"bucket={bucket}"):
                if version not in (now[bucket], before.get(bucket)):
                    files.delete(self._path(spark, f"bucket={bucket}", f"version={version}"), True)
        for version in self._numbers(spark, "_manifests")[:-2]:
            files.delete(self._path(spark, "_manifests", f"version={version}"), True)

    def read(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        """The newest row of every key."""
        found = self._of(spark, self.manifest(spark), schema)
        return spark.createDataFrame([], schema) if found is None else found

    def lookup(self, keys: DataFrame, schema: T.StructType | str) -> DataFrame:
        """The newest rows of some keys (columns ``keys``), from their buckets only."""
        spark = keys.sparkSession
        wanted = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        found = self._of(spark, {b: v for b, v in self.manifest(spark).items() if b in wanted}, schema)
        found = spark.createDataFrame([], schema) if found is None else found
        return found.join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi")
