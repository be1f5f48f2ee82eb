"""Streaming operators and sinks that need no custom state."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.changes import polls_in_fences
from fleetlens.streaming.stateful import ROCKSDB
from fleetlens.streaming.tables import LatestTable


def checkpoint_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """Checkpoint location of a stream: below the folder the cluster names, else the given one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not shared:
        raise ValueError("no shared checkpoint folder: set spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}"


def land_once_stream(
    df: DataFrame, path: str, checkpoint: str, run_id: str = "run_id", trigger: dict | None = None,
) -> StreamingQuery:
    """Append the first row of every run id to a table.

    Which ids were seen is kept in the RocksDB state store, which finds an id
    without reading the others: a micro-batch reads and writes in proportion to
    its own rows, however many were landed before, and changelog checkpoints
    save only what changed.  Each stream writes into its own ``writer`` folder,
    named after its checkpoint; ids that other writers had landed when it was
    started are left out by a join, with a table that does not grow with this
    stream.  A repeated micro-batch writes into the same ``batch`` partition and
    so changes nothing.  A null id is an id.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    writer = "w" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:15]
    landed = _read(spark, path)
    others = None if landed is None else landed.filter(F.col("writer") != writer).select(F.col(run_id).alias("_landed"))
    if others is not None and others.isEmpty():
        others = None

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if others is None else batch.join(others, F.col(run_id).eqNullSafe(F.col("_landed")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch_id}")

    return df.dropDuplicates([run_id]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def latest_state_stream(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = 256, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the newest row per key in a bucketed table (:class:`~fleetlens.streaming.tables.LatestTable`), which reads it, too."""
    table = LatestTable(path, tuple(keys), tuple(order), buckets)
    return df.writeStream.foreachBatch(lambda batch, batch_id: (table.merge(batch, batch_id), None)[1]).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None


def telemetry_windows(df: DataFrame, value: str, ts: str = "seen_at", grain: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count, sum and maximum per host and window, emitted once the window is over."""
    return (
        df.withWatermark(ts, delay)
        .groupBy("host_id", F.window(ts, grain).alias("w"))
        .agg(F.count(value).alias("samples"), F.sum(value).alias("total"), F.max(value).alias("top"))
        .select("host_id", F.col("w.start").alias("window_start"), "samples", "total", "top")
    )


def fence_polls(states: DataFrame, fences: DataFrame, poll: str = "10 minutes", delay: str = "10 minutes", bucket_seconds: int = 3_600) -> DataFrame:
    """One row per fence and poll window in which a fenced service ran or was unreadable.

    ``states`` is the stream, ``fences`` a table; both as in the batch form.
    """
    polls = states.withWatermark("at", delay).filter("running OR running IS NULL")
    hits = polls_in_fences(fences, polls, bucket_seconds)
    return (
        hits.groupBy("fence_id", F.window("at", poll).alias("w"))
        .agg(F.bool_or(F.col("running").isNull()).alias("unreadable"))
        .select("fence_id", F.col("w.start").alias("poll_start"), "unreadable")
    )
