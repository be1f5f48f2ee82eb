"""Readers of posted JSON lines, text indexes, files and database catalogues, and the table writer.

Every JSON reader keeps the untyped line as a VARIANT next to the typed
columns, so keys that a newer agent adds survive.  Lines that are no JSON have
a null ``raw`` and are left for :func:`fleetlens.operators.intake.quarantine`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.ordered import ordered_scan
from fleetlens.sources import schemas


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def parse_records(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Typed columns of JSON lines, and the line itself as ``raw``."""
    typed = lines.select(F.from_json(column, schema).alias("r"), F.try_parse_json(column).alias("raw"), F.col(column).alias("line"))
    return typed.select("r.*", "raw", "line")


def read_heartbeats(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_records(read_lines(spark, path, stream), schemas.HEARTBEAT)


def explode_results(batches: DataFrame) -> DataFrame:
    """One row per check of ``{server_id, results[]}`` batches."""
    return batches.select("server_id", F.inline("results"))


def read_check_results(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return explode_results(parse_records(read_lines(spark, path, stream), schemas.CHECK_BATCH))


def read_discovery(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_records(read_lines(spark, path, stream), schemas.DISCOVERY)


def read_remediation_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_records(read_lines(spark, path, stream), schemas.REMEDIATION_LOG)


def read_ops_result(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_records(read_lines(spark, path, stream), schemas.OPS_RESULT)


def read_audit_result(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_records(read_lines(spark, path, stream), schemas.AUDIT_RESULT)


def read_command_result(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_records(read_lines(spark, path, stream), schemas.COMMAND_RESULT)


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of package index files, one row each, numbered from 1 inside their file.

    A file is read in splits.  Each split numbers its own blocks, and the
    counts of the splits before it are added, so the numbers do not depend on
    where a file is cut.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(
        F.col("_metadata.file_path").alias("index_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"),
        F.ltrim(F.col("value"), F.lit("\n")).alias("stanza"),
    ).filter("stanza <> ''")
    numbered = ordered_scan(blocks, ["index_id"], ["block_start", "place"], "block_start", row_number="stanza_no")
    return numbered.select("index_id", "stanza_no", "stanza")


def file_manifest(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Relative path, size, time in whole seconds and sha256 of every file below a path.

    Object stores and Spark's file source know no mode bits, directories or
    links, so those columns of a host manifest are missing here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = (root or path).rstrip("/") + "/"
    after = F.locate(base, F.col("path")) + len(base)
    return files.select(
        F.substring("path", after, F.length("path")).alias("path"),
        F.lit("file").alias("type"),
        F.col("length").alias("size"),
        F.date_trunc("second", "modificationTime").alias("modified_at"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"),
    )


def read_catalogue(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Result of a catalogue query over JDBC; the database runs its filters and projections."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def write_table(df: DataFrame, path: str, partition_cols: Sequence[str] = (), mode: str = "append") -> None:
    """Append to a parquet table, partitioned by a few low-cardinality columns.

    Rows are spread over the partitions by AQE's rebalance, so a large day is
    written by several tasks and a small one by a single task.
    """
    spread = df.hint("rebalance", *partition_cols) if partition_cols else df
    writer = spread.write.mode(mode)
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
