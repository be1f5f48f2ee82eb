"""Helpers that several operators share: null-safe inputs, shared folders, salted joins, following ids."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (driver and executors are one process) gets a folder under /tmp; a cluster raises,
    because its machines would not see each other's files.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file:///tmp/fleetlens-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Spark's own option to drop the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries within, each of which runs once and writes its result, leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage: written to the shared folder and read back."""
    return stored(df, "settled")


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in ``column``: one scan, one number to the driver."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def salted_lookup(df: DataFrame, table: DataFrame, key: str, salt_of: str, salts: int = 16) -> DataFrame:
    """Left join of ``df`` with a table of one row per key, where one key may hold a third of ``df``.

    Rows of a key are spread by ``salt_of`` over ``salts`` groups and the table's row is repeated for each of them.
    """
    left = df.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


#: A key is common if it has more than one in COMMON rows; there are fewer such keys than COMMON.
COMMON = 1000


def counted_lookup(df: DataFrame, table: DataFrame, key: str, rows: str) -> DataFrame:
    """Left join, nulls equal, of ``df`` with a table of one row per key that also counts the key's rows in ``df``.

    Common keys, of which there are fewer than COMMON, are broadcast, so that none of their rows moves; the others, each
    with at most one in COMMON rows, are joined by shuffles.
    """
    total = table.agg(F.sum(rows)).first()[0] or 0
    common = F.col(rows) * COMMON > F.lit(total)
    asked, new = df.withColumnRenamed(key, "_key"), [c for c in table.columns if c not in (key, rows)]
    same = F.col("_key").eqNullSafe(F.col(key))
    hot = asked.join(F.broadcast(table.where(common)), same)
    cold = asked.join(F.broadcast(table.where(common).select(key)), same, "left_anti").join(table.where(~common), same, "left")
    columns = [F.col("_key").alias(key) if c == key else F.col(c) for c in df.columns] + [F.col(c) for c in new]
    return hot.select(*columns).unionByName(cold.select(*columns))


#: Longs of the table that ``maybe_in`` broadcasts, whatever the size of its inputs.
FILTER_LONGS = 1 << 18


def maybe_in(df: DataFrame, column: str, some: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``some``'s ``key`` (nulls too): none of those is lost, few others stay.

    A one-hash Bloom filter of 64 * FILTER_LONGS bits, broadcast as at most FILTER_LONGS rows. It makes a shuffle join that
    follows cheaper and never changes its result; with very many keys it lets more and more through.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * FILTER_LONGS))
    bits = some.select(place(key).alias("_p")).groupBy(F.expr("_p div 64").alias("_long")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits"))
    placed = df.withColumn("_p", place(column)).withColumn("_long", F.expr("_p div 64"))
    found = placed.join(F.broadcast(bits), "_long").where(F.expr("getbit(_bits, cast(_p % 64 as int)) = 1"))
    return found.select(*df.columns)


def following(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """(column, following): the next larger distinct id, null for the largest.

    Ids are cut into ranges of 2**12, 2**24, ... values; within a range a window finds the next id, and the last id of a
    range takes the first of the next range, found the same way one level up. No task gets more than 4096 rows of a range.
    """
    ids = ids.select(F.col(column).cast("long").alias("_id")).where("_id is not null").distinct()

    def level(rows: DataFrame, bits: int) -> DataFrame:
        cut = rows.withColumn("_r", F.shiftright("_id", bits))
        inner = cut.selectExpr("_id", "_r", "lead(_id) over (partition by _r order by _id) as _next")
        if bits >= 60:  # at most 16 ranges are left
            heads = cut.groupBy("_r").agg(F.min("_id").alias("_head"))
            later = heads.selectExpr("_r", "lead(_head) over (order by _r) as _later")
        else:
            heads = cut.groupBy("_r").agg(F.min("_id").alias("_head"))
            up = level(heads.select(F.col("_head").alias("_id")), bits + 12)
            later = heads.join(up.selectExpr("_id as _head", "_next as _later"), "_head", "left").select("_r", "_later")
        last = inner.where("_next is null").join(later, "_r", "left").selectExpr("_id", "_later as _next")
        return inner.where("_next is not null").select("_id", "_next").unionByName(last)

    return level(ids, 12).select(F.col("_id").alias(column), F.col("_next").alias("following"))


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder, in folders of ``by`` if given, and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
