"""Rows dealt to tasks: joins of many rows to one small row per key, safe when one key is very common, and costly rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is common if it has more than one in SHARES rows, so fewer keys than that are; a slice of it gets about one share.
SHARES = 1_000
#: Keys that the sketch tracks; its error is about one in so many rows.
TRACKED = 8 * SHARES


def _name(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the shuffle partitions, for costly work on each row of a table that few files or row groups hold."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def common_keys(df: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Number of slices for each common key (by hash), from a sketch of fixed size that is merged over the tasks.

    The counts are estimates.  They decide how rows are dealt out, never a
    result.
    """
    found = df.select(_name(keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {SHARES}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    total = found["n"]
    return {r["item"]: -(-r["count"] * SHARES // total) for r in found["top"] or [] if r["count"] * SHARES > total}


def spread_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", counted: DataFrame | None = None
) -> DataFrame:
    """Join ``many`` to ``one`` (at most one narrow row per key), common keys cut into as many slices as their rows need.

    Which keys are common is counted first, over ``counted`` (rows that hold
    the keys about as often as ``many``, which is the default).  The rows of
    such a key are dealt to its slices by a hash of ``by``, and its row of
    ``one`` is repeated for each of them; the row of any other key is not.  A
    following aggregation on the keys then starts inside the slices, where
    AQE's skew join would not act, because the join output already has the
    partitioning that the aggregation asks for.
    """
    slices = common_keys(many if counted is None else counted, keys)
    # fewer than SHARES rows
    table = many.sparkSession.createDataFrame(sorted(slices.items()), "__key long, __slices int")

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("__key", _name(keys)).join(F.broadcast(table), "__key", "left")

    left = named(many).withColumn("__slice", F.coalesce(F.pmod(F.xxhash64(*by), "__slices"), F.lit(0)).cast("int"))
    right = named(one).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1)))
    return left.drop("__key", "__slices").join(right.drop("__key", "__slices"), [*keys, "__slice"], how).drop("__slice")
