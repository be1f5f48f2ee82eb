"""Ordered scans that stay parallel when one key holds much of the data.

A plain ``lag``/running window puts all rows of a key into one task.  Here the
rows of a key are cut into segments of the leading order column (an hour, a
block of offsets).  Each (key, segment) is windowed on its own, and a small
per-segment summary carries the state over the segment borders:

    rows     --hash(keys, segment)--> window inside the segment --+
    summary  --partial agg, hash(keys)--> window over segments ---+--> join

The rows are shuffled once, on (keys, segment); the join reuses that
partitioning.  Only the summaries, one row per key and non-empty segment, are
ever grouped by the key alone.

The segment column must not decrease along ``order``.  Null is a key like any
other, as in a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A value of each type to stand for null, beside a flag that tells the two apart.
_PLAIN = {
    T.StringType: "", T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0, T.FloatType: 0.0, T.DoubleType: 0.0, T.DecimalType: 0, T.BooleanType: False,
}


def never_null(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that are equal exactly where the keys are, nulls being equal, and that are never null; their names.

    Joins on them keep the partitioning that windows and aggregates have, which
    null-safe joins on the keys themselves do not.  Keys that cannot be null
    stand for themselves.
    """
    nullable = [k for k in keys if df.schema[k].nullable]
    if not nullable:
        return df, list(keys)
    names, new, flags = [], {}, F.lit(0)
    for i, k in enumerate(keys):
        if k not in nullable:
            names.append(k)
            continue
        kind = df.schema[k].dataType
        plain = _PLAIN.get(type(kind))
        new[f"__key_{k}"] = F.struct(k) if plain is None else F.coalesce(F.col(k), F.lit(plain).cast(kind))
        names.append(f"__key_{k}")
        if plain is not None:
            flags = flags + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(0)
    return df.withColumns(new | {"__nulls": flags}), [*names, "__nulls"]


def time_segment(ts: str, seconds: int = 3_600) -> Column:
    """Segment number of a timestamp column."""
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds))


def number_segment(col: str, width: int) -> Column:
    return F.floor(F.col(col) / F.lit(width))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    *,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running_sum: Mapping[str, str] | None = None,
    running_max_before: Mapping[str, str] | None = None,
    last_value: Mapping[str, str] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Add scan columns, given as ``{new column: source column}``.

    ``lag``                previous row's value
    ``lead``               next row's value
    ``running_sum``        sum up to and including the row
    ``running_max_before`` maximum over the rows before the row
    ``last_value``         last non-null value up to and including the row
    ``row_number``         1-based position of the row within its key
    """
    columns = df.columns
    df, keys = never_null(df, keys)
    lag, lead, running_sum = dict(lag or {}), dict(lead or {}), dict(running_sum or {})
    running_max_before, last_value = dict(running_max_before or {}), dict(last_value or {})
    position = F.struct(*order)

    inside = Window.partitionBy(*keys, segment).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    over_segments = Window.partitionBy(*keys).orderBy(segment)
    earlier = over_segments.rowsBetween(Window.unboundedPreceding, -1)

    summary, carry, local, final = [], {}, {}, {}
    for wanted, tag, edge, step in ((lag, "lag", F.max_by, F.lag), (lead, "lead", F.min_by, F.lead)):
        if not wanted:
            continue
        # the last (first) row of a segment is what the next (previous) segment sees
        sources = sorted(set(wanted.values()))
        summary.append(edge(F.struct(*sources), position).alias(f"__s_{tag}"))
        carry[f"__c_{tag}"] = step(f"__s_{tag}").over(over_segments)
        local[f"__l_{tag}"] = step(F.struct(*sources)).over(inside)
        for new, src in wanted.items():
            final[new] = F.when(F.col(f"__l_{tag}").isNotNull(), F.col(f"__l_{tag}.{src}")).otherwise(
                F.col(f"__c_{tag}.{src}")
            )
    for new, src in running_sum.items():
        summary.append(F.sum(src).alias(f"__s_{new}"))
        carry[f"__c_{new}"] = F.sum(f"__s_{new}").over(earlier)
        local[f"__l_{new}"] = F.sum(src).over(upto)
        final[new] = F.coalesce(F.col(f"__l_{new}"), F.lit(0)) + F.coalesce(
            F.col(f"__c_{new}"), F.lit(0)
        )
    for new, src in running_max_before.items():
        summary.append(F.max(src).alias(f"__s_{new}"))
        carry[f"__c_{new}"] = F.max(f"__s_{new}").over(earlier)
        local[f"__l_{new}"] = F.max(src).over(before)
        final[new] = F.greatest(f"__l_{new}", f"__c_{new}")
    for new, src in last_value.items():
        known = F.when(F.col(src).isNotNull(), position)
        summary.append(F.max_by(F.col(src), known).alias(f"__s_{new}"))
        carry[f"__c_{new}"] = F.last(f"__s_{new}", ignorenulls=True).over(earlier)
        local[f"__l_{new}"] = F.last(src, ignorenulls=True).over(upto)
        final[new] = F.coalesce(f"__l_{new}", f"__c_{new}")
    if row_number:
        summary.append(F.count(F.lit(1)).alias("__s_rn"))
        carry["__c_rn"] = F.sum("__s_rn").over(earlier)
        local["__l_rn"] = F.row_number().over(inside)
        final[row_number] = F.col("__l_rn") + F.coalesce(F.col("__c_rn"), F.lit(0))

    on = [*keys, segment]
    carried = df.groupBy(*on).agg(*summary).withColumns(carry).select(*on, *carry)
    scanned = df.withColumns(local).join(carried, on, "left")
    return scanned.select(*columns, *[expr.alias(name) for name, expr in final.items()])
