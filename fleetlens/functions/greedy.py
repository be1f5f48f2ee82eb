"""Greedy suppression along time, exact and split into bounded groups.

A row is accepted when nothing blocks it; an accepted row blocks its key until
its own ``until`` position.  Refused rows do not renew the block, so neither
``lag`` nor ``dropDuplicates`` gives the answer: it is a fold along the key.

Most rows need no fold: a row that no earlier row's block can reach, and whose
own block ends before the next row, is accepted and blocks nobody.  Those are
settled by an ordered scan (a running maximum of ``until``); only contested rows
go on.  Their fold is cut so that no task sees a whole key:

1. every (key, segment) reports a step function: block in force on entry ->
   block in force on exit.  Only entries that a block of an earlier row can
   reach are listed, and runs with the same exit once;
2. the reports of ``FAN`` neighbouring segments are composed to one step
   function, which again lists only the entries that can be reached;
3. the composed functions are followed per key, then inside every group of
   segments, which gives each segment the block it starts under;
4. every segment replays itself from that block.

Groups in 2 and 3 hold step functions, not rows: their size follows the blocks
that reach into a segment, times ``FAN``.  No bound of the blocks is assumed;
the reach of each segment is taken from the rows before it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.ordered import never_null, ordered_scan

# ship the helpers with the tasks, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 64


def _exits(at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each row: the block in force at the end if that row is accepted first."""
    follower = np.searchsorted(at, until, side="left")
    out = until.copy()
    for i in range(len(at) - 1, -1, -1):
        if follower[i] < len(at):
            out[i] = out[follower[i]]
    return out


def _steps(entries: np.ndarray, exits: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop entries no block can reach and store runs with one exit once."""
    n = min(len(entries), int(np.searchsorted(entries, reach, side="right")) + 1)
    entries, exits = entries[:n], exits[:n]
    last_of_run = np.r_[exits[1:] != exits[:-1], True]
    return entries[last_of_run], exits[last_of_run]


def _follow(entries: np.ndarray, exits: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    at = np.searchsorted(entries, blocked, side="left")
    inside = at < len(entries)
    return np.where(inside, exits[np.minimum(at, len(exits) - 1)], blocked)


def accept_in_order(at: np.ndarray, until: np.ndarray, blocked: int) -> np.ndarray:
    """Accepted rows of sorted positions when the key is blocked up to ``blocked``."""
    keep = np.zeros(len(at), dtype=bool)
    i = int(np.searchsorted(at, blocked, side="left"))
    while i < len(at):
        keep[i] = True
        i = max(i + 1, int(np.searchsorted(at, until[i], side="left")))
    return keep


def _groups(batches: Iterator[pd.DataFrame], on: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Whole groups of sorted batches, as many at a time as a batch completes."""
    parts: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[on]
        new = (keys != keys.shift()).any(axis=1).to_numpy()
        new[0] = tuple(keys.iloc[0]) != last
        last = tuple(keys.iloc[-1])
        done, start = [], 0
        for cut in np.flatnonzero(new):
            if cut > start:
                parts.append(pdf.iloc[start:cut])
            if parts:
                done.append(pd.concat(parts) if len(parts) > 1 else parts[0])
            parts, start = [], cut
        parts.append(pdf.iloc[start:])
        if done:
            yield done
    if parts:
        yield [pd.concat(parts) if len(parts) > 1 else parts[0]]


def _map_groups(
    df: DataFrame, on: list[str], order: list[str], make: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: T.StructType
) -> DataFrame:
    """Like a grouped map, but many small groups share one call, which is far cheaper."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _groups(batches, on):
            yield make(groups)

    return df.repartition(*on).sortWithinPartitions(*on, *order).mapInPandas(run, schema)


def greedy_accept(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    until: str,
    tie: str,
    segment: str,
    scan_segment: str | None = None,
) -> DataFrame:
    """Keep every row and add ``accepted``.

    ``at`` and ``until`` are bigint positions with ``at < until``, however far
    apart; a row at ``until`` or later is free again.  ``tie`` orders rows at
    one position.  Null is a key.  ``segment`` must not decrease along ``at``; neither
    must ``scan_segment``, a finer one for the scan that settles most rows.
    """
    columns = df.columns
    df, keys = never_null(df, keys)
    scanned = ordered_scan(
        df, keys, [at, tie], scan_segment or segment, lead={"__after": at}, running_max_before={"__reach": until}
    )
    alone = F.coalesce(F.col(at) >= F.col("__reach"), F.lit(True)) & F.coalesce(F.col("__after") >= F.col(until), F.lit(True))
    settled = scanned.filter(alone).select(*df.columns, F.lit(True).alias("accepted"))
    contested = scanned.filter(~alone).select(*df.columns, F.coalesce("__reach", F.col(at)).alias("__reach"))
    return settled.unionByName(_fold(contested, keys, at, until, tie, segment)).select(*columns, "accepted")


def _fold(
    df: DataFrame, keys: list[str], at: str, until: str, tie: str, segment: str
) -> DataFrame:
    on = [*keys, segment]
    never = int(np.iinfo(np.int64).min)
    group = "__group"
    key_fields = [T.StructField(c, df.schema[c].dataType) for c in keys]
    segment_field = T.StructField(segment, df.schema[segment].dataType)
    group_field = T.StructField(group, T.LongType())
    step_fields = [
        T.StructField("reach", T.LongType()),
        T.StructField("entries", T.ArrayType(T.LongType())),
        T.StructField("exits", T.ArrayType(T.LongType())),
    ]

    def steps_frame(groups: list[pd.DataFrame], columns: list[str], steps: Callable) -> pd.DataFrame:
        rows = [(*(g[c].iat[0] for c in columns), *steps(g)) for g in groups]
        return pd.DataFrame(rows, columns=[*columns, "reach", "entries", "exits"])

    def report(g: pd.DataFrame):
        pos, end = g[at].to_numpy(np.int64), g[until].to_numpy(np.int64)
        reach = int(g["__reach"].iat[0])
        return reach, *_steps(pos, _exits(pos, end), reach)

    grouped = df.withColumn(group, F.floor(F.col(segment) / F.lit(FAN)).cast("long"))
    reports = _map_groups(
        grouped.select(*on, group, at, until, tie, "__reach"), on, [at, tie],
        lambda groups: steps_frame(groups, [*on, group], report),
        T.StructType([*key_fields, segment_field, group_field, *step_fields]),
    )

    def compose(g: pd.DataFrame):
        reach = int(g["reach"].iat[0])
        entries = exits = np.empty(0, dtype=np.int64)
        for own_entries, own_exits in zip(g["entries"][::-1], g["exits"][::-1]):
            own_entries, own_exits = np.asarray(own_entries), np.asarray(own_exits)
            if len(entries):
                own_exits = _follow(entries, exits, own_exits)
            entries, exits = np.r_[own_entries, entries], np.r_[own_exits, exits]
        return reach, *_steps(entries, exits, reach)

    composed = _map_groups(
        reports, [*keys, group], [segment],
        lambda groups: steps_frame(groups, [*keys, group], compose),
        T.StructType([*key_fields, group_field, *step_fields]),
    )

    def walk(groups: list[pd.DataFrame], by: str, start: Callable) -> pd.DataFrame:
        entry = []
        for g in groups:
            blocked = start(g)
            for entries, exits in zip(g["entries"], g["exits"]):
                entry.append(blocked)
                blocked = int(_follow(np.asarray(entries), np.asarray(exits), np.asarray([blocked]))[0])
        return pd.concat(groups)[[*keys, by]].assign(__blocked=np.asarray(entry, dtype=np.int64))

    blocked_field = T.StructField("__blocked", T.LongType())
    group_entry = _map_groups(
        composed, keys, [group], lambda groups: walk(groups, group, lambda g: never),
        T.StructType([*key_fields, group_field, blocked_field]),
    )
    segment_entry = _map_groups(
        reports.join(group_entry, [*keys, group]), [*keys, group], [segment],
        lambda groups: walk(groups, segment, lambda g: int(g["__blocked"].iat[0])),
        T.StructType([*key_fields, segment_field, blocked_field]),
    )

    def replay(groups: list[pd.DataFrame]) -> pd.DataFrame:
        keep = [
            accept_in_order(g[at].to_numpy(np.int64), g[until].to_numpy(np.int64), int(g["__blocked"].iat[0])) for g in groups
        ]
        return pd.concat(groups).drop(columns=["__blocked", "__reach"]).assign(accepted=np.concatenate(keep))

    return _map_groups(
        df.join(segment_entry, on), on, [at, tie], replay,
        T.StructType([*(f for f in df.schema.fields if f.name != "__reach"), T.StructField("accepted", T.BooleanType())]),
    )
