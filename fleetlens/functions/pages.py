"""Pages of ordered lists under a row and a byte limit, with no list whole in any task.

A page takes as many of the next rows as both limits allow, at least one.  Where
a page starts depends on all pages before it, so a list that is longer than a
task is not simply cut.  Rows are dealt to sorted ranges.  Lists inside one
range are paged as they pass by.  For a list that goes on over a border, a range
cannot know where its first page starts; it reports all possibilities, which
are few, because an open page reaches only ``width`` rows into it:

* ``exits``, ``pages``: for a first page start at row 0, 1, ... ``width`` of
  the range, how many rows its last page holds and how many pages it starts;
* ``head``, ``tail``: bytes of its first and last 1, 2, ... ``width`` rows, by
  which an open page is continued.

Such reports compose: two neighbouring ones make the report of both.  They are
composed in groups of ``FAN``, followed from group to group, and then inside
every group, which tells each range the page it continues.  Reports have a fixed
size, and there are at most two for each range, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.functions.folders import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 64


@dataclass(frozen=True)
class Limits:
    """rows and bytes of a page; a row costs its size and a separator."""

    rows: int
    bytes: int

    def room(self, overhead: int) -> int:
        return self.bytes - overhead + 1

    def width(self, overhead: int) -> int:
        """Rows of the longest page."""
        return max(1, min(self.rows, self.room(overhead)))

    def follow(self, upto: np.ndarray, start: int, room: int) -> int:
        """First row after a page that starts at row ``start``; ``upto``: bytes up to and with each row."""
        used = int(upto[start - 1]) if start else 0
        return max(start + 1, min(start + self.rows, int(np.searchsorted(upto, used + room, side="right"))))

    def more(self, upto: np.ndarray, rows: int, used: int, room: int) -> int:
        """How many of the rows whose bytes ``upto`` tells an open page of ``rows`` rows still takes."""
        return min(self.rows - rows, int(np.searchsorted(upto, room - used, side="right")), len(upto))


@dataclass
class Report:
    """What a stretch of a list does to the page that is open before it."""

    overhead: int
    n: int
    head: np.ndarray
    tail: np.ndarray
    exits: np.ndarray
    pages: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, overhead: int, limits: Limits) -> Report:
        room, width, n = limits.room(overhead), limits.width(overhead), len(sizes)
        upto = np.cumsum(sizes)
        after = np.minimum(np.searchsorted(upto, np.r_[0, upto[:-1]] + room, side="right"), np.arange(n) + limits.rows)
        after = np.maximum(after, np.arange(n) + 1).tolist()
        exits, pages = list(range(n, 0, -1)), [1] * n  # of a page start at each row; a page that reaches the end stays open
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                exits[i], pages[i] = exits[after[i]], pages[after[i]] + 1
        keep = min(width + 1, n)
        tail = upto[-1] - np.r_[0, upto][n - 1 :: -1][:width]
        return cls(overhead, n, upto[:width], tail, np.array(exits[:keep], np.int64), np.array(pages[:keep], np.int64))

    def leave(self, rows: int, used: int, limits: Limits) -> tuple[int, int, int]:
        """(rows, bytes) of the open page at the end, and pages started, after (rows, bytes) before; no rows: none is open."""
        start = limits.more(self.head, rows, used, limits.room(self.overhead)) if rows else 0
        if start == self.n:
            return rows + self.n, used + int(self.head[-1]), 0
        out = int(self.exits[start])
        return out, int(self.tail[out - 1]), int(self.pages[start])

    def then(self, other: Report, limits: Limits) -> Report:
        """The report of both stretches, one after the other."""
        width = limits.width(self.overhead)
        n = self.n + other.n
        head, tail = self.head, other.tail
        if self.n < width:
            head = np.r_[head, head[-1] + other.head][:width]
        if other.n < width:
            tail = np.r_[tail, tail[-1] + self.tail][:width]
        exits, pages = [], []
        for j in range(min(width + 1, n)):
            if j < self.n:
                out, started = int(self.exits[j]), int(self.pages[j])
                out, _, more = other.leave(out, int(self.tail[out - 1]), limits)
                exits.append(out)
                pages.append(started + more)
            else:
                exits.append(int(other.exits[j - self.n]))
                pages.append(int(other.pages[j - self.n]))
        return Report(self.overhead, n, head, tail, np.array(exits, np.int64), np.array(pages, np.int64))


_REPORT = [T.StructField(c, T.LongType()) for c in ("overhead", "n")] + [
    T.StructField(c, T.ArrayType(T.LongType())) for c in ("head", "tail", "exits", "pages")]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """(key, whether it begins here, rows) for each stretch of equal keys of each batch of a sorted task."""
    last, some = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            value = column[a].as_py()
            yield value, not (some and value == last), batch.slice(a, b - a)
            last, some = value, True


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def cut_pages(df: DataFrame, key: str, order: Sequence[str], size: str, overhead: str, limits: Limits) -> DataFrame:
    """``df`` with ``page``, the number from 0 of each row's page in its list.

    ``key`` names the list (null is one), ``order`` its order (ties go by
    size), ``size`` the bytes of a row, ``overhead`` those of a page without
    rows, one value for a list.  A row too large for any page has one for itself.
    """
    ranges = df.repartitionByRange(key, *order, size).sortWithinPartitions(key, *order, size)
    ranges = checkpointed(ranges.withColumn("_range", F.spark_partition_id()))
    key_field = T.StructField(key, df.schema[key].dataType)
    report_schema = T.StructType([key_field, T.StructField("_range", T.IntegerType()), *_REPORT])
    arrow_schema = to_arrow_schema(report_schema)

    def reports_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first, found, now = True, [], None

        def end() -> None:
            report = Report.of(np.concatenate(held), now[2], limits)
            found.append((now[0], now[1], report.overhead, report.n, *(a.tolist() for a in (report.head, report.tail, report.exits, report.pages))))

        for value, begins, rows in _runs(batches, key):
            if begins:
                if now and first:
                    end()  # the first list may come from the range before
                    first = False
                held, now = [], (value, rows.column("_range")[0].as_py(), rows.column(overhead)[0].as_py())
            held.append(_numbers(rows, size) + 1)
        if now:
            end()  # the last one may go on in the next range
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow_schema)], schema=arrow_schema)

    reports = checkpointed(ranges.select(key, "_range", size, overhead).mapInArrow(reports_of, report_schema))
    reports = reports.withColumn("_group", F.floor(F.col("_range") / FAN).cast("int"))

    def unpacked(pdf: pd.DataFrame, by: str) -> list[Report]:
        pdf.sort_values(by, inplace=True)
        return [Report(r.overhead, r.n, *(np.asarray(a, np.int64) for a in (r.head, r.tail, r.exits, r.pages))) for r in pdf.itertuples()]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, *rest = unpacked(pdf, "_range")
        for report in rest:
            whole = whole.then(report, limits)
        return pdf[[key, "_group"]].head(1).assign(
            overhead=whole.overhead, n=whole.n, **{c: [getattr(whole, c).tolist()] for c in ("head", "tail", "exits", "pages")})

    state = [T.StructField(c, T.LongType()) for c in ("_rows", "_used", "_page")]

    def walk(pdf: pd.DataFrame, by: str, at: tuple[int, int, int]) -> pd.DataFrame:
        before = []
        for report in unpacked(pdf, by):
            before.append(at)
            rows, used, started = report.leave(at[0], at[1], limits)
            at = rows, used, at[2] + started
        return pdf[[key, by]].assign(**{f.name: [b[i] for b in before] for i, f in enumerate(state)})

    over = reports.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))  # lists that cross a border
    crossing = reports.join(over, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    composed = crossing.groupBy(key, "_group").applyInPandas(
        compose, T.StructType([key_field, T.StructField("_group", T.IntegerType()), *_REPORT]))
    groups = composed.groupBy(key).applyInPandas(
        lambda pdf: walk(pdf, "_group", (0, 0, 0)), T.StructType([key_field, T.StructField("_group", T.IntegerType()), *state]))
    groups = groups.select(F.col(key).alias("_key"), F.col("_group").alias("_of"), *(f.name for f in state))
    within = crossing.join(groups, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_group") == F.col("_of")))
    entries = within.groupBy(key, "_group").applyInPandas(
        lambda pdf: walk(pdf, "_range", tuple(int(pdf[f.name].iat[0]) for f in state)),
        T.StructType([key_field, T.StructField("_range", T.IntegerType()), *state]))
    # at most one list goes on into each range: as many rows as there are partitions
    opened = {r["_range"]: (r["_rows"], r["_used"], r["_page"]) for r in entries.where("_rows > 0").drop(key).collect()}
    sent = df.sparkSession.sparkContext.broadcast(opened)
    out_schema = T.StructType([*df.schema.fields, T.StructField("page", T.IntegerType())])
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, used, page, room = True, 0, 0, 0, 0
        for _, begins, part in _runs(batches, key):
            if begins:
                entry = sent.value.get(part.column("_range")[0].as_py()) if first else None
                rows, used, page = entry or (0, 0, 0)
                first, room = False, limits.room(part.column(overhead)[0].as_py())
            sizes = _numbers(part, size) + 1
            upto, pages = np.cumsum(sizes), np.empty(len(sizes), np.int32)
            at = limits.more(upto, rows, used, room) if rows else 0
            pages[:at] = page - 1
            rows, used = rows + at, used + (int(upto[at - 1]) if at else 0)
            while at < len(sizes):
                end = min(limits.follow(upto, at, room), len(sizes))
                pages[at:end] = page
                rows, used = end - at, int(upto[end - 1] - (upto[at - 1] if at else 0))
                at, page = end, page + 1
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(pages)], [*names, "page"])

    return ranges.mapInArrow(number, out_schema)
