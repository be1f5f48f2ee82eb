"""Vector codes: each part of an integer vector becomes the index of its nearest codebook entry.

Codebooks start as the parts of the first kept vectors and are moved to the mean of the parts that choose them. Every task
asks a GNAT over the entries (``gnat``) and adds up its own parts by entry, so that one row for each entry and component
of a task is shuffled and the driver gets one codebook, whose size is fixed, whatever the number of vectors. All sums and
distances are whole numbers, so partitions and repeated tasks cannot change the result.

Rows whose vector is null or holds a null, NaN or an infinity are left out. Vectors shorter than the longest, or a number
of components that the parts do not divide, count as padded with zeros. Rows with one key each count; among the first
vectors, equal keys are ordered by vector, and a null key comes last. Equal labels, nulls together, are one group. A
table without usable rows gives no rows. An error beyond a 64-bit integer raises. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.gnat import Gnat, largest
from fleetlens.llm.shared import counted_lookup, stored
from fleetlens.llm.vectors import finite, matrix, width

_HEX = np.array([f"{i:02x}" for i in range(256)], dtype=object)


@dataclass
class Codebooks:
    """parts: one integer array (entries x components) for each part of a vector."""

    parts: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(p.shape[1] for p in self.parts)

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for p in self.parts for x in p.ravel()).encode()).hexdigest()

    def cut(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum([p.shape[1] for p in self.parts])[:-1], axis=1)


def integers(df: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """(key, label, values): components as floor(scale * x) of the rows whose vector can be coded."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    columns = [F.col(key).alias("key"), (F.col(label) if label else F.lit(None).cast("int")).alias("label")]
    return df.where(finite(vector)).select(*columns, whole.alias("values"))


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest keys; at most ``entries`` rows reach the driver."""
    columns = width(rows, "values", parts)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "values").limit(entries).select("values").toArrow()
    return Codebooks(np.split(matrix(first.column("values"), columns).astype(np.int64), parts, axis=1))


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floor of the mean of the parts that choose it; an entry that none chooses stays."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(p) for p in books.parts]
        sums = [np.zeros(p.shape, object) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        for batch in batches:
            for tree, sums_of, count, values in zip(trees, sums, counts, books.cut(matrix(batch.column(0), books.width)), strict=True):
                entry = tree.nearest(values)[0]
                count += np.bincount(entry, minlength=len(count))
                order = np.argsort(entry, kind="stable")
                used, start = np.unique(entry[order], return_index=True)
                if len(used):
                    exact = largest(values) * len(values) < 2**63
                    added = np.add.reduceat(values[order] if exact else values[order].astype(object), start, axis=0)
                    sums_of[used] += added.astype(object)
        for part, (s, c) in enumerate(zip(sums, counts, strict=True)):
            for entry in np.flatnonzero(c):
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * s.shape[1], pa.int32()), "entry": pa.array([int(entry)] * s.shape[1], pa.int32()),
                    "at": pa.array(range(s.shape[1]), pa.int32()), "n": pa.array([int(c[entry])] * s.shape[1], pa.int64()),
                    "s": pa.array([Decimal(int(x)) for x in s[entry]], pa.decimal128(38, 0))})

    shape = "part int, entry int, at int, n long, s decimal(38,0)"
    added = rows.select("values").mapInArrow(_gathered(task), shape).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [p.copy() for p in books.parts]
    for row in added.toArrow().to_pylist():  # entries x components at most
        new[row["part"]][row["entry"], row["at"]] = int(row["s"]) // row["n"]
    return Codebooks(new)


def _gathered(task: Callable) -> Callable:
    """The same task with its output in a few large batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = list(task(batches))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def fitted(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks after ``rounds`` rounds of assigning all rows of ``integers`` and moving the entries."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if len(books.parts[0]) else 0):
        books = _moved(rows, books)
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(key, label, code, error): two hex digits for each part, and the squared distance to what they stand for."""
    schema = pa.schema([("code", pa.string()), ("error", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(p) for p in books.parts]
        for batch in batches:
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, object)
            for tree, values in zip(trees, books.cut(matrix(batch.column(2), books.width)), strict=True):
                entry, gap = tree.nearest(values)
                code = code + _HEX[entry]
                error = error + np.array([int(g) for g in gap], object)
            found = [pa.array(code, schema.field(0).type), pa.array(error, schema.field(1).type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["key", "label", "code", "error"])

    kind = dict(rows.dtypes)
    if not len(books.parts[0]):
        return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return rows.mapInArrow(task, f"key {kind['key']}, label {kind['label']}, code string, error long")


def decoded(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` and ``values``: the entries that a code stands for, one after another."""
    tables = [F.lit([[int(x) for x in e] for e in p]) for p in books.parts]
    entry = lambda k: F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("values", F.concat(*(F.element_at(t, entry(k)) for k, t in enumerate(tables))))


def compressed(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256,
    rounds: int = 4, scale: int = 1024,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row whose vector can be coded."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = integers(df, key, vector, label, scale)
    books = fitted(rows, parts, entries, rounds)
    found = stored(encoded(rows, books), "vector-codes")
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    out = counted_lookup(found, totals, "label", "rows")
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
