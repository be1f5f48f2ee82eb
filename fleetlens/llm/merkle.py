"""Merkle manifest of a table: a hash tree for each group of rows and one over the groups, kept as postorder append logs.

Leaves of a tree are numbered from 0 in order. While more than one node remains, every FAN_OUT consecutive ones (the last
run may be shorter, even one) become their hash. A log holds the nodes of a tree in the order in which they are complete:
a leaf, and after the last leaf below a node that node. A node's place in the log therefore follows from the sizes of
the subtrees before it (``leaf_position``, ``position``) and needs no stored link.

Builders are aligned: each gets a whole block of FAN_OUT**LEVELS leaves (or nodes, one storey up), so that its nodes are a
contiguous piece of the log, and hands on one node. A storey has a FAN_OUT**LEVELS-th of the nodes of the one below. A
proof reads the piece of its own block and, from the storeys above, the few nodes that ``position`` names; these are
the same for all rows of a block and are joined once for each block. Texts are hashed where they are read and never move;
one group may hold any share of the rows, because leaves are numbered by ranges and dealt by blocks.

Rows are ordered within their group by key (null first), then by leaf and altered leaf, so that repeated rows are leaves of
their own. A null group is a group. An empty table gives no rows. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.shared import ascii_lower, stored

BITS = 4
FAN_OUT = 1 << BITS
LEVELS = 3  # of a builder
BLOCK = BITS * LEVELS


def field(column: Column | str) -> Column:
    """One column's part of a leaf: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column | str]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    return 0 if leaves <= 1 else -(-(leaves - 1).bit_length() // BITS)


def leaf_position(i: int) -> int:
    """Place in the log of leaf ``i``: the leaves before it and the nodes that these completed."""
    at, nodes = i, i
    while nodes:
        nodes >>= BITS
        at += nodes
    return at


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of a node: its last leaf comes first, then the nodes which that completes, level by level."""
    return leaf_position(min((index + 1) << (BITS * level), leaves) - 1) + level


def run_of(level: int, index: int, leaves: int) -> list[int]:
    """Places of all nodes of the run of node ``index``, left to right; its own is at ``index`` modulo FAN_OUT."""
    first, nodes = index >> BITS << BITS, -(-leaves >> (BITS * level))
    return [position(level, k, leaves) for k in range(first, min(first + FAN_OUT, nodes))]


# numbering


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``leaf_no`` (from 0 within ``tree`` by ``order``, nulls first) and ``leaves`` (rows of the tree).

    Ranges of (tree, order) are sorted apart; each counts its own rows, and the counts of the ranges before it, one small
    row for each range and tree, are added.
    """
    fields, at = rows.columns, rows.columns.index(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            trees, numbers = batch.column(at).to_pylist(), []
            for t in trees:
                now, n = (t, 0) if t != now else (now, n + 1)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "_local"])

    ranges = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ranges = ranges.withColumn("_range", F.spark_partition_id())
    schema = f"{', '.join(f'`{n}` {t}' for n, t in ranges.dtypes)}, _local long"
    ranges = stored(ranges.mapInArrow(count, schema), "merkle-ranges")  # the ranges must not change between the two reads
    sizes = ranges.groupBy(tree, "_range").agg((F.max("_local") + 1).alias("_n"))
    sizes = sizes.selectExpr(
        f"`{tree}`", "_range", f"coalesce(sum(_n) over (partition by `{tree}` order by _range rows between unbounded preceding and 1 preceding), 0) as _before",
        f"sum(_n) over (partition by `{tree}`) as leaves")
    return ranges.join(sizes, [tree, "_range"]).select(*fields, F.expr("_before + _local").alias("leaf_no"), "leaves")


# the log


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each key (the first ``keys`` columns) of a sorted task, which may run over several batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, unit in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(unit)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_LOG = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("storey", pa.int32()), ("position", pa.int64()), ("level", pa.int32()),
                  ("node", pa.int64()), ("leaves", pa.int64()), ("digest", pa.string())])
_LOG_DDL = "tree string, block long, storey int, position long, level int, node long, leaves long, digest string"


def _builder(storey: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    base = storey * LEVELS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, block), unit in _units(batches, 2):
            leaves = unit[0][3]
            top = min(LEVELS, height(leaves) - base)
            count = -(-leaves >> (BITS * base))  # nodes of the lowest level here
            open_runs: list[list[str]] = [[] for _ in range(top + 1)]
            for _, _, node, _, value in unit:
                if not base:
                    yield tree, block, storey, leaf_position(node), 0, node, leaves, value
                level, index, value = 0, node, value
                while level < top:
                    open_runs[level].append(value)
                    last = node == count - 1
                    if len(open_runs[level]) < FAN_OUT and not last:
                        break
                    value, open_runs[level] = digest(open_runs[level]), []
                    level, index = level + 1, index >> BITS
                    yield tree, block, storey, position(base + level, index, leaves), base + level, index, leaves, value

    return lambda batches: _batched(rows(batches), _LOG)


def built(leaves: DataFrame, most: int) -> DataFrame:
    """The postorder log of each tree: (tree, block, storey, position, level, node, leaves, digest).

    ``leaves`` holds tree, leaf_no, leaves and digest; ``most`` is the size of the largest tree. Each storey writes its
    pieces of the log to the shared folder.
    """
    log, below, storey = None, leaves.selectExpr("tree", "leaf_no as node", "leaves", "digest"), 0
    while True:
        blocks = below.select("tree", F.shiftright("node", BLOCK).alias("block"), "node", "leaves", "digest")
        blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "node")
        piece = stored(blocks.mapInArrow(_builder(storey), _LOG_DDL), "merkle-log")
        log = piece if log is None else log.unionByName(piece)
        storey += 1
        if height(most) <= storey * LEVELS:
            return log
        below = piece.where((F.col("level") == storey * LEVELS) & (F.col("leaves") > 1 << (BLOCK * storey))).select("tree", "node", "leaves", "digest")


def roots(log: DataFrame) -> DataFrame:
    """(tree, root): the last node of each log."""
    return log.where("node = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("root"))


# proofs

_PATH = "array<struct<level: int, own: int, run: array<string>>>"


def _named(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each (tree, block, leaf, leaves): places of the runs that the leaf's ancestors from level ``base`` up stand in."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("at", pa.int32()), ("own", pa.int32()),
                        ("position", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for tree, block, node, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for level in range(base, height(leaves)):
                    index = node >> (BITS * level)
                    for at, place in enumerate(run_of(level, index, leaves)):
                        yield tree, block, level, at, index & (FAN_OUT - 1), place

    return lambda batches: _batched(rows(batches), schema)


def _paths(units: DataFrame, log: DataFrame, base: int) -> DataFrame:
    """(tree, block, path) of ``units`` (tree, block, leaf, leaves): the run and the own place in it at each level from ``base`` up."""
    named = units.select("tree", "block", "leaf", "leaves").mapInArrow(_named(base), "tree string, block long, level int, at int, own int, position long")
    found = named.join(log.select("tree", "position", "digest"), ["tree", "position"])
    levels = found.groupBy("tree", "block", "level", "own").agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("s"))
    levels = levels.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("level", "own", F.col("s.digest").alias("run")))).alias("path"))
    return units.join(levels, ["tree", "block"], "left").select("tree", "block", F.coalesce("path", F.expr(f"cast(array() as {_PATH})")).alias("path"))


def folded(value: str, path: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf leads to; path: own place in the run and the whole run, whose node there is replaced."""
    for own, run in path:
        value = digest([*run[:own], value, *run[own + 1 :]])
    return value


def _prover(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # rows of kind 0 are the upper path, of kind 1 the block's piece of the log, of kind 2 the leaves that ask
        for (_, block), unit in _units(batches, 2):
            path, subroot, piece, first = [], None, [], leaf_position(block << BLOCK)
            for _, _, kind, at, leaves, node, value, upper, key in unit:
                if kind == 0:
                    path, subroot = [(x["own"], x["run"]) for x in upper], value
                elif kind == 1:
                    piece.append(node)
                else:
                    whole = []
                    for level in range(min(LEVELS, height(leaves))):
                        index = at >> (BITS * level)
                        whole.append((index & (FAN_OUT - 1), [piece[p - first] for p in run_of(level, index, leaves)]))
                    whole += path
                    proof = digest([d for own, run in whole for k, d in enumerate(run) if k != own])
                    yield key, node, subroot, proof, folded(value, whole)

    return lambda batches: _batched(rows(batches), schema)


def proofs(asked: DataFrame, log: DataFrame, upper: DataFrame) -> DataFrame:
    """(key, leaf, subroot, proof_sha256, folded_root) of each row of ``asked`` (key, tree, leaf_no, leaves, digest, value).

    ``upper`` (tree, root, path) continues each tree's paths above its root. ``value`` is the leaf to fold; what it is
    folded with is read from the log.
    """
    none = lambda kind: F.lit(None).cast(kind)
    key = dict(asked.dtypes)["key"]
    units = log.where(f"storey = 0 and level = 0 and node % {1 << BLOCK} = 0").selectExpr("tree", "block", "node as leaf", "leaves")
    upper = upper.select("tree", "root", F.col("path").alias("_above"))
    paths = _paths(units, log, LEVELS).join(upper, "tree").select(
        "tree", "block", F.lit(0).alias("kind"), none("long").alias("at"), none("long").alias("leaves"), none("string").alias("node"),
        F.col("root").alias("value"), F.concat("path", "_above").alias("path"), none(key).alias("key"))
    piece = log.where("storey = 0").select(
        "tree", "block", F.lit(1).alias("kind"), F.col("position").alias("at"), "leaves", F.col("digest").alias("node"),
        none("string").alias("value"), none(_PATH).alias("path"), none(key).alias("key"))
    asks = asked.select(
        "tree", F.shiftright("leaf_no", BLOCK).alias("block"), F.lit(2).alias("kind"), F.col("leaf_no").alias("at"), "leaves",
        F.col("digest").alias("node"), "value", none(_PATH).alias("path"), "key")
    units = paths.unionByName(piece).unionByName(asks).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at")
    schema = to_arrow_schema(asked.select("key").schema)
    for name in ("leaf", "subroot", "proof_sha256", "folded_root"):
        schema = schema.append(pa.field(name, pa.string()))
    return units.mapInArrow(_prover(schema), f"key {key}, leaf string, subroot string, proof_sha256 string, folded_root string")


def manifest(
    df: DataFrame, columns: Sequence[str], key: str = "doc_id", group: str = "source", altered: tuple[Column, dict[str, Column]] | None = None,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    A row's leaf is the hash of ``columns``. ``altered``, a condition and columns in place of some of those, says which
    rows are checked against the tree with another content than the one that was built in.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # null first, then bytewise
    when, new = altered or (F.lit(False), {})
    own = leaf(columns)
    value = F.when(when, leaf([new.get(c, c) for c in columns])).otherwise(own)
    rows = df.select(F.col(key).alias("key"), tree.alias("tree"), own.alias("digest"), value.alias("value"))
    rows = stored(numbered(rows, "tree", ["key", "digest", "value"]), "merkle-leaves")
    log = built(rows, rows.agg(F.max("leaves")).first()[0] or 0)
    groups = roots(log).select(F.lit("groups").alias("all"), "tree", F.col("root").alias("digest"))
    groups = stored(numbered(groups, "all", ["tree"]), "merkle-groups")
    above = built(groups.select(F.col("all").alias("tree"), "leaf_no", "leaves", "digest"), groups.count())
    units = groups.select(F.col("all").alias("tree"), F.col("leaf_no").alias("block"), F.col("leaf_no").alias("leaf"), "leaves")
    upper = _paths(units, above, 0).select(F.col("block").alias("leaf_no"), "path")
    found = proofs(rows, log, groups.join(upper, "leaf_no").select("tree", F.col("digest").alias("root"), "path"))
    root = F.lit((roots(above).first() or {"root": None})["root"]).cast("string")
    return found.select(F.col("key").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                        (F.col("folded_root") == root).alias("verified"))


def lowered(key: str = "doc_id", text: str = "text") -> tuple[Column, dict[str, Column]]:
    """The tampering of the registered query: text's A-Z in lower case where 5 divides the CRC-32 of the key in decimal."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False)), {text: ascii_lower(F.col(text))}
