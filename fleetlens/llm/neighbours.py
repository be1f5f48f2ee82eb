"""Nearest neighbours by inner product through projections to a few dimensions and kd-trees.

A vector x gets one more component, sqrt(M**2 - |x|**2) with M the largest length, and a query a zero; Euclidean nearness
is then nearness by inner product. A Gaussian matrix maps both to DIMS dimensions. The normal law is stable: a projected
squared distance is the true one times a chi-square variable of DIMS degrees of freedom, whatever the vectors are.

A query meets candidates in the order of their projected distance and verifies them by true inner product. It stops at the
projected distance s where the chi-square test ``P(X <= s**2 / d**2) >= CONFIDENCE`` holds, d being the true distance of its
k-th best so far: a better one would lie so far out with a probability of 1 - CONFIDENCE only. Order and stop are per leaf
of a kd-tree, by the distance to its box; recall is therefore CONFIDENCE or more on average.

On the cluster, cuts fitted on SAMPLE rows split projected space into cells, and a cell with many rows (equal vectors, for
instance) is split further by a hash, so that a shard holds about ROWS rows whatever their distribution. Each query
first searches one shard where it lies itself, which bounds its distance, and then every other shard whose box is within the
stop. Queries of a shard come in bounded groups. Only boxes (at most SHARDS rows, else shards grow) are broadcast.

Rows whose vector is null, zero or holds a null, NaN or infinity take no part, nor do rows without a key; rows that repeat a
key are one row, with the least of its vectors. Shorter vectors count as padded with zeros. Equal scores go to the smaller
key. No rows or no queries give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.shared import stored
from fleetlens.llm.vectors import finite, matrix, width

DIMS = 8  # even
CONFIDENCE = 0.95
SAMPLE = 8192
ROWS = 16384
SHARDS = 65536
LEAF = 512
QUERIES = 32768  # of one group
SEED = 20


def stop_factor(dims: int = DIMS, confidence: float = CONFIDENCE) -> float:
    """Chi-square quantile for an even number of degrees: candidates beyond d**2 times this need not be verified."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < confidence:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < confidence else (low, mid)
    return high


@dataclass
class Space:
    """Projection of vectors of ``columns`` components whose longest has the squared length ``reach``."""

    columns: int
    reach: float

    def __post_init__(self) -> None:
        self.directions = np.random.default_rng(SEED).standard_normal((self.columns + 1, DIMS))

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.reach - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]

    def squared(self, lengths: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Squared distance of a query of a squared length to a row of an inner product with it."""
        return np.maximum(lengths + self.reach - 2 * scores, 0)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the order of components: equal vectors have equal scores."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k, None]
        gap = np.maximum(np.maximum(low[:, k] - p, p - high[:, k]), 0)
        out += gap * gap
    return out


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Indexes of the leaves of a kd-tree: halves along the widest dimension, until ``size`` or fewer are left."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            leaves.append(at)
            continue
        own = points[at]
        order = np.argsort(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return leaves


class Best:
    """The k best (score, key) of each query, equal scores by key."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), -np.inf)
        self.key = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(query):
            return
        k = self.score.shape[1]
        asked, at = np.unique(query, return_inverse=True)
        q = np.concatenate([at, np.repeat(np.arange(len(asked)), k)])
        s = np.concatenate([score, self.score[asked].ravel()])
        ids = np.concatenate([key, self.key[asked].ravel()])
        order = np.lexsort((ids, -s, q))
        starts = np.searchsorted(q[order], np.arange(len(asked)))
        take = order[(starts[:, None] + np.arange(k)).ravel()]
        self.score[asked], self.key[asked] = s[take].reshape(-1, k), ids[take].reshape(-1, k)


class Shard:
    """A kd-tree over the projections of a bounded number of rows."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, space: Space) -> None:
        self.keys, self.vectors, self.space = keys, vectors, space
        projected = space.rows(vectors)
        self.leaves = kd_leaves(projected, LEAF)
        self.low = np.array([projected[at].min(axis=0) for at in self.leaves]).reshape(-1, DIMS)
        self.high = np.array([projected[at].max(axis=0) for at in self.leaves]).reshape(-1, DIMS)
        self.longest = float(np.sqrt((vectors * vectors).sum(axis=1).max())) if len(vectors) else 0.0

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[Best, np.ndarray]:
        """The k best of each query among rows with another key, and how many were verified.

        ``least``: a score that k others are known to reach.
        """
        best, factor = Best(len(queries), k), stop_factor()
        lengths = (queries * queries).sum(axis=1)
        slack = 1e-12 * (1 + np.sqrt(lengths) * self.longest)  # above the rounding of a matrix product
        gaps = to_boxes(self.space.queries(queries), self.low, self.high)
        order = np.argsort(gaps, axis=1, kind="stable")
        verified, active = np.zeros(len(queries), np.int64), np.arange(len(queries))
        for step in range(len(self.leaves)):
            reached = np.maximum(best.least[active], least[active])
            stop = np.where(np.isfinite(reached), factor * self.space.squared(lengths[active], reached), np.inf)
            leaf = order[active, step]
            active, leaf = (a[gaps[active, leaf] <= stop] for a in (active, leaf))
            if not len(active):
                break
            for number in np.unique(leaf):
                mine, at = active[leaf == number], self.leaves[number]
                verified[mine] += len(at)
                score = queries[mine] @ self.vectors[at].T
                score[keys[mine][:, None] == self.keys[at]] = -np.inf
                floor = np.maximum(best.least[mine], least[mine])
                if len(at) > k:
                    floor = np.maximum(floor, np.partition(score, len(at) - k, axis=1)[:, len(at) - k])
                q, x = np.nonzero((score >= (floor - slack[mine])[:, None]) & (score > -np.inf))
                best.add(mine[q], inner(queries[mine[q]], self.vectors[at[x]]), self.keys[at[x]])
        return best, verified


def kept_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows that take part, one for each key."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = df.where(finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull())
    return usable.select(F.col(key).cast("long").alias("key"), values.alias("vector")).groupBy("key").agg(F.min("vector").alias("vector"))


@dataclass
class Cells:
    """A kd-tree of cuts: node i has the children 2i+1 and 2i+2; leaves are cells."""

    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def fitted(cls, points: np.ndarray, cells: int) -> Cells:
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        groups = [points]
        for node in range(len(axis)):
            own = groups[node]
            if len(own):
                axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut[node] = np.median(own[:, axis[node]])
            right = own[:, axis[node]] > cut[node] if len(own) else np.zeros(0, bool)
            groups += [own[~right], own[right]]
        return cls(axis, cut)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(self.axis) and node.min(initial=len(self.axis)) < len(self.axis):
            inside = node < len(self.axis)
            at = np.where(inside, node, 0)
            right = points[np.arange(len(points)), self.axis[at]] > self.cut[at]
            node = np.where(inside, 2 * node + 1 + right, node)
        return node - len(self.axis)


def _placed(rows: DataFrame, space: Space, cells: Cells) -> DataFrame:
    """``rows`` with their cell and projection."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.rows(matrix(batch.column(1), space.columns))
            cell, flat = pa.array(cells.of(points).astype(np.int32)), pa.array(points.ravel())
            place = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * DIMS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cell, place], ["key", "vector", "cell", "place"])

    return rows.select("key", "vector").mapInArrow(task, "key long, vector array<double>, cell int, place array<double>")


def indexed(rows: DataFrame) -> tuple[DataFrame, Space]:
    """(key, vector, cell, slice, place) of every row, written to the shared folder, and the projection."""
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    total, reach = rows.agg(F.count("*"), F.max(length)).first()
    space = Space(width(rows, "vector"), reach or 0.0)
    size = max(ROWS, -(-total // SHARDS))
    first = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toArrow()
    sample = space.rows(matrix(first.column("vector"), space.columns)) if total else np.zeros((0, DIMS))
    cells = Cells.fitted(sample, min(-(-total // size), SAMPLE // 8))
    placed = stored(_placed(rows, space, cells), "neighbour-cells")
    slices = placed.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("slices"))  # a row for each cell: SAMPLE / 8 at most
    cut = placed.join(F.broadcast(slices), "cell")
    return cut.select("key", "vector", "cell", F.pmod(F.xxhash64("key"), "slices").cast("int").alias("slice"), "place"), space


_FOUND = "query_id long, vec_id long, score double, verified long"


def _searching(space: Space, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Search of one group of queries (query, wanted, least) in one shard."""

    def task(shard: pa.Table, asked: pa.Table) -> pa.Table:
        none = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())]
        names = ["query_id", "vec_id", "score", "verified"]
        if not shard.num_rows or not asked.num_rows:
            return pa.Table.from_arrays(none, names)
        index = Shard(shard.column("key").to_numpy(), matrix(shard.column("vector"), space.columns), space)
        parts = []
        for at in range(0, asked.num_rows, 1024):
            part = asked.slice(at, 1024)
            keys = part.column("query").to_numpy()
            least = part.column("least").to_numpy()
            best, verified = index.search(keys, matrix(part.column("wanted"), space.columns), k, least)
            query, place = np.nonzero(np.isfinite(best.score))
            parts.append(pa.Table.from_arrays([pa.array(keys[query]), pa.array(best.key[query, place]), pa.array(best.score[query, place]),
                                               pa.array(np.where(place == 0, verified[query], 0))], names))
        return pa.concat_tables(parts)

    return task


def _searched(shards: DataFrame, asked: DataFrame, space: Space, k: int) -> DataFrame:
    """Best rows of each query in each (cell, slice) it asks; queries are dealt to groups of about QUERIES rows."""
    groups = asked.groupBy("cell", "slice").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    asked = asked.join(groups, ["cell", "slice"]).withColumn("group", F.pmod(F.xxhash64("key"), "groups").cast("int"))
    shards = shards.join(groups, ["cell", "slice"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    by = ["cell", "slice", "group"]
    left = shards.select(*by, "key", "vector")
    # other names, because both sides may come from the same rows
    right = asked.selectExpr("cell as cell_", "slice as slice_", "`group` as group_", "key as query", "vector as wanted", "least")
    return left.groupBy(*by).cogroup(right.groupBy("cell_", "slice_", "group_")).applyInArrow(_searching(space, k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _to_visit(queries: DataFrame, boxes: DataFrame, space: Space) -> DataFrame:
    """Each query with every shard but its own whose box the stopping test does not exclude."""
    flat = boxes.toArrow()  # a row for each shard: SHARDS and as many cells at most
    cell, part = flat.column("cell").to_numpy(), flat.column("slice").to_numpy()
    low, high = matrix(flat.column("low"), DIMS), matrix(flat.column("high"), DIMS)
    factor = stop_factor()
    sent = queries.sparkSession.sparkContext.broadcast((cell, part, low, high))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, part, low, high = sent.value
        step = max(1, (1 << 22) // max(1, len(low)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                q = matrix(piece.column("vector"), space.columns)
                least = piece.column("least").to_numpy()
                stop = np.where(np.isfinite(least), factor * space.squared((q * q).sum(axis=1), np.where(np.isfinite(least), least, 0)), np.inf)
                own = (piece.column("cell").to_numpy()[:, None] == cell) & (piece.column("slice").to_numpy()[:, None] == part)
                query, shard = np.nonzero((to_boxes(space.queries(q), low, high) <= stop[:, None]) & ~own)
                for a in range(0, len(query), 4096):
                    take = pa.array(query[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cell[shard[a : a + 4096]], pa.int32()), pa.array(part[shard[a : a + 4096]], pa.int32()),
                        piece.column("key").take(take), piece.column("vector").take(take), piece.column("least").take(take)],
                        ["cell", "slice", "key", "vector", "least"])

    return queries.select("key", "vector", "least", "cell", "slice").mapInArrow(
        task, "cell int, slice int, key long, vector array<double>, least double")


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows, by inner product, for each row that ``queries`` (of ``key``) holds for."""
    rows = kept_rows(df, key, vector)
    shards, space = indexed(rows)
    bounds = [F.array(*(f(F.col("place")[d]) for d in range(DIMS))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    boxes = shards.groupBy("cell", "slice").agg(*bounds)
    asked = shards.withColumnRenamed("key", key).where(queries).withColumnRenamed(key, "key").select("key", "vector", "cell", "slice")
    home = stored(_searched(shards, asked.withColumn("least", F.lit(float("-inf"))), space, k), "neighbour-home")
    least = home.groupBy(F.col("query_id").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asked = asked.join(least, "key", "left").fillna(float("-inf"), "least")
    away = _searched(shards, _to_visit(asked, boxes, space), space, k)
    return _best(home.unionByName(away), k).select("query_id", "rank", "vec_id", "score")
