"""Similarity self-join on word n-gram sets, by vertical partitioning of the global n-gram order.

1. Texts with equal n-gram sets form one class; from here on a class is one node.
2. The global order puts rare n-grams first: by the count in a table of 2**20 hashed counters, then by hash. The table
   cuts it into FRAGMENTS pieces of equal weight. Any order gives right results; a good one keeps common n-grams out of
   the prefixes.
3. Two sets of the wanted similarity share an n-gram among the first n - ceil(t*n) + 1 of each. Rows (n-gram, node) of
   these prefixes are sorted; n-grams of one node alone drop out.
4. For candidates, the overlap is counted in each fragment separately and summed per pair.
   a. Sizes are cut into bands of ratio 1/t. For every n-gram and band there is a star over this band and the next, so that
      any two nodes of fitting sizes share one; its centre is the node with the fewest rarer n-grams, which tends to be
      the text that the others were made from. Nodes are tested against their centres; links found make components.
   b. In a star of at most NARROW nodes any other two whose sizes and places of the n-gram allow a link are tested too,
      unless they are of one component by then: pairs within one component change no result.
   c. For nodes x, y around the centre of a wider star, the sets differ in D(x) xor D(y), where D is the difference to the
      centre. They can only link if D(x) and D(y) share s(x, y) n-grams, a number known from the sizes; where s <= 0 both
      link to the centre. So the prefix rule is applied again, to the differences: x and y of different components are
      tested if they share an n-gram that is not among the last s - 1 of either difference.
5. Long texts share a rare n-gram by chance, and the more so the more texts there are. Before sets are compared, a sketch of
   each (its n-grams counted by a few bits of their hashes) bounds the overlap from above; pairs that cannot link go.

So groups of near copies cost about their size, not its square, chance meetings cost two sketches, and no link between
components is lost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.shared import maybe_in, salted_lookup, settled, stored
from fleetlens.llm.tokens import U, grams, grams_within, pieces, words_of

COUNTERS = 1 << 20
SLICES = 16
FRAGMENTS = 8
#: Fragments that are counted at a time; the shuffle files of one pass may go before the next.
AT_A_TIME = 2
#: Nodes of a star up to which all its pairs are candidates.
NARROW = 16
#: What a candidate is, the largest kind first where it is several: two nodes of a narrow star, one with its centre, and a
#: node of a wide star with its centre.
PAIR, SPOKE, WIDE = range(3)
#: Most cells of a sketch.
CELLS = 1 << 12


def sets_of(batch: pa.RecordBatch, column: str, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has one, of all its words."""
    words = words_of(batch, column)
    hashes = words.hashes(lower=True)
    found, at = grams_within(words, hashes, size)
    first = np.searchsorted(at, words.first)
    out = []
    for k, n in enumerate(words.count):
        if n >= size:
            out.append(np.unique(found[first[k] : first[k + 1]]))
        elif n:
            out.append(grams(hashes[words.first[k] : words.first[k + 1]], int(n)) ^ U(int(n)))
        else:
            out.append(np.zeros(0, U))
    return out


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(44)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(hashes: np.ndarray) -> bytes:
    """n-grams counted by their lowest bits, in a power of two of cells that hold 4 to 8 each; empty if a count has no byte."""
    cells = min(CELLS, 1 << max(0, len(hashes).bit_length() - 3))
    counts = np.bincount((hashes & U(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes) -> int | None:
    """Upper bound of the n-grams that the sets of two sketches share; None if a sketch is empty."""
    if not a or not b:
        return None
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (a, b))
    cells = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, cells).sum(axis=0), y.reshape(-1, cells).sum(axis=0)).sum())


def classes_and_counters(docs: DataFrame, size: int) -> DataFrame:
    """One row per text (id, n, signature, sketch) and, per task, SLICES rows of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in pieces(batches, "_text"):
            sets = sets_of(batch, "_text", size)
            every = np.concatenate(sets)
            counters += np.bincount(counter_of(every), minlength=COUNTERS)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "signature": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "sketch": pa.array([sketch(s) for s in sets], pa.binary()),
                "slice": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary()),
            })
        yield pa.RecordBatch.from_pydict({
            "id": pa.nulls(SLICES, pa.int64()), "n": pa.nulls(SLICES, pa.int64()), "signature": pa.nulls(SLICES, pa.binary()),
            "sketch": pa.nulls(SLICES, pa.binary()), "slice": pa.array(range(SLICES), pa.int32()),
            "counts": pa.array([c.astype(np.int32).tobytes() for c in np.split(counters, SLICES)], pa.binary()),
        })

    return docs.mapInArrow(run, "id bigint, n bigint, signature binary, sketch binary, slice int, counts binary")


def summed_counters(rows: DataFrame) -> np.ndarray:
    """All counters: partial sums are added as they stream by, SLICES rows reach the driver (8 MB in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                part = np.frombuffer(raw.as_buffer(), np.int32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([*sums], pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for row in rows.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


class Order:
    """rank of each counter in the global order, and the fragment of each."""

    def __init__(self, counters: np.ndarray):
        by_count = np.argsort(counters, kind="stable")
        self.rank = np.empty(len(counters), np.int32)
        self.rank[by_count] = np.arange(len(counters), dtype=np.int32)
        weight = np.cumsum(counters[by_count])
        self.fragment = np.empty(len(counters), np.int8)
        self.fragment[by_count] = np.minimum(weight * FRAGMENTS // max(1, int(weight[-1])), FRAGMENTS - 1)

    def sort(self, hashes: np.ndarray) -> np.ndarray:
        """hashes in the global order."""
        return hashes[np.lexsort((hashes, self.rank[counter_of(hashes)]))]


def prefixes(docs: DataFrame, order, size: int, percent: int) -> DataFrame:
    """(id, signature, n, prefix) of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = order.value
        for batch in pieces(batches, "_text"):
            sets = sets_of(batch, "_text", size)
            use = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("_id").take(pa.array(use, pa.int64())), "n": pa.array([len(sets[k]) for k in use], pa.int64()),
                "signature": pa.array([hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest() for k in use], pa.binary()),
                "prefix": pa.array([by.sort(sets[k])[: prefix_size(len(sets[k]), percent)].view(np.int64) for k in use], pa.list_(pa.int64())),
            })

    return docs.mapInArrow(run, "id bigint, n bigint, signature binary, prefix array<bigint>")


def _runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)


def starred(rows: DataFrame, percent: int, narrow: int = NARROW) -> DataFrame:
    """(a, b, kind): the candidates of every star of an n-gram that more than one node has in its prefix.

    rows (gram, place, node, n) are sorted by n-gram, then place; a task keeps the first ``narrow`` nodes of each star of the
    n-gram it is at, and no rows. A star that grows wider leaves the pairs found before, too; only pairs with its centre
    follow, which is their a. Other pairs have the smaller node as a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stars = None, {}
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            gram, node, place, n = (batch.column(c).to_numpy() for c in ("gram", "node", "place", "n"))
            band = np.floor(np.log(n) / np.log(100 / percent)).astype(int)
            starts = _runs(gram)
            ends = np.r_[starts[1:], len(gram)]
            some = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(gram)))
            found: dict[tuple[int, int, int], None] = {}
            for a, b in zip(starts[some].tolist(), ends[some].tolist()):
                if gram[a] != at:
                    at, stars = gram[a], {}
                for x, k, i, size in zip(node[a:b].tolist(), band[a:b].tolist(), place[a:b].tolist(), n[a:b].tolist()):
                    for star in (k, k - 1):
                        nodes = stars.setdefault(star, [])
                        centre = nodes[0][0] if nodes else x
                        if len(nodes) == narrow:
                            found.update(((centre, y, WIDE), None) for y, _, _ in nodes[1:])
                            nodes.append(None)  # no more follow
                        if len(nodes) > narrow:
                            found[centre, x, WIDE] = None
                            continue
                        for y, j, other in nodes:
                            # shared n-grams stand before this one in both, or after it in both
                            if (100 + percent) * (min(i, j) + min(size - i, other - j)) >= percent * (size + other):
                                found[min(x, y), max(x, y), SPOKE if y == centre else PAIR] = None
                        nodes.append((x, i, size))
            new = [x for x in found if x not in seen]
            if len(seen) > 1 << 20:
                seen.clear()
            seen.update(new)
            yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in new], t) for k, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())))})

    return rows.mapInArrow(run, "a bigint, b bigint, kind int").groupBy("a", "b").agg(F.max("kind").alias("kind"))


def may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, ...) without those whose sketches show that they share too few n-grams; see ``most_shared``."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_x", "_y", "_n")))
            most = [(most_shared(x, y), n) for x, y, n in rows]
            yield batch.select(columns).filter(pa.array([m is None or (100 + percent) * m >= percent * n for m, n in most], pa.bool_()))

    one = classes.select(F.col("node").alias("a"), F.col("sketch").alias("_x"), F.col("n").alias("_n_a"))
    other = classes.select(F.col("node").alias("b"), F.col("sketch").alias("_y"), F.col("n").alias("_n_b"))
    sizes = pairs.join(one, "a").join(other, "b").where(f"100 * least(_n_a, _n_b) >= {percent} * greatest(_n_a, _n_b)")
    return sizes.select(*columns, "_x", "_y", (F.col("_n_a") + F.col("_n_b")).alias("_n")).mapInArrow(run, pairs.schema)


def segments(docs: DataFrame, order, size: int) -> DataFrame:
    """(node, fragment, part): the n-grams of each text, cut at the fragments of the global order; FRAGMENTS rows a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = order.value
        for batch in pieces(batches, "_text"):
            sets = sets_of(batch, "_text", size)
            node, signature = batch.column("node").to_numpy(), batch.column("signature").to_pylist()
            nodes, fragments, parts = [], [], []
            for k, s in enumerate(sets):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != signature[k]:
                    continue  # another text with the same key
                place = by.fragment[counter_of(s)]
                for f in range(FRAGMENTS):
                    nodes.append(node[k])
                    fragments.append(f)
                    parts.append(s[place == f].view(np.int64))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "fragment": pa.array(fragments, pa.int8()), "part": pa.array(parts, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "node bigint, fragment tinyint, part array<bigint>")


def _passes(parts: DataFrame) -> list[DataFrame]:
    return [parts.where(F.col("fragment").between(k, k + AT_A_TIME - 1)) for k in range(0, FRAGMENTS, AT_A_TIME)]


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of each pair: partial counts of each fragment, summed per pair.

    A node has FRAGMENTS rows, or a multiple where its row is repeated; sums are divided by the multiple.
    """
    counts = [stored(_sides(pairs, some).groupBy("a", "b").agg(
        F.sum(F.size("_a")).alias("_n_a"), F.sum(F.size("_b")).alias("_n_b"), F.sum(F.size(F.array_intersect("_a", "_b"))).alias("_both"),
        F.count("*").alias("_rows")), "jaccard-partial") for some in _passes(parts)]
    every = functools.reduce(DataFrame.unionByName, counts)
    total = lambda c: F.sum(c) * FRAGMENTS / F.sum("_rows")
    return every.groupBy("a", "b").agg(total("_n_a").alias("n_a"), total("_n_b").alias("n_b"), total("_both").alias("overlap"))


def difference_prefixes(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, wanted, ...) with first: the ``wanted`` first n-grams that only one of both sets has, by fragment,
    then by hash. A pass reads its fragments only for the pairs that the passes before left incomplete."""
    apart = F.array_sort(F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a")))
    left, found = pairs.select("a", "b", "wanted"), []
    for k, some in enumerate(_passes(parts)):
        rows = _sides(left, some, "wanted").groupBy("a", "b").agg(F.max("wanted").alias("_wanted"), F.array_sort(
            F.collect_set(F.struct("fragment", F.slice(apart, F.lit(1), F.col("wanted")).alias("apart")))).alias("_all"))
        cut = F.slice(F.flatten("_all.apart"), F.lit(1), F.col("_wanted"))
        found.append(stored(rows.select("a", "b", "_wanted", F.lit(k).alias("_pass"), cut.alias("_cut")), "jaccard-prefixes"))
        left = found[-1].select("a", "b", (F.col("_wanted") - F.size("_cut")).alias("wanted")).where("wanted > 0")
    every = functools.reduce(DataFrame.unionByName, found)
    first = every.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("_pass", "_cut"))).alias("_all"))
    return pairs.join(first.select("a", "b", F.flatten("_all._cut").alias("first")), ["a", "b"])


def _sides(pairs: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    left = pairs.select("a", "b", *more).join(parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("_a")), "a")
    return left.join(parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("_b")), ["b", "fragment"])


def around_centres(tested: DataFrame, labels: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes of different components around one centre that might link (step 4c).

    tested: (a: centre, b: node, n_a, n_b, overlap). With F(x) = (100 + p) |D(x)| - (100 - p) n(x), x and y link if
    they share (F(x) + F(y)) / (2 (100 + p)) n-grams of their differences; a partner that shares s of them has
    F(y) >= F(centre) + 2 p s, which bounds s for x alone. Differences are read only around centres whose nodes are in
    different components, and only as far as the prefix rule looks.
    """
    more, less = 100 + percent, 100 - percent
    named = tested.join(labels.select(F.col("node").alias("b"), "label"), "b", "left")
    named = named.select("a", "b", "n_a", "n_b", F.coalesce("label", "b").alias("label"),
                         (F.col("n_a") + F.col("n_b") - 2 * F.col("overlap")).cast("int").alias("m"))
    named = named.withColumns({"f": more * F.col("m") - less * F.col("n_b"), "f_a": -less * F.col("n_a")})
    mixed = named.groupBy("a").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("a")
    alone = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("f_a")) / F.lit(200)))
    named = named.join(mixed, "a", "left_semi").withColumn("wanted", (F.col("m") - alone + 1).cast("int")).where("wanted > 0")
    named = stored(named.select("a", "b", "label", "m", "f", "wanted"), "jaccard-mixed")
    rows = difference_prefixes(named, parts).select("a", "b", "label", "m", "f", F.posexplode("first").alias("place", "gram"))
    x, y = rows.alias("x"), rows.alias("y")
    s = F.greatest(F.lit(1), F.ceil((F.col("x.f") + F.col("y.f")) / F.lit(2 * more)))
    met = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") < F.col("y.label"))
                 & (F.col("x.place") <= F.col("x.m") - s) & (F.col("y.place") <= F.col("y.m") - s)
                 & (F.least(F.col("x.m") - F.col("x.place"), F.col("y.m") - F.col("y.place")) + F.least("x.place", "y.place") >= s))
    return met.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85, narrow: int = NARROW) -> DataFrame:
    """(key, n_shingles, component_id, copies) for each row of ``docs``.

    Two texts link when 100 * overlap >= percent * union of their word n-gram sets (A-Z lower-cased). component_id is the
    smallest key that links lead to, the row's own included; copies is the number of rows with the same set. A text
    without words, or null, has an empty set and stands alone, with its own key. Rows with a null key take part as others;
    component_id is null only if all keys of a component are. Repeated rows come out as often as they came in. ``narrow``
    (2 or more) is the most nodes of a star whose pairs are tested themselves; it changes no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    described = stored(classes_and_counters(rows, size), "jaccard-sets")
    order = spark.sparkContext.broadcast(Order(summed_counters(described)))  # 5 MB at any size of the input
    texts = described.where("slice is null").select("id", "n", "signature", "sketch")
    classes = texts.where("n > 0").groupBy("signature").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "jaccard-classes")
    firsts = classes.select("signature", F.col("least").alias("id"), "node")

    def of_class(rows: DataFrame) -> DataFrame:
        same = (rows["id"].eqNullSafe(firsts["id"])) & (rows["signature"] == firsts["signature"])
        return rows.join(firsts, same).select(rows["*"], firsts["node"])

    exploded = of_class(prefixes(rows, order, size, percent)).select("node", "n", F.posexplode("prefix").alias("place", "gram"))
    exploded = exploded.repartition("gram").sortWithinPartitions("gram", "place", "node").select("gram", "place", "node", "n")
    met = stored(starred(exploded, percent, narrow), "jaccard-met")
    wide = met.where(F.col("kind") == WIDE)
    stars = stored(wide.unionByName(may_link(met.where(F.col("kind") < WIDE), classes, percent)), "jaccard-stars")
    wanted = stars.selectExpr("explode(array(a, b)) as node").distinct()
    wanted = firsts.join(wanted, "node", "left_semi").select(F.col("id").alias("_least"), "node", "signature")
    # most texts have no partner and stay where they are
    some = maybe_in(rows.select(F.col("_id").alias("id"), "_text"), "id", wanted, "_least")
    held = some.join(wanted, F.col("id").eqNullSafe(F.col("_least")))
    parts = stored(segments(held.select("node", "signature", "_text"), order, size), "jaccard-segments", by="fragment")

    links_if = f"100 * overlap >= {percent} * (n_a + n_b - overlap)"
    tested = stored(overlaps(stars.where(F.col("kind") > PAIR), parts), "jaccard-tested")
    links = settled(tested.where(links_if).select("a", "b"))
    labels = components(links)
    spread = tested.join(wide.select("a", "b"), ["a", "b"], "left_semi")
    others = may_link(around_centres(spread, labels, parts, percent), classes, percent)
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    apart = stars.where(F.col("kind") == PAIR).join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")
    others = stored(others.unionByName(apart).distinct(), "jaccard-others")
    if not others.isEmpty():
        more = settled(overlaps(others, parts).where(links_if).select("a", "b"))
        labels = components(links.unionByName(more))

    named = classes.select("signature", "least", "copies", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("signature", "component_id", "copies")
    full = salted_lookup(texts.where("n > 0").drop("sketch"), named, "signature", "id", 8)
    alone = texts.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return full.select("id", "n", "component_id", "copies").unionByName(alone).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "copies")
