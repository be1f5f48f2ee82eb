"""op11, op12 and op13 against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import merkle, neighbours, queries, vector_codes
from fleetlens.llm.gnat import Gnat
from fleetlens.llm.vectors import matrix

# op11


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 5), st.sampled_from([1, 3, 50, 2**20, 2**27, 2**40]), st.randoms(use_true_random=False))
def test_gnat_is_exact(n, dims, size, rng):
    value = lambda: [rng.randint(-size, size) for _ in range(dims)]
    entries = [value() for _ in range(n)]
    entries += [rng.choice(entries) for _ in range(rng.randint(0, 20))]
    queries_ = [value() for _ in range(30)] + entries[:10]
    index, gap = Gnat(np.array(entries, np.int64), fan_out=4, leaf=3).nearest(np.array(queries_, np.int64))
    for q, i, g in zip(queries_, index, gap):
        want = min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(entries))
        assert (int(g), int(i)) == want


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (key, vector, label), all usable and of one width."""
    whole = [(k, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for k, v, label in rows]
    step = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = [v for _, v, _ in sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[assign(v, p)[1] for _, v, _ in whole] for p in range(parts)]
        new = []
        for p in range(parts):
            own = []
            for k, e in enumerate(books[p]):
                mine = [cut(v, p) for (_, v, _), c in zip(whole, chosen[p]) if c == k]
                own.append([sum(col) // len(mine) for col in zip(*mine)] if mine else e)
            new.append(own)
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, of_label = [], {}
    for k, v, label in whole:
        found = [assign(v, p) for p in range(parts)]
        error = sum(g for g, _ in found)
        out.append((k, "".join(f"{i:02x}" for _, i in found), error, label))
        of_label[label] = of_label.get(label, 0) + error
    return sorted(((k, c, e, of_label[label], sha) for k, c, e, label in out), key=str)


@pytest.mark.parametrize("n", [3, 300])
def test_vector_codes(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 % 1000, [rng.gauss(0, 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (7, rows[1][1], None)]  # repeated rows, equal vectors
    bad = [(1, None, 0), (2, [1.0, None] + [0.0] * 6, 0), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, None)]
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows + bad, schema).withColumns({"key": F.lit("x"), "values": F.lit(1), "code": F.lit("c"), "error": F.lit(2.5), "rows": F.lit(0)})
    got = sorted((tuple(r) for r in vector_codes.compressed(df.repartition(5)).collect()), key=str)
    assert got == brute_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compressed(spark.createDataFrame([(1, None, "a")], schema)).collect() == []
    # shorter vectors, and a width that four parts do not divide, are padded with zeros; a null key comes last
    rows = [(None, [1.0, -2.0, 0.5], "a"), (3, [0.25], None), (1, [], "a"), (2, [1e6, -1e6, 3.0, 4.0, 5.0], None)]
    padded = [(k, v + [0.0] * (8 - len(v)), label) for k, v, label in rows]
    assert sorted((tuple(r) for r in vector_codes.compressed(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_codes(padded)


def test_decoded_vectors_are_entries(spark):
    rows = vector_codes.integers(queries.table(spark, "/root/testdata/sf0.001", "embeddings"), "vec_id", "embedding", "label", 1024)
    books = vector_codes.fitted(rows, rounds=1)
    found = vector_codes.decoded(vector_codes.encoded(rows, books), books).join(rows.select("key", F.col("values").alias("own")), "key")
    off = F.aggregate(F.arrays_zip("own", "values"), F.lit(0).cast("long"), lambda a, z: a + (z["own"] - z["values"]) * (z["own"] - z["values"]))
    assert found.where(off != F.col("error")).count() == 0 and found.count() == rows.count()


# op12


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for i, source, lang, n, text in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        other = text.translate(low) if tampered and text is not None else text
        leaf, value = (h(*map(part, (i, source, lang, n, t))) for t in (text, other))
        trees.setdefault(source, []).append((i is not None, i or 0, leaf, value, i))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def path(levels_, at):
        for nodes in levels_[:-1]:
            first = at // 16 * 16
            yield at - first, nodes[first : first + 16]
            at //= 16

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels([leaf for _, _, leaf, _, _ in sorted(trees[s])]) for s in order}
    top = levels([built[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for place, s in enumerate(order):
        for at, (_, _, leaf, value, i) in enumerate(sorted(trees[s])):
            whole = [*path(built[s], at), *path(top, place)]
            proof = h(*[d for own, run in whole for k, d in enumerate(run) if k != own])
            for own, run in whole:
                value = h(*run[:own], value, *run[own + 1 :])
            out.append((i, leaf, built[s][-1][0], root, proof, value, value == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [*range(1, 40), 255, 256, 257, 4095, 4096, 4097, 70_000])
def test_positions_are_those_of_a_postorder_log(n):
    log = []

    def complete(level, index):
        log.append((level, index))
        nodes = -(-n >> (4 * level))
        if nodes > 1 and (index % 16 == 15 or index == nodes - 1):
            complete(level + 1, index // 16)

    for i in range(n):
        complete(0, i)
    assert [merkle.position(level, index, n) for level, index in log] == list(range(len(log)))
    assert max(level for level, _ in log) == merkle.height(n)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"
MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest(spark):
    rng = random.Random(1)
    sizes = {"a": 4097, "b": 17, "c": 1, "": 16, None: 33, "é": 257, "Z": 2} | {f"s{k}": 1 for k in range(14)}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, source, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(["Ab ÉC", "", None, "x" * 50])))
    rows += [rows[0], rows[0], (None, "b", None, None, None), (None, "b", "de", 1, "Q" * 100_000), (None, None, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "digest", "key", "value", "leaf_no", "leaves", "block")})
    got = merkle.manifest(df.repartition(6), MANIFEST, altered=merkle.lowered())
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, "T")], [(5, None, None, None, "T")] * 3])
def test_small_manifests(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), MANIFEST, altered=merkle.lowered())
    assert sorted((tuple(r) for r in got.collect()), key=str) == (brute_manifest(rows) if rows else [])


def test_a_log_of_four_storeys(spark, monkeypatch):
    """Blocks of 16 leaves instead of 4096, so that small trees have many blocks and storeys."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    leaves = spark.range(5000).select(F.lit("t").alias("tree"), F.col("id").alias("leaf_no"), F.lit(5000).cast("long").alias("leaves"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    # tasks see the constants of their own process, so the builder runs here
    below, log, storey = sorted((r.tree, r.leaf_no >> 4, r.leaf_no, r.leaves, r.digest) for r in leaves.collect()), [], 0
    import pyarrow as pa

    while True:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*below)], ["tree", "block", "node", "leaves", "digest"])
        rows = [r for b in merkle._builder(storey)(iter([batch.slice(0, 100), batch.slice(100)])) for r in b.to_pylist()]
        log += rows
        storey += 1
        if merkle.height(5000) <= storey:
            break
        below = sorted((r["tree"], r["node"] >> 4, r["node"], r["leaves"], r["digest"]) for r in rows if r["level"] == storey)
    assert sorted(r["position"] for r in log) == list(range(len(log)))
    nodes = [h(str(i)) for i in range(5000)]
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    assert max(log, key=lambda r: r["position"])["digest"] == nodes[0]


# op13


def brute_nearest(rows, every=20, k=20):
    """rows: (vec_id, vector)."""
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = np.array([sum(a * b for a, b in zip(vectors[q].tolist(), x)) for x in vectors.tolist()]) if len(rows) < 500 else vectors @ vectors[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found_nearest(df):
    out = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_ties_and_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(6)] if i % 3 else [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200)]
    rows = [(i, v if any(v) else [1.0] + v[1:]) for i, v in rows]
    bad = [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [float("nan")] * 6), (480, [float("-inf")] * 6), (None, [1.0] * 6), (500, [])]
    twice = [(20, rows[20][1]), (21, rows[21][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad + twice], VECTORS).withColumns({c: F.lit("x") for c in ("key", "vector", "cell", "slice", "score")})
    assert found_nearest(df.repartition(4)) == brute_nearest(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 1.0])], [(0, [1.0]), (1, [2.0])], [(1, [1.0]), (3, [2.0])], [(20, None), (40, [0.0])]])
def test_few_vectors(spark, rows):
    good = [(i, v) for i, v in rows if v and any(v)]
    want = {k: v for k, v in brute_nearest(good).items() if v} if good else {}
    assert found_nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)) == want


def test_recall_over_many_shards(spark, monkeypatch):
    """Lengths that differ, one vector a third of all rows, and shards of 150 rows."""
    monkeypatch.setattr(neighbours, "ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    vectors = centres[rng.integers(0, 30, 3000)] + 0.5 * rng.standard_normal((3000, 16))
    vectors *= rng.uniform(0.2, 3, (3000, 1))
    vectors[::3] = vectors[0]
    vectors = vectors.astype(np.float32)
    rows = list(enumerate(vectors.tolist()))
    got, want = found_nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)), brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(s >= want[q][-1][1] - 1e-9 for q in want for _, s in got[q])
    assert hits / (20 * len(want)) >= 0.9
    exact = np.array(vectors, float)
    assert all(abs(exact[q] @ exact[i] - s) < 1e-9 for q in got for i, s in got[q])


def test_stop_factor():
    """The chi-square quantile, from drawn sums of squares."""
    drawn = (np.random.default_rng(0).standard_normal((200_000, neighbours.DIMS)) ** 2).sum(axis=1)
    assert abs((drawn < neighbours.stop_factor()).mean() - neighbours.CONFIDENCE) < 0.005


def test_matrix_pads():
    import pyarrow as pa

    assert matrix(pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float64())), 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
