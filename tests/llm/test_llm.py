"""The training-data operators against brute force, round trips and held-out rows, on small tables with odd rows."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm import (
    context_tree, decontamination, jaccard_join, language, licences, pieces, pseudonyms, queries, shared, substring_dedup, warc,
    weighted_sampling,
)
from fleetlens.llm.components import components
from fleetlens.llm.fm_index import FMIndex

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    rng = random.Random(5)
    base = " ".join(rng.choice(["der", "the", "la", "Haus", "éau", "x"]) + str(rng.randint(0, 40)) for _ in range(120))
    near = base.replace(" ", "  ", 3) + " end"
    loop = "a b c " * 30
    rows = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "one two"), (None, base),
            (8, loop), (8, loop), (9, loop + "tail"), (10, "word " * 3000), (11, "☃ 漢字 \x00 ▁"), (12, base[:300]), (13, near + " " + base)]
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", 1.5) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, score double")


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# op9, components


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = i if least[r] is None else min(least[r], i)
    return sorted(((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, odd, size, percent):
    for docs in (odd, documents(spark)):
        got = jaccard_join.linked(docs, size=size, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
        want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], size, percent)
        assert sorted((tuple(r) for r in got), key=str) == want


def test_jaccard_join_of_edited_copies(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = list(words)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randint(0, 30)}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 4, 85)


def test_maybe_in_loses_no_row(spark):
    rows = spark.range(-50, 20_000).selectExpr("if(id < 0, null, id) as id", "id as key")
    some = spark.range(0, 20_000, 70).selectExpr("if(id = 70, null, id) as key")
    found = shared.maybe_in(rows, "id", some, "key")
    assert found.columns == rows.columns
    wanted = F.col("id").eqNullSafe(F.col("_k"))
    assert found.join(some.select(F.col("key").alias("_k")), wanted).count() == 50 + some.count() - 1
    assert found.count() < 1_000
    assert shared.maybe_in(rows, "id", some.limit(0), "key").count() == 0


def test_difference_prefixes_equal_sets(spark):
    rng = random.Random(3)
    sets = {n: {(f, rng.randint(0, 30)) for f in range(jaccard_join.FRAGMENTS) for _ in range(rng.randint(0, 12))} for n in range(6)}
    parts = spark.createDataFrame([(n, f, sorted(h for g, h in s if g == f)) for n, s in sets.items() for f in range(jaccard_join.FRAGMENTS)],
                                  "node long, fragment byte, part array<long>")
    asked = [(a, b, rng.choice([1, 5, 40, 500])) for a in sets for b in sets if a < b]
    pairs = spark.createDataFrame(asked, "a long, b long, wanted int")
    got = {(r.a, r.b): list(r.first) for r in jaccard_join.difference_prefixes(pairs, parts).collect()}
    assert got == {(a, b): [h for _, h in sorted(sets[a] ^ sets[b])][:k] for a, b, k in asked}
    counts = {(r.a, r.b): (r.n_a, r.n_b, r.overlap) for r in jaccard_join.overlaps(pairs, parts.union(parts)).collect()}
    assert counts == {(a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b, _ in asked}


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.linked(none(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k * 7919 % 1009, (k + 1) * 7919 % 1009) for k in range(300)] + [(5000, 5001), (6, 6)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert len({got[k * 7919 % 1009] for k in range(301)}) == 1 and got[5000] == got[5001] != got[0]


# op10


def brute_dedup(rows, size=20):
    seen, out = {}, []
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[k : k + size]), (i, k)) != (i, k):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark, odd):
    for docs in (odd, documents(spark)):
        got = substring_dedup.deduplicated(docs).collect()
        want = brute_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert {tuple(r)[:4] for r in got} == set(want) and len(got) == docs.count()
    assert substring_dedup.deduplicated(none(spark)).count() == 0


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_shard_in_blocks(monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = random.Random(3)
    shard, size, rows = substring_dedup.Shard(5), 5, {}
    for doc in range(40):
        rows[doc] = [rng.choice("abc") for _ in range(rng.randint(5, 30))]
        shard.add([(doc, 0, 0, len(rows[doc]) - size + 1)], [" ".join(rows[doc]).encode() + b" "])
    got = {(d, w) for d, _, first, n in shard.search() for w in range(first, first + n)}
    seen, want = set(), set()
    place = {at[0] for at in shard.at}
    for doc, w in rows.items():
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if doc in place and x in seen:
                want.add((doc, k))
            seen.add(x)
    assert got == want


def test_fm_index_intervals():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 4, 500), 0]
    index = FMIndex(text, 6)
    at = np.arange(len(text) - 6)
    which, low, high = index.search(text, at, 6)
    counts = Counter(tuple(text[k : k + 6]) for k in at)
    assert {int(k): int(h - l) for k, l, h in zip(which, low, high)} == {int(k): counts[tuple(text[k : k + 6])] for k in at if counts[tuple(text[k : k + 6])] > 1}


# op5


def test_sentencepiece_equals_the_library(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    for docs in (odd, documents(spark)):
        for r in pieces.encoded(docs, queries.MODEL).collect():
            ids = model.encode(r["text"] or "")
            assert r["ids"] == ",".join(map(str, ids)) and r["n_tokens"] == len(ids) and r["decoded"] == model.decode(ids)
            assert r["ids_sha256"] == hashlib.sha256(r["ids"].encode()).hexdigest()
    assert pieces.encoded(none(spark), queries.MODEL).count() == 0


def test_backtracker_on_random_text():
    import sentencepiece

    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL), pieces.backtracker(queries.MODEL), random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choice("abeinrst  \n\t▁éü漢☃😀\x00.,:01") for _ in range(rng.randint(0, 30)))
        ids = model.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == model.decode(ids)


# op3


def test_block_weights_equal_sequential_ones():
    """The product of one-by-one predictions of a context tree is its weighted block probability."""
    rng = np.random.default_rng(4)
    zeros, ones = rng.integers(0, 9, 50).astype(float), rng.integers(0, 9, 50).astype(float)
    for z, o in zip(zeros, ones):
        a = b = p = 0.0
        for bit in [0] * int(z) + [1] * int(o):
            p += math.log(((b if bit else a) + 0.5) / (a + b + 1))
            a, b = a + (not bit), b + bit
        assert abs(context_tree.log_kt(np.array([z]), np.array([o]))[0] - p) < 1e-9


def brute_ctw(train, test):
    """Context tree by dictionaries, straight from the definition."""
    depth = context_tree.DEPTH
    fold = lambda t: bytes(context_tree._FOLD[np.frombuffer(t.encode(), np.uint8)]) + b"\xff"
    counts = defaultdict(lambda: [0, 0])

    def nodes(data, k):
        context = (b"\0" * depth + data)[k : k + depth]
        for level in range(8):
            prefix, bit = 1 << level | data[k] >> (8 - level), data[k] >> (7 - level) & 1
            yield [(context[depth - d :], prefix) for d in range(depth + 1)], bit

    children = defaultdict(set)
    for t in train:
        data = fold(t)
        for k in range(len(data)):
            for path, bit in nodes(data, k):
                for d, n in enumerate(path):
                    counts[n][bit] += 1
                    if d:
                        children[path[d - 1]].add(n)

    def weighted(n):
        own = context_tree.log_kt(*(np.array([float(x)]) for x in counts[n]))[0]
        if len(n[0]) == depth:
            return own, 1.0
        below = sum(memo(c)[0] for c in children[n])
        both = np.logaddexp(own, below)
        return both - math.log(2), math.exp(own - both)

    cache = {}

    def memo(n):
        if n not in cache:
            cache[n] = weighted(n)
        return cache[n]

    out = []
    for t in test:
        total, data = 0.0, fold(t)
        for k in range(len(data)):
            for path, bit in nodes(data, k):
                p = None
                for n in reversed(path):
                    c = counts.get(n, [0, 0])
                    kt = (c[bit] + 0.5) / (sum(c) + 1)
                    w = 1.0 if p is None else memo(n)[1] if n in counts else 0.5
                    p = kt if p is None else w * kt + (1 - w) * p
                total += math.log10(p)
        out.append(total)
    return out


def test_context_tree_equals_its_definition(spark):
    texts = ["abra cadabra", "Abra", "the cat sat on the mat", "", None, "zzz é", "the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.scored(docs, F.col("doc_id") < 4, block=20).collect()}
    want = brute_ctw([t or "" for t in texts[:4]], [t or "" for t in texts])
    for k, w in enumerate(want):
        assert abs(got[k]["score"] - w) < 1e-6
    train = Counter(x for t in texts[:4] for x in [*WORD.findall(t.translate(FOLD)), None])
    n, v = sum(train.values()), len(train)
    for k, t in enumerate(texts):
        tokens = [*WORD.findall((t or "").translate(FOLD)), None]
        assert got[k]["n_tokens"] == len(tokens) and got[k]["n_known"] == sum(train[x] > 0 for x in tokens) and got[k]["train_tokens"] == n
        assert abs(got[k]["base_score"] - sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)) < 1e-9


def test_context_tree_on_odd_rows(spark, odd):
    rows = context_tree.scored(odd, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in rows)
    assert context_tree.scored(none(spark), F.lit(True)).count() == 0
    assert context_tree.scored(odd, F.lit(False)).where("n_known > 0").count() == 0


# op8


def test_language_on_held_out_rows(spark, odd):
    docs = documents(spark)
    model = language.train(docs.where(queries.fold() != 0))
    got = language.predict(docs, model).where(queries.fold() == 0).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    rows = {r["text"]: r for r in language.predict(odd, model).collect()}
    assert all(rows[t]["lang_pred"] == "und" and rows[t]["score"] == 0 for t in (None, "", " \t\n"))
    assert language.predict(none(spark), language.train(none(spark))).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.train(none(spark))).collect()} == {"und"}


# op6


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 200
    rows = [(1, "http://a/1", long), (2, "http://a/\r\n2", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "n", "é" * 100),
            (6, "u", "é" * 100), (6, "u", "é" * 100), (7, "z", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_digest int")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert by[1, "response"]["payload"].decode() == long and by[2, "revisit"]["refers_to"] == 1 and by[2, "revisit"]["payload_bytes"] == 203
    assert by[None, "revisit"]["refers_to"] == 6 and by[3, "response"]["payload_bytes"] == 0 and by[7, "response"]["payload"] == b"\r\n\r\nWARC/1.1"
    assert sum(r["record_type"] == "response" for r in got if r["page_id"] in (4, 5, 6)) == 4
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    records = [gzip.compress(warc.record(k, "u", b"x" * k, "d", "response", None)) for k in range(5)]
    data = warc.archive(records, [{"key": "k", "offset": 0, "length": 1, "filename": "f"}], zip64)
    zipped = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, n = zipped.place(warc.DATA)
    assert data[at : at + n] == b"".join(records)


# op2


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, odd):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in weighted_sampling.fingerprinted(docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    errors, prints = [], defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after)]
        prints[t].add(r["fingerprint"])
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.13 and all(len(p) == 1 for p in prints.values())
    found = weighted_sampling.fingerprinted(odd).collect()
    assert len(found) == odd.count() and len({r["fingerprint"] for r in found if r["doc_id"] in (3, 4, 5)}) == 1
    assert weighted_sampling.fingerprinted(none(spark)).count() == 0


def test_likeness_is_exact_enough(spark):
    docs = documents(spark).limit(300)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r["near_edited"] for r in weighted_sampling.fingerprinted(docs).collect()}
    errors = [got[i] - jaccard(t, t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]) for k, (i, t) in enumerate(rows)]
    assert weighted_sampling.SAMPLES >= 64 and np.std(errors) < 0.075


def test_following(spark):
    ids = [0, 1, 4095, 4096, 10**6, 2**40, -5, None, 1]
    got = {r["doc_id"]: r["following"] for r in shared.following(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    order = sorted({i for i in ids if i is not None})
    assert got == dict(zip(order, [*order[1:], None]))


# op4


def test_pseudonyms(spark, odd):
    text = "a.b@x.org, +1 (988) 555-2485 4041894974608795 70.123.182.155 on 2024-02-29 and 31/12/1999; 29/02/2023 999.1.1.1 1234567890123456"
    docs = spark.createDataFrame([(0, text), (1, "again 4041894974608795."), (2, None), (3, ""), (4, "x1")], "doc_id long, text string")
    got = [r["text"] for r in pseudonyms.replaced(docs, "key").orderBy("doc_id").collect()]
    assert re.fullmatch(r"u[0-9a-f]{12}@x\.org, \+1 \(\d{3}\) \d{3}-\d{4} 4\d{15} \d+\.\d+\.\d+\.\d+ on \d{4}-\d\d-\d\d and \d\d/\d\d/\d{4}; 29/02/2023 999.1.1.1 1234567890123456", got[0])
    assert got[0].split()[4] == got[1].split()[1].rstrip(".") != "4041894974608795" and got[2:] == [None, "", "x1"]
    assert pseudonyms.replaced(odd, "key").drop("n_replaced").exceptAll(odd).count() == 0 and pseudonyms.replaced(none(spark), "k").count() == 0


def test_pseudonyms_of_general_forms(spark):
    forms = ["555-123-4567", "(555) 123-4567", "555.123.4567", "+1 555 123 4567", "+15551234567", "1-800-555-1234", "+44 20 7946 0958", "+49 (30) 1234567",
             "+33 1 23 45 67 89", "020 7946 0958", "3782 822463 10005", "3782-822463-10005", "12/31/1999", "1/31/1999", "31.12.1999", "1999/12/31"]
    docs = spark.createDataFrame([(k, f"see {f}, 2024-02-29") for k, f in enumerate(forms)], "doc_id long, text string")
    got = [r["text"] for r in pseudonyms.replaced(docs, "key").orderBy("doc_id").collect()]
    layout = lambda t: re.sub("[0-9]", "9", t)
    for f, t in zip(forms, got):
        new, rest = t[4:].rsplit(", ", 1)
        assert new != f and rest != "2024-02-29" and (layout(new) == layout(f) or f == "1/31/1999"), (f, t)
    phones = [re.sub("[^0-9]", "", t[4:].split(",")[0])[-10:] for t in got[:5]]
    assert len(set(phones)) == 1 and got[6][4:8] == "+44 " and got[8][4:8] == "+33 "
    month, day, _ = map(int, got[12][4:].split(",")[0].split("/"))
    assert month <= 12 < day


def test_permutation(spark):
    for a, b in ((292, 250), (10, 1), (100, 10)):
        out = spark.range(a * b).select(pseudonyms.permuted(F.col("id"), a, b, "k", "x").alias("p"))
        assert out.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()[:] == (a * b, 0, a * b - 1)


# op1


def test_lines_are_compared_inside_their_row(spark):
    mit = licences.TEMPLATES["MIT"]
    long = mit + " the the the License mit mit"
    texts = [mit, long, mit + "\n" + mit, mit + " " + "other " * 40, "licensed.5", None, ""]
    files = spark.createDataFrame([(f"d{n}/f", t) for n, t in enumerate(texts)] + [(None, mit), (None, mit)], "path string, text string")
    found = licences.scanned(files)
    idf, weights = licences.vectors(licences.TEMPLATES)
    rarest = math.log(1 + len(licences.TEMPLATES)) + 1

    def score(line):
        counts = Counter(re.findall(licences._WORD, line.lower()))
        norm = math.sqrt(sum((n * idf.get(w, rarest)) ** 2 for w, n in counts.items()))
        return max((round(sum(n * idf[w] * t[w] for w, n in counts.items() if w in t) / norm, 9), k) for k, t in weights.items())

    got = sorted(((r["path"], r["licence"], r["score"]) for r in found.collect()), key=str)
    like = {"d0/f": mit, "d1/f": long, "d2/f": mit}
    want = [(None, "MIT", 1.0)] * 2 + [(p, score(t)[1] if score(t)[0] >= 0.8 else None, score(t)[0] if score(t)[0] >= 0.8 else None) for p, t in like.items()]
    assert got == sorted(want + [(f"d{n}/f", None, None) for n in range(3, 7)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Aggregate [" in x and "_line" in x]


def test_keys_of_a_block_are_merged_as_they_come(monkeypatch):
    monkeypatch.setattr(context_tree, "HELD", 100)
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x: sizes.append(len(x)) or unique(x))
    rng = np.random.default_rng(3)
    parts = [unique(rng.integers(-50, 50, 40)) for _ in range(200)]
    assert context_tree.distinct(iter(parts)).tolist() == unique(np.concatenate(parts)).tolist()
    assert len(sizes) > 5 and max(sizes) <= 2 * 100 + 100 + 40
    assert context_tree.distinct(iter([])).tolist() == []


def test_licences(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    rows = [("a/LICENSE", mit), ("a/b/c/x.py", "code\n"), ("a/b/LICENSE", f"intro\n{gpl}\nend"), ("a/y.py", f"# {mit}"), ("z/y.py", gpl), ("z/w.py", None),
            ("a/b/c/x.py", "code\n"), (None, mit), ("COPYING2/q", "the license"), ("top.py", "")]
    files = spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, licence string")
    got = sorted((tuple(r)[:1] + (r["licence"], r["origin"], r["directory"]) for r in licences.scanned(files).collect()), key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/b/c/x.py", "GPL-3.0", "inherited", "a/b"), ("a/b/c/x.py", "GPL-3.0", "inherited", "a/b"),
        ("a/b/LICENSE", "GPL-3.0", "own", None), ("a/y.py", "MIT", "own", None), ("z/y.py", "GPL-3.0", "own", None), ("z/w.py", None, "none", None),
        (None, "MIT", "own", None), ("COPYING2/q", None, "none", None), ("top.py", None, "none", None)], key=str)
    assert licences.scanned(files.limit(0)).count() == 0


def test_needed_words_lose_no_line():
    idf, weights = licences.vectors(licences.TEMPLATES)
    some = set(licences.needed_words(weights, 0.8))
    rng, words = random.Random(2), sorted(idf)
    for _ in range(3000):
        line = Counter(rng.choice(words) for _ in range(rng.randint(1, 12)))
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in line.items()))
        best = max(sum(n * idf[w] * t.get(w, 0) for w, n in line.items()) / norm for t in weights.values())
        assert best < 0.8 or some & set(line)


# op7


def test_decontamination(spark, odd):
    item = "If Anna has 12 apples and gives 5 kg of them to Bob while she keeps the rest for a long winter then how many are left"
    other = item.replace("12", "30").replace("5 kg", "7 kg").replace("Bob", "Carl")
    mixed = "If Anna has 12 apples and gives 5 kg of them and has 13 apples and gives 6 kg of them"
    docs = spark.createDataFrame([(0, f"noise {item} noise", 1), (1, other, 1), (2, "nothing of it here at all, really nothing", 1), (3, None, 1), (4, "", 1), (None, item, 1)],
                                 "doc_id long, text string, item int")
    items = spark.createDataFrame([(7, item), (8, None), (9, "short one"), (10, mixed)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.marked(docs, items).collect()}
    assert [got[k]["contaminated"] for k in (0, 1, 2, 3, 4, None)] == [True, True, False, False, False, False] and got[1]["item"] == 7
    assert decontamination.marked(odd, items).count() == odd.count() and decontamination.marked(none(spark), items).count() == 0
    assert decontamination.marked(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_judges_each_alignment(spark):
    item = "If Anna has 12 apples and gives 5 kg of them to Bob while she keeps the rest for a long winter then how many are left"
    other = item.replace("12", "30").replace("5 kg", "7 kg").replace("Bob", "Carl")
    third = other.replace("30", "44").replace("7 kg", "9 kg").replace("Carl", "Dora")
    put_in = [t.replace("to", "very kindly to").replace("for a", "safely for a") for t in (other, third)]
    docs = spark.createDataFrame([(0, f"{item} and now again {other}"), (1, f"{other} noise {third} noise"), (2, f"{put_in[0]} noise {put_in[1]}"), (3, "nothing " * 40)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == {0, 1, 2} and all(r["item"] == 7 and r["consistency"] >= 0.8 for r in got.values())


def test_decontamination_finds_short_dense_and_named_items(spark):
    items = spark.createDataFrame([(1, "Why is grass green?"), (2, "12 + 5 - 3 = 14, 14 + 6 = 20 and 20 - 9 = 11"),
                                   (3, "Tom has 3 red apples today. Tom buys 5 green pears.")], "item_id long, text string")
    docs = spark.createDataFrame([
        (0, "They ask: why is grass green? Nobody knows."), (1, "Sum: 12 + 5 - 3 = 14, 14 + 6 = 20 and 20 - 9 = 11."), (2, "Ann has 3 red apples today. Ann buys 5 green pears."),
        (3, "why is the grass so green"), (4, "12 + 5 - 3 = 14, 14 + 7 = 21 and 21 - 9 = 12"), (5, "Tom has no red apples. He buys some."), (None, "Why is grass green?"), (None, "fine")],
        "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["item"] for r in decontamination.marked(docs, items, null_keys=True).where("contaminated").collect()}
    assert {k: v for (k, _), v in got.items()} == {0: 1, 1: 2, 2: 3, None: 1} and len(got) == 4 and (None, "fine") not in got
    left = {(r["doc_id"], r["text"]) for r in decontamination.without(docs, items, null_keys=True).collect()}
    assert {k for k, _ in left} == {3, 4, 5, None} and len(left) == 4


# queries and pipeline


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline(spark):
    docs = documents(spark)
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.settled(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert kept["language_id"] == before.count() > kept["ngram_jaccard_join"] > kept["benchmark_decontamination"] == kept["pii"] == out.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.leaks(docs, bench).count() == 0
    assert docs.where(F.col("text").rlike(pseudonyms.KINDS["email"]) & ~F.col("text").rlike("u[0-9a-f]{12}@")).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd.drop("score")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.lit("s")), SF)
    assert {r["doc_id"] for r in docs.collect()} <= {0, 1, 2, 6, 8, 9, 10, 11, 12, 13, None}
