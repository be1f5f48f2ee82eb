"""Cases that were once wrong."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, jaccard_join, language, pieces, queries, shared, substring_dedup, warc, weighted_sampling
from fleetlens.llm.tokens import words_of


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_patterned_words_have_different_hashes():
    words = [w for n in (8, 64, 256, 1024, 2048, 4096) for w in thue_morse(n)] + ["", "a", "A", "é", "a" * 7, "a" * 8, "a" * 9, "a" * 256, "a" * 257, "\x01", "\x01\x01"]
    batch = pa.RecordBatch.from_pydict({"t": [" ".join(words), *words, *words[::-1], "x " + " ".join(words[::-1])]})
    found = words_of(batch, "t")
    text = [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end)]
    hashes = found.hashes().tolist()
    assert len(set(zip(text, hashes))) == len(set(text)) == len(set(hashes))
    folded = found.hashes(lower=True).tolist()
    low = [t.replace("A", "a") for t in text]
    assert len(set(zip(low, folded))) == len(set(low)) == len(set(folded))


def test_patterned_words_in_windows_and_sets(spark):
    one, other = thue_morse(2048)
    tail = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.deduplicated(df, keep_text=False).collect()} == {1: 0, 2: 0, 3: 20}
    short = spark.createDataFrame([(1, f"{one} x y z"), (2, f"{other} x y z"), (3, f"{one} x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.linked(short).collect()} == {1: 1, 2: 2, 3: 1}


def test_numerals_are_no_letters(spark):
    texts = ["½ ² 12", "①", "Ⅷ", "٣", "", None, "_", "the ½ house", "日"]
    docs = spark.createDataFrame([(i, "the house and the dog", "en") for i in range(5)] + [(i, "das Haus und der Hund", "de") for i in range(5, 10)], "doc_id long, text string, lang string")
    found = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), language.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[:7]] == ["und"] * 7 and all(r.score == 0 for r in found[:7])
    assert found[7].lang_pred == "en" and found[8].lang_pred != "und"


def test_training_rows_are_bounded_and_the_same_however_dealt(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id % 50, ' x', id % 7) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS lang")
    models = [language.train(df, sample=100) for df in (rows.repartition(1), rows.repartition(7), rows.unionByName(rows.limit(0)))]
    logs = [{w: m.logs[k].tolist() for t in (m.words, *m.grams) for w, k in t.items()} for m in models]
    assert logs[0] == logs[1] == logs[2] and len({tuple(m.languages) for m in models}) == 1
    same = rows.limit(1).crossJoin(spark.range(500)).select("doc_id", "text", "lang")
    counted = language.train(same, sample=100)
    assert counted.languages == ["a"]


def test_each_archive_is_read_by_a_task(spark, monkeypatch):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x" * 200), F.col("id").cast("string")).alias("html"))
    folder = f"{shared.shared_folder(spark)}/warc-tasks-{np.random.default_rng().integers(2**62)}"
    archives = warc.written(warc.with_types(pages, "page_id", "html"), folder, size=4000)
    n = archives.count()
    found = warc.records(archives, folder, keep_payload=False)
    assert n >= 8 and found.rdd.getNumPartitions() == n
    tasks = found.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert tasks >= n / 2 and found.count() == 400


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_items_of_few_words_match_whole_lines(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "New York 12"), (3, "Who wrote the book of 1990 about the old bridge in the town of Mostar?")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "Paris is a city and Paris is large"), (1, "Cities:\n Paris.\nRome"), (2, "They live in New York 12 or so"), (3, "new york, 12"), (4, "NEW YORK 13"),
                                  (5, "Say: who wrote the book of 1990 about the old bridge in the town of Mostar? Nobody."), (None, "Paris")], "doc_id long, text string")
    found = decontamination.leaks(docs, items, null_keys=True).collect()
    assert {(r["doc_id"], r["item"]) for r in found} == {(1, 1), (3, 2), (5, 3), (None, 1)}


def test_the_sieve_loses_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    sieved = {tuple(r) for r in decontamination.leaks(docs, items).collect()}
    monkeypatch.setattr(decontamination, "sieve_of", lambda w: F.split(F.lit(",".join(["-1"] * (decontamination.SIEVE // 64))), ",").cast("array<bigint>"))
    assert {tuple(r) for r in decontamination.leaks(docs, items).collect()} == sieved and sieved


def test_chance_meetings_of_long_texts_are_no_candidates(spark):
    """Texts that share a rare n-gram by chance were compared whole, and their differences exploded."""
    rng = np.random.default_rng(4)
    hashes = [np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64)) for _ in range(40)]
    near = np.unique(np.r_[hashes[0][:-20], rng.integers(0, 2**64, 20, dtype=np.uint64)])
    sketches = [jaccard_join.sketch(h) for h in [*hashes, near]]
    assert all(100 <= len(s) < 900 for s in sketches)
    for k, h in enumerate(hashes):
        for other, s in zip([*hashes, near], sketches):
            assert jaccard_join.most_shared(sketches[k], s) >= len(np.intersect1d(h, other))
    short, long = jaccard_join.sketch(hashes[0][:500]), jaccard_join.sketch(hashes[0][:520])
    assert len(short) * 2 == len(long) and jaccard_join.most_shared(short, long) >= 500
    assert jaccard_join.sketch(np.zeros(0, np.uint64)) == b"\0" and jaccard_join.sketch(np.arange(300, dtype=np.uint64) << np.uint64(20)) == b""
    assert jaccard_join.most_shared(b"", long) is None

    classes = spark.createDataFrame([(k, len(h), bytearray(s)) for k, (h, s) in enumerate(zip([*hashes, near], sketches))], "node long, n long, sketch binary")
    pairs = spark.createDataFrame([(a, b) for b in range(41) for a in range(b)], "a long, b long")
    assert [tuple(r) for r in jaccard_join.may_link(pairs, classes, 85).collect()] == [(0, 40)]


def test_narrow_and_wide_stars_find_the_same(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(160):
        words = [f"g{k % 4}w{i}" for i in range(50)]
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(50)] = f"e{rng.integers(20)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 4]) for i in range(47)} for _, t in rows]
    label = list(range(160))
    for b in range(160):
        for a in range(b):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) > 8
    for narrow in (2, 5, 1000):
        assert [r.component_id for r in jaccard_join.linked(docs, narrow=narrow).orderBy("doc_id").collect()] == label


def test_only_wide_stars_have_spokes(spark):
    rows = spark.createDataFrame([(1, p, 10 + p, 30) for p in range(3)] + [(2, p, 20 + p, 30) for p in range(5)] + [(3, 0, 7, 30), (3, 0, 8, 200)], "gram long, place int, node long, n long")
    got = {tuple(r) for r in jaccard_join.starred(rows.coalesce(1).sortWithinPartitions("gram", "place", "node"), 85, narrow=3).collect()}
    assert {r for r in got if r[0] < 20} == {(10, 11, jaccard_join.SPOKE), (10, 12, jaccard_join.SPOKE), (11, 12, jaccard_join.PAIR)}
    assert {r for r in got if r[2] == jaccard_join.WIDE} == {(20, 20 + k, jaccard_join.WIDE) for k in range(1, 5)}


def test_fewer_logarithms_give_the_same_samples(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(3 + 13 * i % 200))) for i in range(60)] + [(60, ""), (61, None), (61, "a b"), (None, "c d e"), (3, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda enough: sorted((tuple(r) for r in weighted_sampling.fingerprinted(docs, samples=16, enough=enough).collect()), key=str)
    every = of(float("inf"))
    assert of(weighted_sampling.ENOUGH) == of(0.5) == every and len(every) == len(rows)
    found = [weighted_sampling.sampled(docs, ["doc_id", "text"], "text", 16, enough) for enough in (0.5, 24.0)]
    assert found[0].where("whole").count() < 10 and found[1].where("not whole").count() == 0


def test_samples_are_not_shuffled(spark):
    """The samples of a text were shuffled twice, by keys that the join of the texts had dealt already."""
    docs = spark.createDataFrame([(i, f"a{i} b c d") for i in range(50)], "doc_id long, text string")
    rows = weighted_sampling.edited(docs)
    found = weighted_sampling.sampled(rows, ["_k", "_id", "_next"], "_edited", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("Aggregate"):plan.index("Join")]
    assert "Exchange" not in last and "min(" in last


def test_workers_keep_no_pieces_of_a_task(spark):
    docs = spark.range(4000, numPartitions=8).selectExpr("id AS doc_id", "concat('word', id, ' other', id % 97, ' thing') AS text")
    assert pieces.encoded(docs, queries.MODEL).where("n_tokens > 0").count() == 4000

    def held(batches):
        tool = pieces.backtracker(queries.MODEL)
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches) * 0 + len(tool.chunks) + len(tool.pairs)]})

    assert spark.range(64, numPartitions=8).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_remembered_chunks_are_bounded(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "CHUNKS", 8)
    model, own = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL), pieces.Backtracker(queries.MODEL)
    rng = np.random.default_rng(5)
    words = ["the", "house", "\n", "\x00", "漢", "☃☃", "▁", "a▁b", "éü", "", "😀"] + [f"w{i}" for i in range(20)]
    for _ in range(500):
        text = " ".join(rng.choice(words, rng.integers(0, 40)))
        ids = model.encode(text)
        assert own.ids_and_text(text) == (",".join(map(str, ids)), model.decode(ids)) and own.encode(text) == ids
        assert len(own.chunks) <= 8 and len(own.chunks.last) <= 8
    own.forget()
    assert not (own.chunks or own.chunks.last or own.chunks.other or own.pairs)


def test_plans_do_not_hold_the_sieve(spark):
    docs = spark.createDataFrame([(1, "the old bridge over the river was built by 40 men in a year")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Who said that the old bridge over the river was built by 30 men in a year?")], "item_id long, text string")
    sieve = decontamination.sieve_of(decontamination.windows(items, ["item_id"], "text", 8, []))
    places = decontamination.sieved_windows(docs, ["doc_id"], "text", 8, sieve, True)
    assert places.count() > 0
    assert len(places._jdf.queryExecution().executedPlan().toString()) < decontamination.SIEVE // 64
