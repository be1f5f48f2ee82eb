"""Language identification: whole words first, then shorter and shorter character n-grams for words not seen in training.

A word is a run of letters, in lower case. A known word is scored by its log relative frequency in each language. An
unseen word, with its ends marked, is cut into n-grams of 5 characters; if none of them is known, of 4, and so on down to
1, and the mean log relative frequency of the known ones counts. The scores of all words are added up.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}+")
LONGEST = 5
#: Training rows of each language at most, taken by a hash of the id; bounds the model.
SAMPLE = 800
#: A word is known if the training rows of all languages hold it so often.
KNOWN = 2
#: Rows of the score matrix of a task.
CACHE = 1 << 18
#: Leading bits of the hash by which rows are counted.
LEAD_BITS = 16


def words_in(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower())


@dataclass
class Model:
    """languages in order; rows of ``logs`` (a value for each language) of known words and of n-grams by length."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    logs: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.logs[known]
        marked = f"\x02{word}\x03"
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            found = [at for k in range(len(marked) - n + 1) if (at := table.get(marked[k : k + n])) is not None]
            if found:
                return self.logs[found].sum(axis=0) / len(found)
        return np.zeros(len(self.languages))


class _Counts:
    """Counts of texts, a number for each language, in one array; row: the place of each text."""

    def __init__(self, languages: int):
        self.row: dict[str, int] = {}
        self.none, self.flat = array("q", [0] * languages), array("q")

    def add(self, text: str, language: int, n: int) -> None:
        at = self.row.setdefault(text, len(self.row)) * len(self.none)
        if at == len(self.flat):
            self.flat.extend(self.none)
        self.flat[at + language] += n

    def values(self) -> np.ndarray:
        return np.array(self.flat, dtype=np.float64).reshape(len(self.row), len(self.none))


def _logs(values: np.ndarray) -> np.ndarray:
    return np.log((values + 0.5) / (values.sum(axis=0) + 0.5 * (len(values) + 1)))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Model from ``sample`` rows of each language at most, those with the smallest hash of the key.

    Rows without text, language or key are left out. Rows are counted by language and leading bits of the hash first; only
    those up to the bits that complete the sample are ranked, each task handing on ``sample`` rows of a language at most.
    Words are counted by Spark; what comes to the driver is bounded by the sampled texts.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    rows = rows.where("_lang is not null and _text is not null and _key is not null")
    hashed = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("_key"), 1)).withColumn("_lead", F.shiftright("_h", 63 - LEAD_BITS))
    counts = hashed.groupBy("_lang", "_lead").agg(F.count("*").alias("_rows"))
    counts = counts.selectExpr("_lang", "_lead", "sum(_rows) over (partition by _lang order by _lead) as _upto")
    last = counts.groupBy("_lang").agg(F.coalesce(F.min(F.when(F.col("_upto") >= sample, F.col("_lead"))), F.max("_lead")).alias("_last"))
    some = hashed.join(F.broadcast(last), "_lang").where("_lead <= _last")
    order = "row_number() over (partition by _lang order by _h, _key, _text) as _n"
    picked = some.selectExpr("_lang", "_text", order).where(F.col("_n") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for language, value in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                found[language].update(words_in(value))
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k for k, v in found.items() for _ in v], pa.string()),
            "word": pa.array([w for v in found.values() for w in v], pa.string()),
            "n": pa.array([n for v in found.values() for n in v.values()], pa.int64()),
        })

    counted = picked.select("_lang", "_text").mapInArrow(count, "lang string, word string, n bigint")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(counted["lang"]))
    place = {x: i for i, x in enumerate(languages)}
    tables = [_Counts(len(languages)) for _ in range(LONGEST + 1)]  # words, then n-grams by length
    for language, word, n in zip(*counted.values()):
        i, marked = place[language], f"\x02{word}\x03"
        tables[0].add(word, i, n)
        for size in range(1, LONGEST + 1):
            for k in range(len(marked) - size + 1):
                tables[size].add(marked[k : k + size], i, n)
    del counted
    values = [t.values() for t in tables]
    often = values[0].sum(axis=1) >= KNOWN
    at, index = int(often.sum()), [{w: k for k, w in enumerate(w for w, row in tables[0].row.items() if often[row])}, {}]
    for table in tables[1:]:
        for text in table.row:
            table.row[text] += at
        at += len(table.row)
        index.append(table.row)
    return Model(languages, index[0], index[1:], np.concatenate([_logs(v) for v in (values[0][often], *values[1:])]))


class _Rows(dict):
    """Row of the score matrix for each word met; empties itself when full."""

    def __init__(self, model: Model):
        self.model, self.scores = model, np.zeros((CACHE, len(model.languages)), np.float64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.scores[at] = self.model.of_word(word)
        return at


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with lang_pred and score.

    lang_pred is the language with the largest sum (the first by name of equals); ``und`` with score 0 if the text is
    null or empty, has no letter, or nothing was learned. score is the softmax over languages of the mean log score per
    word, so 1/languages when nothing tells them apart. Columns of ``docs`` with these names are replaced. Repeated rows come
    out as often as they came in.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = _Rows(shared.value)
        languages = rows.model.languages
        for batch in texts:
            names, scores = [], []
            for value in batch:  # one text at a time becomes a Python string
                value = value.as_py()
                words = words_in(value) if value and languages else []
                if not words:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(languages))
                for k in range(0, len(words), CACHE // 4):
                    if len(rows) > CACHE // 2:
                        rows.clear()
                    part = words[k : k + CACHE // 4]
                    total += rows.scores[[rows[w] for w in part]].sum(axis=0)
                best = int(total.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp((total - total[best]) / len(words)).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # only texts go to Python and only results come back; not deterministic, so that a filter does not ask twice
    asked = docs.select(*[F.col(f"`{c}`") for c in kept], found.asNondeterministic()(F.col(text)).alias("_found"))
    return asked.select(*[F.col(f"`{c}`") for c in kept], "_found.lang_pred", "_found.score")
