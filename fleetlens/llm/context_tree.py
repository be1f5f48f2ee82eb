"""Context-tree weighting over bytes, trained on one part of a corpus and scored on all of it.

Each byte of a text (A-Z lower-cased, an end byte 0xFF added, zeros before the start) is cut into 8 binary decisions. The
decision at each place of the byte has a context tree of its own, whose nodes are the last 0 to 5 bytes. A node estimates
by Krichevsky and Trofimov from its counts; its weighted probability is half its own block probability plus half the
product of its children's, and bottom nodes have only their own. As block probabilities depend on counts alone, the
weights of a trained tree follow from the counts of 6-grams, in any order. A byte then costs the mixture over all depths
along its context; unseen nodes give one half.

How the work is spread: tasks count 6-grams (and words, for the base score) of what they read; counts are summed by key;
the trees below three last bytes, at most 2**24 rows each, are dealt to buckets of about ROWS rows; the levels above have at
most 255 rows for each pair of bytes, of which UTF-8 has under 2**16 and text a few thousand. Texts
are dealt to blocks of bounded size; a block asks only for the keys that it holds, by a shuffled join, so that no table
that grows with the corpus is broadcast or held by a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import input_bytes, stored
from fleetlens.llm.tokens import U, column_bytes, pieces, ragged, split_words

DEPTH = 5
END = 0xFF
#: Bytes of text of one block, about.
BLOCK = 24 << 20
#: Keys that a counting task holds before it hands them on.
HELD = 1 << 20
#: Rows of trees that one group works on, about.
ROWS = 1 << 19
#: Places that are looked up together, by 16 bits.
SPAN = 1 << 16
_WORD = U(1 << 63)
END_WORD = -1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BITS = [(b, 7 - b) for b in range(8)]


def gram_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): the 6-gram of every byte and of the end of each text; the symbol is the lowest byte, the context
    stands before it as in the text."""
    data, offsets = column_bytes(column)
    n = np.diff(offsets)
    ends = np.cumsum(n + DEPTH + 1)
    total = int(ends[-1]) if len(ends) else 0
    wide = np.zeros(total + 8, np.uint8)
    wide[ragged(ends - n - 1, n)] = _FOLD[data]
    wide[ends - 1] = END
    eight = np.ndarray((total,), ">u8", wide, strides=(1,)).astype(U) >> U(8 * (7 - DEPTH))
    # the window that ends at a symbol begins DEPTH places before it
    keep = np.ones(total, bool)
    keep[ragged(ends - DEPTH, np.full(len(ends), DEPTH))] = False
    return eight[keep].view(np.int64), np.concatenate([[0], np.cumsum(n + 1)])


def turned(keys: np.ndarray) -> np.ndarray:
    """Keys with their context bytes in reverse order: the nearest highest, as trees need them, and back."""
    out = keys & 255
    for k in range(1, DEPTH + 1):
        out |= (keys >> 8 * k & 255) << 8 * (DEPTH + 1 - k)
    return out


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): a negative key for each word, and the index of each text's first word."""
    words = split_words(*column_bytes(column))
    keys = (words.hashes(lower=True) | _WORD).view(np.int64)
    keys[keys == END_WORD] = -2
    return keys, words.first


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate), with the children's log product ``below``."""
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, below)
    return both - math.log(2), np.exp(own - both)


class Level:
    """Nodes of one decision at one depth: runs of equal ``context, decided bits`` in sorted keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        node = keys >> (bit + 1)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        one = (keys >> bit & 1).astype(bool)
        self.node, self.index = node[starts], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
        self.ones = np.add.reduceat(np.where(one, counts, 0), starts).astype(float)
        self.zeros = np.add.reduceat(np.where(one, 0, counts), starts).astype(float)
        self.one = one

    def estimate(self) -> np.ndarray:
        """Probability of each key's bit by its node's own counts."""
        seen = np.where(self.one, self.ones[self.index], self.zeros[self.index])
        return (seen + 0.5) / (self.zeros + self.ones + 1.0)[self.index]


def _without(keys: np.ndarray, byte: int) -> np.ndarray:
    """Keys without the context byte that stands ``byte`` bytes above the symbol."""
    low = (1 << 8 * byte) - 1
    return keys >> 8 * (byte + 1) << 8 * byte | keys & low


def _up(level: Level, lower: Level, log_lower: np.ndarray, merged: np.ndarray) -> np.ndarray:
    """For each node of ``level``: sum of its children's log probabilities. merged: node index in ``level`` of each key."""
    first = np.flatnonzero(np.r_[True, lower.index[1:] != lower.index[:-1]])
    return np.bincount(merged[first], log_lower, len(level.node))


def subtree(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, Level, np.ndarray, np.ndarray]]:
    """For each bit of the trees below three last bytes: (bit, depth-3 level, its log probabilities, mixture per key).

    keys are sorted 6-grams, those of three last bytes all together. The mixture covers depths 3 to 5, in the order of keys.
    """
    short = _without(keys, 1)
    order = np.argsort(short, kind="stable")
    short_sorted = short[order]
    pair = _without(short, 1)
    by_symbol = np.argsort(pair, kind="stable")
    pair_sorted = pair[by_symbol]
    for _, bit in _BITS:
        deep = Level(keys, counts, bit)
        mid, top = Level(short_sorted, counts[order], bit), Level(pair_sorted, counts[by_symbol], bit)
        at_mid, at_top = np.empty(len(keys), int), np.empty(len(keys), int)
        at_mid[order], at_top[by_symbol] = mid.index, top.index
        mix = deep.estimate()
        log_deep = log_kt(deep.zeros, deep.ones)
        log_mid, own_mid = weigh(mid.zeros, mid.ones, _up(mid, deep, log_deep, at_mid))
        below_top = np.bincount(_first(at_top[order], mid.index), log_mid, len(top.node))
        log_top, own_top = weigh(top.zeros, top.ones, below_top)
        for level, at, own, back in ((mid, at_mid, own_mid, order), (top, at_top, own_top, by_symbol)):
            guess = np.empty(len(keys))
            guess[back] = level.estimate()
            mix = own[at] * guess + (1 - own[at]) * mix
        yield bit, top, log_top, mix


def _first(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The value at the first place of each run of ``index``."""
    return values[np.flatnonzero(np.r_[True, index[1:] != index[:-1]])]


class Crown:
    """Depths 0 to 2: per two last bytes, decision and bit, what they add to the mixture and the share left for depth 3 on."""

    def __init__(self, rows: dict[str, list]):
        """rows: sums over depth-3 nodes by two last bytes (pair) and node (1 to 255): zeros, ones, below."""
        self.pairs, at = np.unique(np.array(rows["pair"], np.int64), return_inverse=True)
        node = np.array(rows["node"], int)
        zeros, ones, below = (np.zeros((len(self.pairs), 256)) for _ in range(3))
        zeros[at, node], ones[at, node], below[at, node] = rows["zeros"], rows["ones"], rows["below"]
        log_two, own_two = weigh(zeros, ones, below)
        c1 = self.pairs >> 8
        sums = [np.zeros((256, 256)) for _ in range(3)]
        for total, part in zip(sums, (zeros, ones, np.where(zeros + ones > 0, log_two, 0))):
            np.add.at(total, c1, part)
        z1, o1, below1 = sums
        log_one, own_one = weigh(z1, o1, below1)
        z0, o0 = z1.sum(0), o1.sum(0)
        _, own_root = weigh(z0, o0, np.where(z1 + o1 > 0, log_one, 0).sum(0))
        self.add = np.zeros((len(self.pairs), 256, 2))
        for b, (two, one, root) in enumerate(((zeros, z1, z0), (ones, o1, o0))):
            low = own_one[c1] * ((one + 0.5) / (z1 + o1 + 1))[c1] + (1 - own_one[c1]) * own_two * (two + 0.5) / (zeros + ones + 1)
            self.add[:, :, b] = own_root * (root + 0.5) / (z0 + o0 + 1) + (1 - own_root) * low
        self.rest = (1 - own_root) * (1 - own_one[c1]) * (1 - own_two)


def key_logs(keys: np.ndarray, counts: np.ndarray, crown: Crown) -> np.ndarray:
    """log10 probability of each 6-gram's symbol after its context; keys sorted, those of three last bytes all together."""
    out = np.zeros(len(keys))
    at, symbol = np.searchsorted(crown.pairs, keys >> 32), keys & 255
    for bit, _, _, mix in subtree(keys, counts):
        node = 1 << (7 - bit) | symbol >> (bit + 1)
        out += np.log10(crown.add[at, node, symbol >> bit & 1] + crown.rest[at, node] * mix)
    return out


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, n, len(found)).astype(np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[starts], np.diff(np.r_[starts, len(keys)])


def distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys; no more than about twice as many, and HELD, are held at a time."""
    held, size, kept = [np.zeros(0, np.int64)], 0, 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > 2 * kept + HELD:
            held = [np.unique(np.concatenate(held))]
            size = kept = len(held[0])
    return np.unique(np.concatenate(held))


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): counts of all 6-grams, words and ends of the texts of a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    ends = 0
    for batch in pieces(batches, "_text"):
        column = batch.column("_text")
        ends += len(column)
        held += [_counted(gram_keys(column)[0]), _counted(word_keys(column)[0])]
        if sum(len(k) for k, _ in held) > HELD:
            held = [_merge(held)]
            if len(held[0][0]) > HELD // 2:
                yield _table(key=held[0][0], n=held[0][1])
                held = []
    keys, n = _merge([*held, (np.array([END_WORD]), np.array([ends]))])
    yield _table(key=keys, n=n)


def scored(docs: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` (columns ``keep``) with n_tokens, n_known, train_tokens, base_score, score and n_bytes of each whole text.

    Learns from rows where ``train`` is true (null: not). score is the log10 probability of the text and its end;
    base_score that of its words under add-half word counts of the same rows. A null text counts as empty and has the end
    alone. Repeated rows are scored each; without rows to learn from, every bit costs one half. Columns of ``docs`` with
    the names of new ones are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))

    counts = rows.where("_train").select("_text").mapInArrow(count_keys, "key bigint, n bigint")
    known = stored(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"), "ctw-counts")
    totals = known.where("key < 0").agg(F.sum("n"), F.count("*")).first()
    n_all, n_distinct = totals[0] or 0, totals[1]

    blocks = max(1, -(-input_bytes(rows, "_text") // block))
    dealt = rows.drop("_train").withColumn(
        "_block", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keep[:1]], F.length("_text")), F.lit(blocks)).cast("int"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name in keep)

    def wanted(table: pa.Table) -> pa.Table:
        columns = (batch.column("_text") for batch in pieces(iter(table.to_batches()), "_text"))
        keys = distinct(_counted(of(column)[0])[0] for column in columns for of in (gram_keys, word_keys))
        block_id = table.column("_block")[0].as_py()
        return pa.table({"_block": pa.array(np.full(len(keys), block_id, np.int32)), "key": keys})

    asked = dealt.groupBy("_block").applyInArrow(wanted, "_block int, key bigint").repartition("key")
    # 6-grams that were asked for or counted; words need no tree
    grams = (
        asked.where("key >= 0").select("key").distinct().join(known.where("key >= 0"), "key", "full")
        .select("key", F.coalesce("n", F.lit(0)).alias("n"))
    )
    grams = stored(grams, "ctw-grams")
    buckets = max(1, -(-grams.count() // ROWS))
    grams = grams.withColumn("_bucket", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(buckets)).cast("int"))

    def in_tree_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = turned(table.column("key").to_numpy())
        order = np.argsort(keys)
        return keys[order], table.column("n").to_numpy()[order]

    def summed(table: pa.Table) -> pa.Table:
        keys, n = in_tree_order(table)
        out: dict[str, list] = {"at": [], "zeros": [], "ones": [], "below": []}
        for bit, top, log_top, _ in subtree(keys, n):
            out["at"].append((top.node >> (7 - bit) >> 8) << 8 | 1 << (7 - bit) | top.node & (1 << (7 - bit)) - 1)
            for name, v in (("zeros", top.zeros), ("ones", top.ones), ("below", log_top)):
                out[name].append(v)
        at, inverse = np.unique(np.concatenate(out.pop("at")), return_inverse=True)
        return pa.table({"pair": (at >> 8).astype(np.int32), "node": (at & 255).astype(np.int32)} | {
            k: np.bincount(inverse, np.concatenate(v), len(at)) for k, v in out.items()})

    by_pair = grams.groupBy("_bucket").applyInArrow(summed, "pair int, node int, zeros double, ones double, below double")
    crown_rows = by_pair.groupBy("pair", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    crown = docs.sparkSession.sparkContext.broadcast(Crown(crown_rows.toArrow().to_pydict()))  # 255 rows per pair of bytes at most

    def logs(table: pa.Table) -> pa.Table:
        keys, n = in_tree_order(table)
        return pa.table({"key": turned(keys), "v": key_logs(keys, n, crown.value)})

    values = grams.groupBy("_bucket").applyInArrow(logs, "key bigint, v double").unionByName(
        known.where("key < 0").select("key", F.col("n").cast("double").alias("v")))
    answers = asked.join(values, "key").select("_block", "key", "v")
    base = math.log10(n_all + 0.5 * (n_distinct + 1))
    ends = known.where(F.col("key") == END_WORD).first()
    ends = ends["n"] if ends else 0

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("key")
        keys, values = found.column("key").to_numpy(), found.column("v").to_numpy()
        first_gram = int(np.searchsorted(keys, 0))
        word_key, word_n = keys[:first_gram], values[:first_gram]
        gram_key, gram_v = keys[first_gram:], values[first_gram:]
        out = []
        for batch in pieces(iter(table.to_batches()), "_text"):
            column = batch.column("_text")
            grams_at, offsets = gram_keys(column)
            text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
            sums = np.zeros(len(offsets) - 1)
            for k in range(0, len(grams_at), SPAN):
                # sorted with its place packed below it, each distinct key is looked up once, in order
                packed = np.sort(grams_at[k : k + SPAN].view(U) << U(16) | np.arange(min(SPAN, len(grams_at) - k), dtype=U))
                part = (packed >> U(16)).view(np.int64)
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                at = np.searchsorted(gram_key, part[starts])
                if at[-1] >= len(gram_key) or (gram_key[at] != part[starts]).any():
                    raise RuntimeError("a block lacks keys that it asked for")
                logs_of = np.empty(len(part))
                logs_of[(packed & U(SPAN - 1)).view(np.int64)] = np.repeat(gram_v[at], np.diff(np.r_[starts, len(part)]))
                texts = text_of[k : k + SPAN]
                sums[texts[0] : texts[-1] + 1] += np.bincount(texts - texts[0], logs_of)
            words, first = word_keys(column)
            n = np.zeros(len(words))
            if len(word_key):
                place = np.minimum(np.searchsorted(word_key, words), len(word_key) - 1)
                hit = word_key[place] == words
                n[hit] = word_n[place[hit]]
            n_words = np.diff(first)
            doc = np.repeat(np.arange(len(n_words)), n_words)
            word_logs = np.bincount(doc, np.log10(n + 0.5), len(n_words)) + np.log10(ends + 0.5)
            out.append(pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {
                "n_tokens": pa.array(n_words + 1, pa.int64()),
                "n_known": pa.array(np.bincount(doc, n > 0, len(n_words)).astype(np.int64) + (ends > 0), pa.int64()),
                "train_tokens": pa.array(np.full(len(n_words), n_all, np.int64)),
                "base_score": pa.array(word_logs - base * (n_words + 1)),
                "score": pa.array(sums),
                "n_bytes": pa.array(np.diff(offsets) - 1, pa.int64()),
            }))
        return pa.Table.from_batches(out)

    schema = f"{types}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(score, schema)
