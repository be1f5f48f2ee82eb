"""Removal of word passages that occur earlier in the corpus, by FM-indexes of content shards.

A window is ``size`` consecutive words of one document; it is removed if the same words also start earlier: in a document
of smaller id, or earlier in the same document. Each word of a removed window goes.

1. A window's anchor is the smallest hash among its 6-grams. Equal windows have equal anchors, and the windows of a run
   share one. Rows (anchor, run) whose anchor stands at one place only drop out: their windows are unique. A task that meets an
   anchor repeatedly settles its runs itself and sends one witness, so that a common anchor sends a row per task.
2. The words of the remaining runs go to shards by anchor. Equal runs are reduced to their first one where they are
   written and again where they arrive; the others are removed whole.
3. Each shard indexes its distinct runs (FM-index, wavelet matrix) and searches all their windows backwards. Of the places
   in a window's suffix interval all but the earliest are removed. A shard larger than BLOCK words is indexed in blocks,
   each of which is searched for all windows.
4. Removed windows come back to their documents.

Documents are shuffled by id once; that exchange serves steps 2 and 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.fm_index import FMIndex
from fleetlens.llm.shared import input_bytes
from fleetlens.llm.tokens import BASE, U, Words, grams, mix, pieces, ragged, split_words, words_of

GRAM = 6
#: Words of a block's index at most (a longer single run makes a block of its own).
BLOCK = 1 << 21
#: Bytes of all texts per shard, about.
SHARD = 2 << 20
LAST = (1 << 63) - 1


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have :]) if have < w else out


def runs_of(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(anchor, text, first word, windows, whether the anchor stands twice in it) of the runs of windows that share an anchor."""
    if len(hashes) < size:
        return tuple(np.zeros(0, t) for t in (U, int, int, int, bool))
    every = grams(hashes, GRAM)
    anchor = _window_minimum(every, size - GRAM + 1)
    doc = words.doc
    valid = doc[: len(anchor)] == doc[size - 1 :]
    begins = valid.copy()
    begins[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1 : len(anchor)] == doc[: len(anchor) - 1]))
    starts = np.flatnonzero(begins)
    # a run ends before the next one or where windows stop being valid
    stops = np.flatnonzero(valid & ~np.r_[valid[1:] & ~begins[1:], False]) + 1
    spans = stops - starts + size - GRAM
    same = every[ragged(starts, spans)] == np.repeat(anchor[starts], spans)
    twice = np.add.reduceat(same.astype(np.int32), np.cumsum(spans) - spans) > 1 if len(spans) else np.zeros(0, bool)
    return anchor[starts], doc[starts], starts - words.first[doc[starts]], stops - starts, twice


_RUN = "doc bigint, twin bigint, first int, windows int"


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, kind, doc, twin, first, windows): kind 0 asks whether the anchor comes again, 1 bears witness, 2 is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            words = words_of(batch, "_text")
            anchor, doc, first, windows, twice = runs_of(words, words.hashes(), size)
            _, at, inverse, counts = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            often = np.bincount(inverse, 1 + twice, len(counts)) > 1
            kind = np.where(often[inverse], 2, 0)
            witness = at[often]
            take = np.r_[np.arange(len(anchor)), witness]
            yield pa.RecordBatch.from_pydict({
                "anchor": anchor[take].view(np.int64), "kind": np.r_[kind, np.ones(len(witness), int)].astype(np.int32),
                "doc": batch.column("doc").take(pa.array(doc[take])), "twin": batch.column("twin").take(pa.array(doc[take])),
                "first": first[take].astype(np.int32), "windows": windows[take].astype(np.int32)})

    return docs.mapInArrow(run, f"anchor bigint, kind int, {_RUN}")


def repeated(rows: DataFrame) -> DataFrame:
    """Runs whose anchor comes more than once; of rows sorted by anchor only one is held back."""
    dealt = rows.repartition(F.when(F.col("kind") == 2, F.xxhash64("doc", "first")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            settled = batch.filter(pa.compute.equal(batch.column("kind"), 2))
            if settled.num_rows:
                yield settled
            batch = batch.filter(pa.compute.not_equal(batch.column("kind"), 2))
            if not batch.num_rows:
                held = None
                continue
            anchor, kind = batch.column("anchor").to_numpy(), batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            lengths = np.diff(np.r_[starts, len(anchor)])
            out = np.repeat(lengths > 1, lengths) & (kind == 0)
            # the last row may still be met by the next batch; met already, it goes on as a witness
            held = batch.slice(len(anchor) - 1, 1)
            if lengths[-1] > 1:
                held = held.set_column(held.schema.get_field_index("kind"), "kind", pa.array([1], pa.int32()))
            else:
                out[-1] = False
            yield batch.filter(pa.array(out))

    names = ["anchor", "kind", "doc", "twin", "first", "windows"]
    return dealt.select(*names).mapInArrow(run, f"anchor bigint, kind int, {_RUN}").drop("kind")


def run_texts(rows: DataFrame, size: int, shards: int) -> DataFrame:
    """(shard, doc, twin, first, windows, words): words of each run that is the first of its kind here, null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            words = words_of(batch, "_text")
            hashes = words.hashes()
            lists = batch.column("_runs")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            first, windows, anchor = (flat.field(k).to_numpy() for k in ("first", "windows", "anchor"))
            start = words.first[row] + first
            n = windows + size - 1
            doc, twin = batch.column("doc").to_numpy()[row], batch.column("twin").to_numpy()[row]
            same = _range_hashes(hashes, start, n)
            by = np.lexsort((first, twin, doc, same))
            fresh = np.r_[True, same[by][1:] != same[by][:-1]]
            lead = np.zeros(len(by), bool)
            lead[by[fresh]] = True
            # a row given twice is one place
            place = [x[by] for x in (doc, twin, first)]
            again = ~fresh & np.all([np.r_[False, x[1:] == x[:-1]] for x in place], axis=0)
            keep = np.sort(by[~again])
            start, n, doc, twin, first, windows, anchor, lead = (x[keep] for x in (start, n, doc, twin, first, windows, anchor, lead))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.where(lead, (anchor.view(U) % U(shards)).astype(np.int64), doc % shards), pa.int64()),
                "doc": doc, "twin": twin, "first": first.astype(np.int32), "windows": windows.astype(np.int32),
                "words": _joined(words, start[lead], n[lead], lead)})

    return rows.mapInArrow(run, f"shard bigint, {_RUN}, words binary")


def _range_hashes(hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of each range of words, its length included."""
    index = ragged(start, n)
    at = index - np.repeat(start, n)
    parts = mix(hashes[index] + at.astype(U) * U(BASE))
    return mix(np.add.reduceat(parts, np.cumsum(n) - n) + n.astype(U)) if len(n) else np.zeros(0, U)


def _joined(words: Words, start: np.ndarray, n: np.ndarray, lead: np.ndarray) -> pa.Array:
    """Words of ranges with one space after each, as binary values; null where ``lead`` is false."""
    index = ragged(start, n)
    size = words.end[index] - words.start[index]
    ends = np.cumsum(size + 1)
    data = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    data[ragged(ends - size - 1, size)] = words.data[ragged(words.start[index], size)]
    cuts = np.zeros(len(lead) + 1, np.int64)
    lengths = np.zeros(len(lead), np.int64)
    lengths[lead] = np.add.reduceat(size + 1, np.cumsum(n) - n) if len(n) else 0
    cuts[1:] = np.cumsum(lengths)
    valid = pa.py_buffer(np.packbits(lead, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(lead), [valid, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class Shard:
    """Distinct runs of one shard, each at its earliest place; what comes later is given back as removed."""

    def __init__(self, size: int):
        self.size = size
        self.place: dict[int, int] = {}
        self.at: list[tuple[int, int, int, int]] = []
        self.text: list[bytes] = []

    def add(self, rows: list[tuple[int, int, int, int]], texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        later = []
        for row, text in zip(rows, texts):
            key = int.from_bytes(hashlib.blake2b(text, digest_size=16).digest(), "little")
            k = self.place.setdefault(key, len(self.at))
            if k == len(self.at):
                self.at.append(row)
                self.text.append(text)
            elif row[:3] == self.at[k][:3]:
                continue  # a row given twice
            elif row[:3] < self.at[k][:3]:
                later.append(self.at[k])
                self.at[k] = row
            else:
                later.append(row)
        return later

    def search(self) -> list[tuple[int, int, int, int]]:
        """Removed windows of the distinct runs."""
        if not self.at:
            return []
        words = split_words(np.frombuffer(b"".join(self.text), np.uint8), np.r_[0, np.cumsum([len(t) for t in self.text])])
        symbols = np.unique(words.hashes(), return_inverse=True)[1] + 1
        row = np.array(self.at, np.int64)
        n = words.count
        # a zero after each run keeps windows within runs
        text = np.zeros(len(symbols) + len(n), np.int64)
        begin = words.first[:-1] + np.arange(len(n))
        text[ragged(begin, n)] = symbols
        run_of = np.repeat(np.arange(len(n)), row[:, 3])
        window = ragged(begin, row[:, 3])
        first = row[run_of, 2] + (window - begin[run_of])
        age = np.empty(len(window), np.int64)
        age[np.lexsort((first, row[run_of, 1], row[run_of, 0]))] = np.arange(len(window))
        age_at = np.full(len(text), LAST)
        age_at[window] = age
        removed = np.zeros(len(window), bool)
        cut = np.r_[0, np.flatnonzero(np.diff((begin + n) // BLOCK)) + 1, len(n)]
        for a, b in zip(cut, cut[1:]):
            lo, hi = begin[a], begin[b - 1] + n[b - 1] + 1
            whole = len(cut) == 2
            # other blocks' windows are looked for by putting them behind this block's text
            part = text[lo:hi]
            index = FMIndex(part, self.size)
            inside = (window >= lo) & (window < hi)
            which, low, high = index.search(part, window[inside] - lo, self.size)
            removed[np.flatnonzero(inside)[which]] |= self._later(index, age_at[lo:hi], age[inside][which], low, high)
            if not whole:
                self._other_blocks(index, part, age_at[lo:hi], text, window, age, inside, removed)
        edge = removed & ~np.r_[False, removed[:-1] & (run_of[1:] == run_of[:-1])]
        stop = removed & ~np.r_[removed[1:] & (run_of[1:] == run_of[:-1]), False]
        starts, stops = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        return [(int(row[run_of[s], 0]), int(row[run_of[s], 1]), int(first[s]), int(e - s)) for s, e in zip(starts, stops)]

    @staticmethod
    def _later(index: FMIndex, age_at: np.ndarray, age: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each window's interval holds an earlier place."""
        if not len(low):
            return np.zeros(0, bool)
        ages = np.r_[age_at[index.order], LAST]
        lows, at = np.unique(low, return_index=True)
        bounds = np.c_[lows, high[at]].ravel()
        return np.minimum.reduceat(ages, bounds)[::2][np.searchsorted(lows, low)] < age

    def _other_blocks(self, index, part, age_at, text, window, age, inside, removed) -> None:
        """Search the windows of other blocks in this one."""
        top = len(index.start) - 2
        others = np.flatnonzero(~inside & ~removed)
        symbol = lambda k: text[window[others] + k]
        last = symbol(self.size - 1)
        known = last <= top
        others, last = others[known], last[known]
        low, high = index.start[last], index.start[last + 1]
        for k in range(self.size - 2, -1, -1):
            s = text[window[others] + k]
            on = (high > low) & (s <= top)
            others, s, low, high = others[on], s[on], low[on], high[on]
            base = index.start[s] - index.base[s]
            low, high = base + index.matrix.descend(s, low), base + index.matrix.descend(s, high)
        on = high > low
        others, low, high = others[on], low[on], high[on]
        removed[others] |= self._later(index, age_at, age[others], low, high)


def sharded(rows: DataFrame, size: int) -> DataFrame:
    """(doc, twin, first, windows): runs of windows to remove."""
    dealt = rows.repartition("shard").sortWithinPartitions("shard")

    def table(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(
            ("doc", "twin", "first", "windows"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, Shard(size)
        for batch in batches:
            plain = batch.filter(pa.compute.is_null(batch.column("words")))
            if plain.num_rows:
                yield plain.select(["doc", "twin", "first", "windows"])
            batch = batch.filter(pa.compute.is_valid(batch.column("words")))
            ids = batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if ids[a] != at:
                    yield table(shard.search())
                    at, shard = ids[a], Shard(size)
                part = batch.slice(a, b - a)
                rows = list(zip(*[part.column(c).to_pylist() for c in ("doc", "twin", "first", "windows")]))
                yield table(shard.add(rows, part.column("words").to_pylist()))
        yield table(shard.search())

    return dealt.mapInArrow(run, _RUN)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 20, keep_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256 and, if ``keep_text``, kept) for each row of ``docs``.

    kept is what is left of the words, joined by one space. A null text has no words. Rows of the same key are ordered by
    a hash of their texts; repeated rows, equal in both, count as one document and come out alike. A null key counts as
    the largest long, 2**63 - 1, and comes out null.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("twin"), F.col(text).alias("_text"))
    shards = max(1, -(-input_bytes(rows, "_text") // SHARD))
    found = repeated(anchors(rows.select("doc", "twin", "_text"), size)).groupBy("doc", "twin").agg(
        F.collect_list(F.struct("first", "windows", "anchor")).alias("_runs"))
    texts = run_texts(rows.join(found, ["doc", "twin"]).select("doc", "twin", "_text", "_runs"), size, shards)
    removed = sharded(texts, size).groupBy("doc", "twin").agg(F.collect_list(F.struct("first", "windows")).alias("_removed"))
    both = rows.join(removed, ["doc", "twin"], "left").select("doc", "_text", "_removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            words = words_of(batch, "_text")
            lists = batch.column("_removed")
            row = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            start = words.first[row] + flat.field("first").to_numpy()
            steps = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + flat.field("windows").to_numpy() + size - 1, -1)
            gone = np.cumsum(steps)[:-1] > 0
            n_gone = np.bincount(words.doc[gone], minlength=len(words.count))
            left = np.flatnonzero(~gone)
            width = words.end[left] - words.start[left]
            ends = np.cumsum(width + 1)
            data = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            data[ragged(ends - width - 1, width)] = words.data[ragged(words.start[left], width)]
            cut = np.r_[0, ends][np.searchsorted(left, words.first)]
            kept = [data[a : max(a, b - 1)].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc": pa.array(batch.column("doc").to_numpy(), mask=batch.column("doc").to_numpy() == LAST),
                "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            } | ({"kept": pa.array([k.decode() for k in kept], pa.string())} if keep_text else {}))

    schema = "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text
    return both.mapInArrow(run, schema).withColumnRenamed("doc", key)
