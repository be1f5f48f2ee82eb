"""SentencePiece encoding and decoding by backtracking over longest matches.

The text gets a leading space and spaces become U+2581; a merge-type model whose pieces hold U+2581 only at their start
never joins a character to the space after it, so a text falls into chunks (spaces, then other characters) that encode on
their own. A chunk is covered from the left by the longest piece that an Aho-Corasick automaton finds at the place; a
piece may follow another only if merging the characters of both by score gives back just these two. Where no piece fits,
the place is marked in a bitfield of failed positions and the piece before it is shortened. Characters that no piece
holds become their UTF-8 bytes.

Equal chunks of a task are encoded once, as far as a bounded memory holds them; it only saves time. A worker outlives its
task and serves other operators too, so nothing but the model itself stays in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tokens import pieces as parts

SPACE = "▁"
#: Most chunks of either generation, and most pairs of pieces, that are remembered.
CHUNKS = 1 << 17
PAIRS = 1 << 18


class Chunks(dict[str, str]):
    """Ids, joined by commas, of chunks met; ``other`` holds the text of those that do not decode to themselves.

    A full generation becomes the last one, from which chunks that are met again come back, so common ones are never lost.
    """

    def __init__(self, tool: Backtracker):
        super().__init__()
        self.tool, self.last, self.other = tool, {}, {}

    def __missing__(self, chunk: str) -> str:
        if len(self) >= CHUNKS:  # other stays: the text at hand may need it
            self.last = self.copy()
            self.clear()
        found = self.last.get(chunk)
        if found is None:
            ids = self.tool.chunk_ids(chunk)
            if self.tool.odd(ids) and (text := self.tool.text_of(ids)) != chunk.replace(SPACE, " "):
                self.other[chunk] = text
            found = ",".join(map(str, ids))
        self[chunk] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.last.clear()
        self.other.clear()


class Backtracker:
    """Encoder and decoder for one merge-type model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        self.byte_id = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.unk_id()
        self.spelled = 1 + max([self.unknown, *self.byte_of], default=-1)
        self.silent = {i for i in ids if model.is_control(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece joins characters over a space")
        self.letters = {c for p in self.id_of for c in p}
        self.inside = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        if any(c not in self.id_of for c in self.letters):
            raise ValueError("a character occurs only inside longer pieces")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks = Chunks(self)
        self.matches = ahocorasick.Automaton()
        # a piece that its own merges do not give can never come out
        usable = {p for p in self.id_of if self.merged(p) == [p]}
        for p in usable:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), None) for p in usable}
        cut = "" if "\n" in self.letters else "\n"
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + ("|\n" if cut else ""))

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` after all merges: best score first, the leftmost of equals."""
        out, score, low = list(text), self.score.get, float("-inf")
        gain = [score(a + b, low) for a, b in zip(out, out[1:])]
        while gain:
            best = max(gain)
            if best == low:
                break
            i = gain.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score(out[i - 1] + out[i], low)
            if i < len(gain):
                gain[i] = score(out[i] + out[i + 1], low)
        return out

    def fits(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def cover(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are pieces."""
        whole, fits = [text[end + 1 - size : end + 1] for end, size in self.matches.iter_long(text)], self.fits
        for left, right in zip(whole, whole[1:]):
            if not fits(left, right):
                break
        else:  # the longest matches, one after another, already agree
            return whole
        out: list[str] = []
        at, failed, n = 0, 0, len(text)
        piece: str | None = whole[0]
        while at < n:
            while piece is not None:
                if not failed >> (at + len(piece)) & 1 and (not out or fits(out[-1], piece)):
                    break
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                if at < n:
                    piece = text[at : at + next(self.matches.iter_long(text, at))[1]]
                continue
            failed |= 1 << at
            if not out:
                raise ValueError(f"no encoding of {text!r}")
            piece = out.pop()
            at -= len(piece)
            piece = self.shorter[piece]
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one chunk. No piece reaches over two neighbours that stand side by side in none, so it is cut there."""
        if chunk in self.shorter:
            return [self.id_of[chunk]]
        ids: list[int] = []
        at, inside, n = 0, self.inside, len(chunk)
        for k in range(1, n + 1):
            if k == n or chunk[k - 1 : k + 1] not in inside:
                if k - at == 1:
                    i = self.id_of.get(chunk[at])
                    ids += [i] if i is not None else [self.byte_id.get(b, self.unknown) for b in chunk[at].encode()]
                else:
                    ids += map(self.id_of.__getitem__, self.cover(chunk[at:k]))
                at = k
        return ids

    def odd(self, ids: list[int]) -> bool:
        """Whether ids hold bytes or unknown pieces; all others spell their chunk."""
        return min(ids) < self.spelled

    def text_of(self, ids: list[int]) -> str:
        """Text of ids, the leading space kept."""
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is not None and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.names[i].replace(SPACE, " "))
        return "".join(out)

    def ids_and_text(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, what they decode to)"""
        if not text:
            return "", ""
        chunks, marked = self.chunks, SPACE + text.replace(" ", SPACE)
        if len(chunks.other) >= CHUNKS:
            chunks.forget()
        found = self.cut.findall(marked)
        ids = ",".join(map(chunks.__getitem__, found))
        if chunks.other and not chunks.other.keys().isdisjoint(found):
            return ids, "".join([chunks.other[c] if c in chunks.other else c.replace(SPACE, " ") for c in found])[1:]
        return ids, marked.replace(SPACE, " ")[1:]

    def forget(self) -> None:
        """Leaves the model only."""
        self.chunks.forget()
        self.pairs.clear()

    def encode(self, text: str) -> list[int]:
        ids, _ = self.ids_and_text(text)
        return [*map(int, ids.split(","))] if ids else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library gives it: without the space that encoding put before the text."""
        text = self.text_of(ids)
        return text[1:] if text[:1] == " " else text


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that starts no valid character is U+FFFD."""
    out = []
    at = 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def backtracker(path: str) -> Backtracker:
    return Backtracker(path)


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, keep_ids: bool = True) -> DataFrame:
    """``docs`` (columns ``keep``) with n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, ids and decoded.

    ids are joined by commas. A null text counts as empty: no ids, empty decoded text. Repeated rows stay. Columns of
    ``docs`` with the names of new ones are replaced. Texts are handled row by row within a task; nothing is shuffled, and
    every executor reads the model file.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_whole"))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_whole"]
        + [f"{c} {'bigint' if c == 'n_tokens' else 'string'}" for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = backtracker(path)
        try:
            for batch in parts(batches, "_whole", 1 << 23):
                out: dict[str, list] = {c: [] for c in new}
                for value in batch.column("_whole"):
                    ids, decoded = tool.ids_and_text(value.as_py() or "")
                    n = ids.count(",") + 1 if ids else 0
                    row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded)
                    for c, v in zip(new, row):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {
                    c: pa.array(v, pa.int64() if c == "n_tokens" else pa.string()) for c, v in out.items()})
        finally:
            tool.forget()

    return source.mapInArrow(run, schema)
