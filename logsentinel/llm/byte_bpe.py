"""Byte-level BPE, encoded without running the merges one by one.

A text is cut into pieces by the tokenizer's pattern. Of a piece, read as Latin-1 so that each byte is one character, an
Aho-Corasick automaton of the vocabulary finds the longest token at each byte. The merges give the one sequence of tokens
in which each neighbouring pair is what the merges leave of the two tokens' bytes; so tokens are taken longest first, kept
where they go with the token before them, and shortened or taken back where not. A place from which no sequence reached
the end is never entered again and a token has few prefixes, so the time is linear in the piece. Which pairs go together
depends on the vocabulary alone and is remembered.

Rows: a null or empty text has no tokens, and decodes to no bytes. Ids, texts and repeated rows may be anything; other
columns are not read. A piece may be as long as the text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

#: A vocabulary is sent to every executor; files above this size are refused.
MOST_BYTES = 16 << 20
#: Pieces of at most so many characters are remembered, so many of them; and so many pairs of tokens.
SHORT, PIECES, PAIRS = 48, 400_000, 500_000
#: Longer texts are cut piece by piece, without a list of all pieces.
LONG = 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file: a line for each token, its bytes in base64, then its rank, which is its id."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


class Vocabulary:
    """Tokens by id, the automaton, and each token's parts and next shorter prefix."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.bytes = {i: t for t, i in self.ids.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for rank in sorted(self.bytes):
            token = self.bytes[rank]
            if len(token) == 1 or self._split(rank, token):
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        reached = {r for _, r in self.automaton.values()}
        for rank in reached:
            token = self.bytes[rank]
            for n in range(len(token) - 1, 0, -1):
                if (short := self.ids.get(token[:n])) in reached:
                    self.shorter[rank] = short
                    break
        self.automaton.make_automaton()
        self._pairs.clear()
        self.size = {i: len(t) for i, t in self.bytes.items()}
        self._length = np.zeros(max(self.bytes) + 1, np.int64)
        self._length[list(self.size)] = list(self.size.values())
        self._start = np.cumsum(self._length) - self._length
        self._flat = np.frombuffer(b"".join(self.bytes[i] for i in sorted(self.bytes)), np.uint8)

    def _split(self, rank: int, token: bytes) -> bool:
        """The two earlier tokens that the merges join to this one; False if they never make it."""
        for n in range(1, len(token)):
            a, b = self.ids.get(token[:n]), self.ids.get(token[n:])
            if a is not None and b is not None and a < rank and b < rank and self._made(a) and self._made(b) and self.together(a, b):
                self.parts[rank] = (a, b)
                self.merged[a, b] = rank
                return True
        return False

    def _made(self, rank: int) -> bool:
        return rank in self.parts or len(self.bytes[rank]) == 1

    def together(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart: no earlier merge joins the end of a to the start of b.

        The last merge of the two is undone again and again; whatever then stands at the border would have been joined
        before, if its merge comes before those undone."""
        key = (a, b)
        known = self._pairs.get(key)
        if known is not None:
            return known
        x, y, before = a, b, None  # before: rank of the merge undone last; only earlier ones, or those further left, count
        ok = True
        while True:
            joined = self.merged.get((x, y))
            if joined is not None and (before is None or joined < before):
                ok = False
                break
            deep_x, deep_y = x in self.parts, y in self.parts
            if not deep_x and not deep_y:
                break
            if deep_x and (x > y or not deep_y):
                before, x = x, self.parts[x][1]  # equal ranks: the left one is merged first, so this one's own rank is too late
            else:
                before, y = y + 1, self.parts[y][0]
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece of a text, which is not empty."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        latin, n, pairs = piece.decode("latin-1"), len(piece), self._pairs
        greedy = [t for _, (_, t) in self.automaton.iter_long(latin)]
        for pair in zip(greedy, greedy[1:]):  # noqa: B905, RUF007
            fits = pairs.get(pair)
            if not (self.together(*pair) if fits is None else fits):
                break
        else:
            if sum(map(self.size.__getitem__, greedy)) == n:  # no other sequence of such pairs makes up the piece
                return greedy
        longest = [0] * n
        size = [0] * n
        for last, (k, rank) in self.automaton.iter(latin):
            at = last - k + 1
            if k > size[at]:
                size[at], longest[at] = k, rank
        sizes, dead = self.size, set()
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + sizes[token]
            if end in dead:
                fits = False
            elif out:
                fits = pairs.get((out[-1], token))
                if fits is None:
                    fits = self.together(out[-1], token)
            else:
                fits = True
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids; an id that is no token's is an error."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self._length) or not self._length[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            n = self._length[part]
            end = np.cumsum(n)
            out.append(self._flat[np.repeat(self._start[part] - end + n, n) + np.arange(end[-1])].tobytes())
        return b"".join(out)


class Encoder:
    """Texts to packed ids (little-endian, 32 bits); frequent pieces are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern)
        self._known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.vocabulary.encode(piece.encode())
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self._known) >= PIECES:
                self._known.clear()
            self._known[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        pieces = self.pieces.findall(text) if len(text) <= LONG else (m[0] for m in self.pieces.finditer(text))
        get, make = self._known.get, self._piece
        return b"".join([get(p) or make(p) for p in pieces])


@lru_cache(maxsize=2)
def _loaded(data: bytes, pattern: str = "") -> Encoder:
    """Kept for a worker's next tasks."""
    return Encoder(Vocabulary(data), pattern)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text as (id_col, ids): little-endian unsigned 32-bit integers in one binary value, which holds a text of
    any length. ranks: path of the rank file; pattern: what cuts a text into pieces."""
    slim = _texts(docs, id_col, text_col)
    sent = slim.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(sent.value, pattern)
        for b in batches:
            ids = [coder.encode(t.as_py() or "") for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema['_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids) back to (id_col, bytes); null ids decode to no bytes, an id that is no token's is an error."""
    slim = encoded.select(F.col(id_col).alias("_id"), "ids")
    sent = slim.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(sent.value).vocabulary
        for b in batches:
            out = [vocabulary.decode(i.as_py() or b"") for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema['_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both ways in one pass: (id_col, ids, bytes)."""
    slim = _texts(docs, id_col, text_col)
    sent = slim.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(sent.value, pattern)
        for b in batches:
            ids = [coder.encode(t.as_py() or "") for t in b.column("_text")]
            back = [coder.vocabulary.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[id_col, "ids", "bytes"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema['_id'].dataType.simpleString()}, ids binary, bytes binary")
