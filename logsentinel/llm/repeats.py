"""Repeated windows of tokens across a corpus, by content-defined runs.

A window is ``length`` consecutive tokens of one document. Its anchor is its smallest ``gram``-token hash, so
equal windows have equal anchors wherever they stand. Consecutive windows with the same anchor form a run. An
anchor that occurs in one run only proves all windows of that run unique, which discards nearly everything
after one aggregation of some 2 / (length - gram + 2) rows a token; no window that repeats is ever discarded.

``Lookup`` hands a table of 64-bit keys to the passes over the documents: as a broadcast when its counted
size is at most ``BROADCAST_BYTES``, else through a join that gives each document the entries it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, staged
from .tokens import U64, Rolling, sliding_min

#: A lookup table of more bytes than this (8 for each column of each row) is joined, not broadcast.
BROADCAST_BYTES = 96_000_000


@dataclass
class Runs:
    roll: Rolling
    anchor: np.ndarray  # hash that the windows of each run share
    start: np.ndarray  # first window of each run, as an index of tokens
    windows: np.ndarray  # number of windows
    content: np.ndarray  # hash of all tokens that the windows cover
    twice: np.ndarray  # anchors that occur twice within one run


def runs_of(tokens: np.ndarray, first: np.ndarray, length: int, gram: int, only: np.ndarray | None = None, twice: bool = False) -> Runs:
    """Runs of the documents whose tokens start at first[:-1]. only: a mask of the window starts that take part;
    twice: also look for anchors that stand twice in one run."""
    width = length - gram + 1
    roll = Rolling(tokens)
    grams = roll.grams(gram)
    low = sliding_min(grams, width)
    n = len(low)
    none = np.zeros(0, np.int64)
    if not n:
        return Runs(roll, none.view(U64), none, none, none.view(U64), none.view(U64))
    step = np.zeros(n + 1, np.int64)
    begin = np.minimum(first[:-1], n)
    np.add.at(step, begin, 1)
    np.add.at(step, np.minimum(np.maximum(first[1:] - length + 1, first[:-1]), n), -1)
    valid = np.cumsum(step)[:-1] > 0
    if only is not None:
        valid &= only[:n]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    new[begin[begin < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    start, end = start[valid[start]], end[valid[start]]
    content = roll.ranges(start, end + length - 1)
    if not twice:
        return Runs(roll, low[start], start, end - start, content, none.view(U64))
    # an anchor that stands twice in one run: then the run itself may repeat a window
    edge = np.full(width - 1, ~U64(0), U64)
    peak = ~sliding_min(np.concatenate([edge, ~low, edge]), width)
    hit = np.flatnonzero(grams <= peak[: len(grams)])
    same = (grams[hit[1:]] == grams[hit[:-1]]) & (hit[1:] - hit[:-1] <= width)
    return Runs(roll, low[start], start, end - start, content, grams[hit[1:][same]])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether the sorted table has it, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


Entries = dict[str, np.ndarray]


def _sorted(columns: Entries) -> Entries:
    key = columns["key"].view(U64)
    _, at = np.unique(key, return_index=True)
    return {"key": key[at]} | {k: v[at] for k, v in columns.items() if k != "key"}


class Lookup:
    """Entries by key for a function over batches of documents, which have columns _id and _text."""

    def __init__(self, table: DataFrame, name: str, limit: int | None = None):
        self.table = staged(table, name)
        self.rows = self.table.count()
        self.columns = self.table.columns
        self.small = self.rows <= (BROADCAST_BYTES // (8 * len(self.columns)) if limit is None else limit)
        self._sent = None

    def run(self, docs: DataFrame, fn: Callable[[pa.RecordBatch, Entries], Iterator[pa.RecordBatch]], keys: Callable[[pa.RecordBatch, Entries, int], tuple[np.ndarray, np.ndarray]], schema: str, before: Sequence[Lookup] = ()) -> DataFrame:
        """fn over every batch of docs, with the entries that its documents need (or more).

        keys(batch, entries, step) yields (row, key) of what each document looks up; it is only called when the table is
        too large to broadcast. Then the steps look into ``before`` and last into this table, each with the entries
        that the step before it found, so that only keys which can matter are ever joined."""
        if self.small:
            if self._sent is None:
                got = self.table.toArrow()
                self._sent = docs.sparkSession.sparkContext.broadcast(_sorted({c: got.column(c).to_numpy() for c in self.columns}))
            sent = self._sent

            def near(batches):
                for b in batches:
                    yield from fn(b, sent.value)

            return docs.mapInArrow(near, schema)

        docs = docs.withColumn("_hash", F.xxhash64("_text"))
        joined, found, needs = docs, [], None

        def entries(b: pa.RecordBatch, names: list[str]) -> Entries:
            if not names:
                return {"key": np.zeros(0, U64)}
            return _sorted({c: b.column(f"_k_{c}").flatten().to_numpy(zero_copy_only=False) for c in names})

        for step, look in enumerate((*before, self)):

            def wanted(batches, step=step, names=tuple(found)):
                for b in batches:
                    row, key = keys(b, entries(b, names), step)
                    pairs = np.unique(np.stack([row, key.view(np.int64)], 1), axis=0)
                    at = pa.array(pairs[:, 0])
                    yield pa.RecordBatch.from_arrays([b.column("_id").take(at), b.column("_hash").take(at), pa.array(pairs[:, 1])], names=["_id", "_hash", "key"])

            need = staged(joined.mapInArrow(wanted, "_id long, _hash long, key long").distinct(), "needs")
            needs = need if needs is None else needs.union(need)
            found = look.columns
            lists = needs.join(look.table, "key").groupBy("_id", "_hash").agg(*(F.collect_list(c).alias(f"_k_{c}") for c in found))
            lists = lists.withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"})
            joined = docs.join(lists, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left").drop("_id2", "_hash2")

        def far(batches):
            for b in batches:
                yield from fn(b, entries(b, found))

        return joined.mapInArrow(far, schema)


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns used, under names that no extra column can clash with."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
