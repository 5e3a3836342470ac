"""Deduplication of repeated strings by distributed prefix doubling over content-defined positions.

Every byte covered by a ``length``-byte string that also starts anywhere else in the corpus is removed.

* Positions. A suffix array of every byte would sort the corpus at each offset. Here the positions are the bytes at which
  a ``gram``-byte hash is 0 mod ``step``: one in ``step`` bytes, and equal strings have them at equal places. Rows with a
  text that other rows have too are whole repeats; one of them stands for the text.
* Doubling. The string at a position reaches to the next one; its rank is the smallest position with that string. Then Spark
  sorts the pairs (rank at a position, rank at the position 1, 2, ... further on) and ranks each group of equal pairs anew by its
  smallest position, so ranks are of strings of 1, 2, 4, ... steps. A position whose pair is unique leaves, as all longer
  strings there are unique too; the rounds end past the threshold.
* Windows of ``length`` bytes. Those between the same first and last positions are a run. A run takes part only if the steps
  between them are ranked as repeats. Runs with equal strings between their positions are compared: all alike, they repeat
  as a whole; else, and where a window holds no position, each window is named by itself and counted.

Ranks and runs reach the next pass over the texts as a ``Lookup``: broadcast when counted small, joined otherwise.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows that repeat a text, whatever
their ids, all lose it (each starts elsewhere); a string may be cut inside a character, so the kept bytes are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import Entries, Lookup, find, prepared
from .storage import staged
from .tokens import U64, RollingBytes, mix, signed, slices

GRAM, STEP = 16, 64
#: Kinds of entries in the lookup table; below 100 the kind is the number of steps that repeat at a position.
COPIED, STANDS, SETTLED, AMBIGUOUS, WINDOW = 100, 101, 102, 103, 104
_RUN, _WINDOW = U64(0x52554E), U64(0x57494E)

#: Constants of the 64-bit xxHash (fixed values).
_P1, _P2, _P3, _P4, _P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def sizes(length: int, step: int) -> list[int]:
    """The numbers of steps that are ranked: doubled while strings of so many, on average, are not past the threshold."""
    out = [1]
    while 2 * out[-1] * step <= length:
        out.append(2 * out[-1])
    return out


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def _hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + _P5 + U64(8)) ^ (_turned(x * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def position_names(key: np.ndarray, i: np.ndarray) -> np.ndarray:
    """What F.xxhash64(key, i) gives for longs."""
    return _hashed(i.astype(np.int64).view(U64), _hashed(key.view(U64), np.full(len(key), 42, U64)))


class Slice:
    """Positions and runs of the texts of one slice."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int, step: int):
        self.off, self.length, self.gram, self.sizes = off, length, gram, sizes(length, step)
        self.roll = RollingBytes(data)
        hit = np.flatnonzero(self.roll.grams(gram) % U64(step) == 0)
        doc = np.searchsorted(off, hit, side="right") - 1
        inside = hit + gram <= off[doc + 1]
        self.at, self.doc = hit[inside], doc[inside]
        self.index = np.arange(len(self.at)) - np.searchsorted(self.doc, self.doc)  # within its document

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have a next one in their document; hash of the string up to it."""
        some = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        return some, self.roll.ranges(self.at[some], self.at[some + 1] + self.gram)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and end window of each run; first and last position (an index of ``at``; last < first if there is none)."""
        begin, end = self.off[:-1], self.off[1:] - self.length + 1
        some = end > begin
        begin, end = begin[some], end[some]
        if not len(begin):
            return (np.zeros(0, np.int64),) * 4
        cuts = [begin, self.at + 1, self.at - (self.length - self.gram)]
        start, stop, first, last = self._cut(begin, end, cuts)
        lone = np.flatnonzero(first == last)  # one position: the longer side of it names the run, so it must not change
        side = self.at[first[lone]] - self.half
        start, stop, first, last = self._cut(begin, end, [start, side[(side > start[lone]) & (side < stop[lone])]])
        return start, stop, first, last

    @property
    def half(self) -> int:
        return (self.length - self.gram) // 2

    def _cut(self, begin, end, cuts):
        start = np.unique(np.concatenate(cuts))
        owner = np.searchsorted(begin, start, side="right") - 1
        ok = (owner >= 0) & (start < end[np.maximum(owner, 0)])
        start, owner = start[ok], owner[ok]
        stop = np.minimum(np.append(start[1:], np.iinfo(np.int64).max), end[owner])
        return start, stop, np.searchsorted(self.at, start), np.searchsorted(self.at, start + self.length - self.gram, side="right") - 1

    def named_runs(self, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and name of the runs; and a mask of those without a position, which have no name. level: steps that
        repeat at each position; then only of the runs that may repeat."""
        start, stop, first, last = self.runs()
        n = last - first
        maybe = np.ones(len(n), bool)
        for size in self.sizes if level is not None else ():
            at = np.flatnonzero((n >= size) & ((n < 2 * size) | (size == self.sizes[-1])))
            a, b = first[at], last[at] - size
            mid = np.minimum(a + size, b)
            maybe[at] = (level[a] >= size) & (level[b] >= size) & (level[mid] >= size)
        start, stop, first, last, n = (x[maybe] for x in (start, stop, first, last, n))
        name = np.zeros(len(n), U64)
        many = np.flatnonzero(n >= 1)
        name[many] = self.roll.ranges(self.at[first[many]], self.at[last[many]] + self.gram)
        lone = np.flatnonzero(n == 0)
        p = self.at[first[lone]]
        right = p - start[lone] <= self.half
        name[lone] = self.roll.ranges(np.where(right, p, p - self.half), np.where(right, p + self.length - self.half, p + self.gram))
        return start, stop, mix(name ^ _RUN), n < 0

    def windows(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every window of the runs, and its name."""
        n = stop - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, mix(self.roll.ranges(at, at + self.length) ^ _WINDOW)


def _kinds(table: Entries, names: np.ndarray) -> np.ndarray:
    """The kind of each name in the table; 0 if it has none."""
    has, at = find(table["key"], names)
    return np.where(has, table["kind"][at], 0) if len(table["key"]) else np.zeros(len(names), np.int64)


def _counted(names: np.ndarray, content: np.ndarray):
    """For each name: how often it stands, least and greatest content."""
    content = content.view(np.int64)
    order = np.lexsort((content, names))
    a, c = names[order], content[order]
    head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(a)))
    return pa.RecordBatch.from_arrays([signed(a[head]), pa.array(n), pa.array(c[head]), pa.array(c[head + n - 1])], names=["key", "n", "lo", "hi"])


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rows: key, i and what to rank by. The rows whose group has others, ranked by the smallest position of the group."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("key", "i")).alias("rank")).where("n > 1").drop("n")
    return staged(rows.join(groups.hint("merge"), list(by)).select("key", "i", "rank"), "ranks")


def doubled(steps: DataFrame, length: int, step: int) -> DataFrame:
    """steps: key (document), h (array: hash of the string from each position to the next). key (name of a position), kind
    (1, 2, 4, ...: how many steps from there repeat, up to the last round)."""
    held = _ranked(steps.select("key", F.posexplode("h").alias("i", "h")).withColumn("i", F.col("i").cast("long")), "h")
    found = held.select("key", "i", F.lit(1).alias("kind"))
    for size in sizes(length, step)[1:]:
        ahead = F.max("rank1").over(Window.partitionBy("key").orderBy("i").rangeBetween(size // 2, size // 2))
        held = _ranked(held.withColumnRenamed("rank", "rank1").withColumn("rank2", ahead).where("rank2 is not null"), "rank1", "rank2")
        found = found.union(held.select("key", "i", F.lit(size).alias("kind")))
    return found.groupBy(F.xxhash64("key", "i").alias("key")).agg(F.max("kind").cast("tinyint").alias("kind"))


def dedup(docs: DataFrame, length: int = 400, gram: int = GRAM, step: int = STEP, broadcast_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges removed, end exclusive), kept (binary) for every row of docs."""
    src = prepared(docs, id_col, text_col).withColumns({"_key": F.xxhash64(F.lit(1), "_id", "_text"), "_hash": F.xxhash64("_text")})
    texts = src.where(F.octet_length("_text") >= length).groupBy("_hash").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("least")).where("n > 1")
    texts = staged(texts, "copies")
    table = texts.select(F.col("_hash").alias("key"), F.lit(COPIED).cast("tinyint").alias("kind")).union(texts.select("least", F.lit(STANDS).cast("tinyint")))

    def own(b: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        """The rows that stand for their text."""
        copied = _kinds(entries, b.column("_hash").to_numpy().view(U64)) == COPIED
        return b.filter(pa.array(~copied | (_kinds(entries, b.column("_key").to_numpy().view(U64)) == STANDS)))

    def parts(b: pa.RecordBatch):
        for lo, hi, data, off in slices(b.column("_text")):
            yield lo, hi, data, Slice(data, off, length, gram, step), b.column("_key").slice(lo, hi - lo).to_numpy()

    def ranked_runs(s: Slice, key: np.ndarray, entries: Entries):
        return s.named_runs(_kinds(entries, position_names(key[s.doc], s.index)))

    def keys(b, entries, depth):
        """What each document looks up: 0 its text and positions, 1 the runs that these leave, 2 the windows of runs that
        those leave."""
        rows, names = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        if depth == 0:
            rows += [np.arange(b.num_rows)] * 2
            names += [b.column("_hash").to_numpy().view(U64), b.column("_key").to_numpy().view(U64)]
        for lo, _, _, s, key in parts(b):
            if depth == 0:
                rows.append(lo + s.doc)
                names.append(position_names(key[s.doc], s.index))
                continue
            if depth == 1:
                at, _, name, _ = ranked_runs(s, key, entries)
            else:
                start, stop, name, bare = s.named_runs()
                kind = _kinds(entries, name)
                pick = bare | (kind == AMBIGUOUS)
                at, name = s.windows(start[pick], stop[pick])
            rows.append(lo + np.searchsorted(s.off, at, side="right") - 1)
            names.append(name)
        return np.concatenate(rows), np.concatenate(names)

    def cut_up(b, entries):
        b = own(b, entries)
        for _, _, _, s, key in parts(b):
            some, h = s.steps()
            size = np.bincount(s.doc[some], minlength=len(key))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), signed(h))
            yield pa.RecordBatch.from_arrays([pa.array(key), lists], names=["key", "h"]).filter(pa.array(size > 0))

    steps = staged(Lookup(table, "copies", broadcast_rows).run(src, cut_up, lambda b, e, d: (np.arange(b.num_rows).repeat(2), np.stack([b.column("_hash").to_numpy(), b.column("_key").to_numpy()], 1).ravel().view(U64)), "key long, h array<long>"), "steps")
    positions = Lookup(table.union(doubled(steps, length, step)), "positions", broadcast_rows)

    def compare(b, entries):
        got = []
        for _, _, _, s, key in parts(own(b, entries)):
            start, stop, name, bare = ranked_runs(s, key, entries)
            start, stop, name = (x[~bare] for x in (start, stop, name))
            got.append((name, s.roll.ranges(start, stop - 1 + length)))
        if got:
            yield _counted(*(np.concatenate(x) for x in zip(*got, strict=True)))

    runs = positions.run(src, compare, keys, "key long, n long, lo long, hi long")
    runs = runs.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1")
    runs = runs.select("key", F.when(F.col("lo") == F.col("hi"), SETTLED).otherwise(AMBIGUOUS).cast("tinyint").alias("kind"))
    runs = Lookup(table.union(runs), "runs", broadcast_rows)  # positions have done their part: runs that don't repeat aren't in it

    def single(b, entries):
        got = []
        for _, _, _, s, key in parts(own(b, entries)):
            start, stop, name, bare = s.named_runs()
            pick = bare | (_kinds(entries, name) == AMBIGUOUS)
            got.append(s.windows(start[pick], stop[pick])[1])
        if got:
            names, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(names), pa.array(n)], names=["key", "n"])

    found = runs.run(src, single, keys, "key long, n long", [positions]).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    windows = Lookup(runs.table.union(found.select("key", F.lit(WINDOW).cast("tinyint").alias("kind"))), "windows", broadcast_rows)

    def remove(b, entries):
        copied = _kinds(entries, b.column("_hash").to_numpy().view(U64)) == COPIED
        for lo, hi, data, s, key in parts(b):
            cut = np.zeros(len(data) + 1, np.int32)
            start, stop, name, bare = s.named_runs()
            kind = _kinds(entries, name)
            whole = (kind == SETTLED) & ~bare
            np.add.at(cut, start[whole], 1)
            np.add.at(cut, stop[whole] - 1 + length, -1)
            pick = bare | (kind == AMBIGUOUS)
            at, name = s.windows(start[pick], stop[pick])
            at = at[_kinds(entries, name) == WINDOW]
            np.add.at(cut, at, 1)
            np.add.at(cut, at + length, -1)
            np.add.at(cut, s.off[:-1][copied[lo:hi]], 1)
            np.add.at(cut, s.off[1:][copied[lo:hi]], -1)
            yield _result(b.column("_id").slice(lo, hi - lo), data, s.off, np.cumsum(cut)[:-1] > 0)

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return windows.run(src, remove, keys, schema, [positions, runs])


def _result(ids, data, off, cut) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(cut)])
    first, last = cut.copy(), cut.copy()
    first[1:] &= ~cut[:-1]
    last[:-1] &= ~cut[1:]
    edge = off[(off > 0) & (off < len(cut))]
    first[edge], last[edge - 1] = cut[edge], cut[edge - 1]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, at, side="right") - 1
    pairs = pa.StructArray.from_arrays([pa.array(at - off[row]), pa.array(to - off[row])], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(off))).astype(np.int32)), pairs)
    removed = total[off[1:]] - total[off[:-1]]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((off - total[off]).astype(np.int64)), pa.py_buffer(data[~cut].tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(off)), pa.array(removed), spans, kept], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
