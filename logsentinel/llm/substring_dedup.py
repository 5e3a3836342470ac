"""Substring deduplication: suffix automata of reference shards, streamed for matching statistics.

Every word covered by a window of ``window`` words that also starts earlier in the corpus is removed.

* Reference shards. The windows are cut into runs by anchor (see ``repeats``). The distinct runs of one anchor
  are a shard: all texts in which a window of that anchor can recur. Its size is bounded by ``hot_anchor`` runs
  of at most a few dozen words; windows of more frequent anchors are shards by themselves.
* Automata. In the order of (document, position), each run of a shard is streamed through the automaton of the
  earlier ones. Where its matching statistic reaches the window length, the state's first end tells the earliest
  start of that very word sequence. The run is then added.
* Documents. The earliest starts found (the verdicts) are broadcast when their counted number is small enough,
  else joined to the documents that need them; one pass over the documents removes the spans.

A broadcast of the automata themselves would grow with the corpus; shards are therefore routed by anchor and only
bounded tables are broadcast. Defined cases: null text is empty; texts under ``window`` words lose nothing;
rows that repeat a doc_id are one document's starts (no start precedes its equal); a null doc_id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .repeats import Lookup, Runs, counted, find, prepared, runs_of
from .storage import staged
from .tokens import IS_SPACE, U64, signed, slices, word_bounds, word_hashes

GRAM = 8
NULL_ID = -(1 << 63)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_id").fill_null(NULL_ID).to_numpy()


def _parts(batch: pa.RecordBatch, window: int, twice: bool = False):
    """(rows from, to, bytes, offsets, word starts, ends, first words, word hashes, runs, row of each run)."""
    for lo, hi, data, off in slices(batch.column("_text")):
        start, end, first = word_bounds(data, off)
        words = word_hashes(data, start, end)
        runs = runs_of(words, first, window, GRAM, twice=twice)
        row = np.searchsorted(first, runs.start, side="right") - 1
        yield lo, hi, data, off, start, end, first, words, runs, row


def _spread(runs: Runs, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the picked runs: its run, its start."""
    n = runs.windows[pick]
    run = np.repeat(np.flatnonzero(pick), n)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return run, runs.start[run] + inner


def _shard_verdicts(rows, window: int):
    """rows: (anchor, words, doc, position) by anchor, doc, position. Yields (window hash, doc, position) of the
    earliest start of each window that a later run repeats."""
    from .tokens import Rolling

    key, auto, seen = None, None, set()
    for anchor, blob, doc, at in rows:
        if anchor != key:
            key, auto, seen = anchor, SuffixAutomaton(), set()
        words = np.frombuffer(blob, dtype=U64)
        tokens = words.tolist()
        roll = None
        # a run can also repeat itself: stream and extend word by word
        hits = [(i, e) for i, (m, e) in enumerate(auto.matches(tokens, window)) if m >= window]
        inner = len(tokens) > window and len({tuple(tokens[i : i + window]) for i in range(len(tokens) - window + 1)}) < len(tokens) - window + 1
        if hits or inner:
            roll = Rolling(words)
        found = [(i - window + 1, e) for i, e in hits]
        if inner:
            known: dict = {}
            done = {i for i, _ in found}
            for i in range(len(tokens) - window + 1):
                first = known.setdefault(tuple(tokens[i : i + window]), i)
                if first != i and i not in done:
                    found.append((i, (doc, at + first + window - 1)))
        if found:
            pos = np.array([i for i, _ in found])
            for h, (_, (d, e)) in zip(roll.ranges(pos, pos + window).view(np.int64).tolist(), found, strict=True):
                if h not in seen:
                    seen.add(h)
                    yield h, d, e - window + 1
        auto.start_text()
        for i, t in enumerate(tokens):
            auto.extend(t, (doc, at + i))


def dedup(docs: DataFrame, window: int = 20, hot_anchor: int = 1000, broadcast_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed, end exclusive), kept_text for every row of docs."""
    src = prepared(docs, id_col, text_col)

    def count_anchors(batches):
        for b in batches:
            got = [(runs.anchor, runs.content, runs.twice) for *_, runs, _ in _parts(b, window, twice=True) if len(runs.anchor)]
            if not got:  # no text has a window
                continue
            anchor, content, twice = (np.concatenate(x) for x in zip(*got, strict=True))
            content = content.view(np.int64)
            order = np.lexsort((content, anchor))
            a, c = anchor[order], content[order]
            head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            tail = np.append(head[1:], len(a)) - 1
            yield pa.RecordBatch.from_arrays([signed(a[head]), pa.array(np.diff(np.append(head, len(a)))), pa.array(c[head]), pa.array(c[tail])], names=["key", "n", "lo", "hi"])
            t = np.unique(twice)  # counts as another run with other content
            yield pa.RecordBatch.from_arrays([signed(t), pa.array(np.ones(len(t), np.int64)), pa.array(np.full(len(t), np.iinfo(np.int64).min)), pa.array(np.full(len(t), np.iinfo(np.int64).max))], names=["key", "n", "lo", "hi"])

    anchors = src.mapInArrow(count_anchors, "key long, n long, lo long, hi long").groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1")
    anchors = anchors.select("key", F.when(F.col("lo") == F.col("hi"), 0).when(F.col("n") <= hot_anchor, 1).otherwise(2).cast("long").alias("kind"))
    repeated = Lookup(anchors, "anchors", broadcast_rows)

    def anchor_keys(b, _entries, _step):
        got = [(lo + row, runs.anchor) for lo, *_, runs, row in _parts(b, window)]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, U64))

    def emit(b, table):
        """kind 0: the earliest start of a run's content in this batch; kind 1: also its words; kind 2: every window."""
        ids = _ids(b)
        out = {k: [] for k in ("key", "anchor", "doc", "at", "words")}
        for lo, _, _, _, _, _, first, words, runs, row in _parts(b, window):
            has, where = find(table["key"], runs.anchor)
            kind = np.where(has, table["kind"][where] if len(table["key"]) else 0, -1)
            plain = has
            doc, at = ids[lo + row], runs.start - first[row]
            out["key"].append(runs.content[plain])
            out["anchor"].append(np.zeros(plain.sum(), np.int64))
            out["doc"].append(doc[plain])
            out["at"].append(at[plain])
            out["words"] += [None] * int(plain.sum())
            some = np.flatnonzero(kind == 1)
            out["key"].append(runs.content[some])
            out["anchor"].append(runs.anchor[some].view(np.int64))
            out["doc"].append(doc[some])
            out["at"].append(at[some])
            out["words"] += [words[s : s + n + window - 1].tobytes() for s, n in zip(runs.start[some], runs.windows[some], strict=True)]
            run, pos = _spread(runs, kind == 2)
            out["key"].append(runs.roll.ranges(pos, pos + window))
            out["anchor"].append(np.zeros(len(pos), np.int64))
            out["doc"].append(doc[run])
            out["at"].append(pos - first[row[run]])
            out["words"] += [None] * len(pos)
        if not out["key"]:
            return
        key, anchor, doc, at = (np.concatenate(out[k]) for k in ("key", "anchor", "doc", "at"))
        order = np.lexsort((at, doc, anchor, key))
        k, a = key[order], anchor[order]
        head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])]) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(k)))
        top = order[head]
        yield pa.RecordBatch.from_arrays([signed(key[top]), pa.array(anchor[top]), pa.array(n), pa.array(doc[top]), pa.array(at[top]), pa.array([out["words"][i] for i in top], pa.binary())], names=["key", "anchor", "n", "doc", "at", "words"])

    found = repeated.run(src, emit, anchor_keys, "key long, anchor long, n long, doc long, at long, words binary")
    firsts = staged(found.groupBy("key", "anchor").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "at", "words")).alias("first")).select("key", "anchor", "n", "first.*"), "firsts")
    width = max(1, docs.sparkSession.sparkContext.defaultParallelism * 4)
    shards = firsts.where("words is not null").select("anchor", "words", "doc", "at").repartition(width, "anchor").sortWithinPartitions("anchor", "doc", "at")

    def verdicts(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("anchor", "words", "doc", "at")), strict=True)

        block = []
        for x in _shard_verdicts(rows(), window):
            block.append(x)
            if len(block) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)], names=["key", "doc", "at"])
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)], names=["key", "doc", "at"])

    earliest = firsts.where("words is null and n > 1").select("key", "doc", "at").union(shards.mapInArrow(verdicts, "key long, doc long, at long"))
    earliest = Lookup(earliest.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("first")).select("key", "first.*"), "earliest", broadcast_rows)

    def content_keys(b, entries, step):
        """First the anchors; then, of runs whose anchor is repeated, the contents and windows."""
        if step == 0:
            return anchor_keys(b, entries, step)
        got = []
        for lo, *_, runs, row in _parts(b, window):
            has, at = find(entries["key"], runs.anchor)
            run, pos = _spread(runs, has & (entries["kind"][at] > 0) if len(entries["key"]) else has)
            got += [(lo + row[has], runs.content[has]), (lo + row[run], runs.roll.ranges(pos, pos + window))]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, U64))

    def remove(b, table):
        ids, id_col_ = _ids(b), b.column("_id")
        for lo, hi, data, off, start, end, first, words, runs, row in _parts(b, window):
            gone = np.zeros(len(words) + 1, np.int64)
            doc = ids[lo + row]

            def mark(pos, doc, at, key, gone=gone):
                has, where = find(table["key"], key)
                if has.any():
                    d, a = table["doc"][where], table["at"][where]
                    hit = has & ((d < doc) | ((d == doc) & (a < at)))
                    np.add.at(gone, pos[hit], 1)
                    return hit
                return has

            whole = mark(runs.start, doc, runs.start - first[row], runs.content)
            np.add.at(gone, runs.start[whole] + runs.windows[whole] - 1 + window, -1)
            run, pos = _spread(runs, ~whole)
            one = mark(pos, doc[run], pos - first[row[run]], runs.roll.ranges(pos, pos + window))
            np.add.at(gone, pos[one] + window, -1)
            cut = np.cumsum(gone)[:-1] > 0
            yield _result(id_col_.slice(lo, hi - lo), data, off, start, end, first, cut)

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    return earliest.run(src, remove, content_keys, schema, [repeated])


def _result(ids, data, off, start, end, first, cut) -> pa.RecordBatch:
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(cut)])
    edge = np.zeros(len(cut) + 1, bool)
    edge[1:-1] = cut[1:] != cut[:-1]
    edge[[0, -1]] = True
    edge[first] = True
    at = np.flatnonzero(edge)
    at = at[at < len(cut)]
    to = np.append(at[1:], len(cut))
    at, to = at[cut[at]] if len(cut) else at, to[cut[at]] if len(cut) else to
    row = np.searchsorted(first, at, side="right") - 1
    pairs = pa.StructArray.from_arrays([pa.array(at - first[row]), pa.array(to - first[row])], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)), pairs)
    keep = np.flatnonzero(~cut)
    owner = np.searchsorted(first, keep, side="right") - 1
    more = np.r_[owner[1:] == owner[:-1], False] if len(keep) else np.zeros(0, bool)
    step = np.zeros(len(data) + 2, np.int8)
    step[start[keep]] += 1
    np.add.at(step, end[keep] + more, -1)
    mask = np.cumsum(step)[: len(data)] > 0
    text = np.where(IS_SPACE[data], np.uint8(0x20), data)[mask]
    offsets = np.concatenate([[0], np.cumsum(mask)])[off]
    kept = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text.tobytes())).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(total[first[1:]] - total[first[:-1]]), spans, kept], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
