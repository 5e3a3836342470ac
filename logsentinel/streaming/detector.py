"""Keyed state of the detectors on a stream.

Predicates are columns, computed before the shuffle; a state is one rule's and one key's. Thresholds and distinct counts keep
their window as a list and fire once a key for the life of the query; patterns, sudo commands and streaks look at one
micro-batch, as a poll of the batch engine would. Rows of a batch are taken in the total order of events; an older row in a
later batch joins the windows as they then stand (no watermark). Windows change row by row, so a batch takes time in
proportion to its rows and those of the windows it touches. (Timers on the clock would drop windows of silent keys, but with
them a query runs a batch at every trigger, so that it is never seen to have processed all there is.)
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import excerpt
from ..operators import detectors as d
from ..rules import ConfigError, RuleConfig
from ..schema import EVIDENCE, order_of

KINDS, THRESHOLDS = dict(d.KINDS), dict(d.THRESHOLDS)
_HIT = "struct<us:bigint,source_rank:int,file_ord:int,line_no:bigint,file:string,excerpt:string>"
OUT = f"rule_ord int, ip string, hits array<{_HIT}>, names array<string>, wait double"


#: For types of one's own: what an event counts as under a rule.
MARKS: dict[str, Callable[[RuleConfig], tuple[Column, Column, Column]]] = {}


def follows(kind: str, state: str, mark: Callable[[RuleConfig], tuple[Column, Column, Column]], threshold: int = 5) -> None:
    """Register how a rule type of one's own runs on a stream: its state (count, distinct, success, streak or all) and its
    mark, (counts, succeeds, value) of an event. What describes its findings is registered with ``detectors.describes``."""
    KINDS[kind], MARKS[kind], THRESHOLDS[kind] = state, mark, threshold


def mark(rule: RuleConfig) -> tuple[Column, Column, Column]:
    """(counts, succeeds, value) of an event under a rule."""
    if rule.type in d.KINDS:
        return d.mark(rule)
    if rule.type not in MARKS:
        raise ConfigError(f"rule {rule.id!r}: type {rule.type!r} has no form on a stream")
    counts, succeeds, value = MARKS[rule.type](rule)
    source = F.lit(True) if rule.source is None else F.col("source") == rule.source
    return counts & source, succeeds & source & ~counts, value


def marked(events: DataFrame, rules: list[tuple[int, RuleConfig]]) -> DataFrame:
    """One row for each event and key with the rules it matters to; events that matter to none are dropped."""
    e = events.withColumn("_o", order_of()).withColumn("_excerpt", excerpt(F.col("raw"), F.col("message")))
    notes = []
    for i, r in rules:
        counts, succeeds, value = mark(r)
        key = value if r.type in d.BY_USER else F.col("ip")
        notes.append(F.when((counts | succeeds) & key.isNotNull(), F.struct(F.lit(i).alias("rule"), counts.alias("counts"), value.alias("value"), key.alias("key"))))
    noted = e.withColumn("_note", F.explode(F.filter(F.array(*notes), lambda x: x.isNotNull())))
    return noted.select(F.col("_note.key").alias("key"), F.col("_note.rule").alias("rule"), F.col("_note.counts").alias("counts"), F.col("_note.value").alias("value"), "_o.*", "file", F.col("_excerpt").alias("excerpt"))


#: What a row of a window holds.
ROW = "us long, source_rank int, file_ord int, line_no long, file string, excerpt string, value string"
_HIT_NAMES = ("us", "source_rank", "file_ord", "line_no", "file", "excerpt")


class TrailingWindow:
    """Rows in the order in which they came, those of a time on gone by a heap, different values by a count."""

    def __init__(self, rows: Iterator[tuple] = ()):
        self.rows: dict[int, tuple] = {}
        self.heap: list[tuple[int, int]] = []
        self.values: Counter[str] = Counter()
        self.came = 0
        for r in rows:
            self.add(tuple(r))

    def add(self, row: tuple) -> None:
        self.rows[self.came] = row
        heapq.heappush(self.heap, (row[0], self.came))
        self.came += 1
        if row[-1]:
            self.values[row[-1]] += 1

    def drop_before(self, us: int) -> None:
        while self.heap and self.heap[0][0] < us:
            value = self.rows.pop(heapq.heappop(self.heap)[1])[-1]
            if value:
                self.values[value] -= 1
                if not self.values[value]:
                    del self.values[value]


def fires_of(rows: Iterator[tuple], rule: RuleConfig, window: TrailingWindow | None) -> tuple[list[tuple], bool]:
    """rows: (row, counts) in order. What one rule reports of one key, as (hits, names, wait), and whether its window is done."""
    kind, span, p = KINDS[rule.type], rule.window_seconds * 1_000_000, rule.params
    threshold = p.get("threshold", THRESHOLDS.get(rule.type, 5))
    if kind == "all":
        hits = [row for row, _ in rows]
        return [(hits, [], None)] if hits else [], False
    out, streak = [], []
    for row, counts in rows:
        if kind == "streak":
            streak.append(row)
            if not counts:
                wait = (row[0] - streak[-2][0]) / 1e6 if len(streak) > 1 else -1
                if len(streak) > max(1, p.get("min_failures", 3)) and 0 <= wait <= p.get("max_gap_seconds", 30):
                    out.append((streak, [], wait))
                streak = []
            continue
        window.drop_before(row[0] - span)
        if counts:
            window.add(row)
        enough = len(window.values if kind == "distinct" else window.rows) >= threshold
        if enough and (kind != "success" or not counts):
            return [([*window.rows.values(), *(() if counts else (row,))], sorted(window.values), None)], True
    return out, False


class Detector(StatefulProcessor):
    """State of a (rule, key): the rows of its window, and whether it has fired."""

    def __init__(self, rules: dict[int, RuleConfig]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", ROW)
        self.fired = handle.getValueState("fired", "fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        i, name = int(key[0]), key[1]
        rule = self.rules[i]
        keeps = KINDS[rule.type] not in ("all", "streak")
        if keeps and self.fired.exists():
            return
        batch = pd.concat(list(rows)).sort_values(["us", "source_rank", "file_ord", "line_no"], kind="stable")
        come = (((int(r.us), int(r.source_rank), int(r.file_ord), int(r.line_no), r.file, r.excerpt, r.value or None), bool(r.counts)) for r in batch.itertuples(index=False))
        window = TrailingWindow(self.window.get()) if keeps and self.window.exists() else TrailingWindow()
        before = window.came
        out, done = fires_of(come, rule, window)
        if keeps:
            self._keep(window, before, done)
        if out:
            user = rule.type == "sudo-sensitive-command"
            shown = rule.type == "ssh-invalid-user-enum"
            yield pd.DataFrame([(i, None if user else name, [dict(zip(_HIT_NAMES, h, strict=False)) for h in hits], [name] if user else names if shown else [""] * len(names), wait) for hits, names, wait in out], columns=["rule_ord", "ip", "hits", "names", "wait"])

    def _keep(self, window: TrailingWindow, before: int, done: bool) -> None:
        if done:
            self.fired.update((True,))
            self.window.clear()
        elif len(window.rows) == window.came:  # none left the window: the new ones follow those kept
            new = [r for k, r in window.rows.items() if k >= before]
            if new:
                self.window.appendList(new)
        elif window.rows:
            self.window.put(list(window.rows.values()))
        else:
            self.window.clear()

    def close(self) -> None:
        pass


#: What such state needs of the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fired(events: DataFrame, rules: list[tuple[int, RuleConfig]]) -> DataFrame:
    """Stream of OUT rows. The session must have PROVIDER set when the query starts."""
    return marked(events, rules).groupBy("rule", "key").transformWithStateInPandas(Detector(dict(rules)), OUT, "append", "none")


def as_findings(found: DataFrame, rules: list[tuple[int, RuleConfig]]) -> DataFrame:
    """A batch of OUT rows as findings, described as the batch detectors describe them."""
    place = F.element_at("hits", F.when(F.col("_kind") == "all", 1).otherwise(-1))
    parts = []
    for i, r in rules:
        mine = found.where(F.col("rule_ord") == i).withColumn("_kind", F.lit(KINDS[r.type]))
        moment = lambda x: F.timestamp_micros(x["us"])
        evidence = F.transform("hits", lambda x: F.struct(x["file"].alias("file"), x["line_no"].alias("line_no"), x["excerpt"].alias("excerpt")))
        mine = mine.withColumns({
            "emit": F.struct(*(place[c].alias(c) for c in ("us", "source_rank", "file_ord", "line_no"))), "first_seen": moment(F.element_at("hits", 1)), "last_seen": moment(F.element_at("hits", -1)),
            "count": F.size("hits").cast("long"), "evidence": evidence.cast(f"array<{EVIDENCE}>"), "correlated_rule_ids": F.array().cast("array<string>"), "_values": F.col("names"), "_wait": F.col("wait"), "_user": F.element_at("names", 1),
        })
        parts.append(d.finish(d.DESCRIBE[r.type](mine, r), r, i))
    return reduce(DataFrame.unionByName, parts)
