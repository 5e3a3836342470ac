"""Follow log files: tail, parse, detect with keyed state, correlate, report."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.correlate import correlate, new_correlations
from ..plans.analyze import empty_findings, split_rules
from ..rules import AppConfig
from ..schema import FINDING
from ..sources import parsers
from .detector import PROVIDER, as_findings, fired
from .tail_source import TailSource


class _Progress(StreamingQueryListener):
    """What each batch of a query has read, as it is reported, and the number of polls."""

    def __init__(self):
        self.query_id, self.polls, self.last = None, 0, -1
        self.counts: dict[int, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) == self.query_id:
            seen = p.observedMetrics.get("lines")
            if seen and (seen["events"] or seen["failures"]):
                self.counts[p.batchId] = (seen["events"], seen["failures"])
            self.polls, self.last = self.polls + 1, p.batchId

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.query_id:
            self.polls += 1

    def onQueryTerminated(self, event) -> None:
        pass


class WatchSession:
    """A streaming query over files. Offsets, detector state and reported findings live in the checkpoint folder, so a
    restarted session goes on where it stopped and reports nothing twice."""

    def __init__(self, spark: SparkSession, paths: list[str], config: AppConfig, checkpoint: str, fmt: str = "auto", interval: float = 0.5, reference: datetime | None = None, on_findings: Callable[[list[dict[str, Any]]], None] | None = None):
        self.spark, self.config, self.checkpoint, self.interval, self.on_findings = spark, config, checkpoint.rstrip("/"), interval, on_findings
        self.rules, self.joint, self.sources = split_rules(config)
        self._progress, self._written = _Progress(), set()
        self._reference = reference
        fmt = fmt if fmt.strip().lower() == "auto" else parsers.get_parser(fmt).name
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.dataSource.register(TailSource)
        self._lines = spark.readStream.format("logtail").option("paths", json.dumps([os.path.abspath(p) for p in paths])).option("format", fmt).load()
        self.query = None

    def _parsed(self) -> DataFrame:
        parts = [p.parse(self._lines.where(F.col("format") == p.name), self._reference) for p in parsers.PARSERS]
        return reduce(DataFrame.unionByName, parts)

    def start(self, available_now: bool = False) -> None:
        parsed = self._parsed().observe("lines", F.count(F.when(F.col("reason").isNull(), 1)).alias("events"), F.count("reason").alias("failures"))
        found = fired(parsers.events_and_failures(parsed)[0], self.rules)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{int(self.interval * 1000)} milliseconds"}
        self.spark.streams.addListener(self._progress)
        self.spark.conf.set(*PROVIDER)
        self.query = found.writeStream.outputMode("append").option("checkpointLocation", f"{self.checkpoint}/query").trigger(**trigger).foreachBatch(self._batch).start()
        self._progress.query_id = str(self.query.id)

    def _folders(self, name: str) -> list[int]:
        """Batches that have a folder of that name in the checkpoint."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")) if files.exists(path) else []

    def _drop(self, name: str, batch: int) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/{name}/batch={batch}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _correlated(self, new: DataFrame, batch_id: int) -> DataFrame:
        """new and its correlations with what the batch before left open: the findings within the longest correlation window of
        the latest one, and of correlations only which (ip, rules) they reported. A batch reads and writes these alone, so it
        takes as long after a thousand batches as after one; the folder before stays in case that this batch runs again."""
        before = [b for b in self._folders("open") if b < batch_id]
        past = self.spark.read.schema(FINDING).parquet(f"{self.checkpoint}/open/batch={before[-1]}") if before else empty_findings(self.spark)
        span = max(r.window_seconds for _, r in self.joint)
        seen = past.where(F.size("correlated_rule_ids") > 0)
        single = past.where(F.size("correlated_rule_ids") == 0).unionByName(new)
        latest = single.agg(F.max("last_seen").alias("_latest"))
        near = single.join(F.broadcast(latest), F.col("last_seen") >= F.col("_latest") - F.make_dt_interval(secs=F.lit(span))).drop("_latest")  # one row
        joint = [new_correlations(correlate(near, r, self.sources, i), seen.where(F.col("rule_id") == r.id)) for i, r in self.joint]
        joint = reduce(DataFrame.unionByName, joint).persist()
        kinds = {f.name: f.dataType for f in FINDING}
        slim = joint.select(*(F.col(c) if c in ("rule_id", "ip", "correlated_rule_ids") else F.lit(None).cast(kinds[c]).alias(c) for c in FINDING.names))
        near.unionByName(seen).unionByName(slim).coalesce(1).write.mode("overwrite").parquet(f"{self.checkpoint}/open/batch={batch_id}")
        for old in before[:-1]:
            self._drop("open", old)
        return joint.unionByName(new)

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        """Idempotent: a batch that is run again writes the same folders."""
        self._keep_counts()
        batch = batch.persist()  # the detectors' state advances once
        try:
            if batch.isEmpty():  # most polls find nothing, and leave no folder
                return
            new = as_findings(batch, self.rules).persist()
            shown = (self._correlated(new, batch_id) if self.joint else new).persist()
            rows = shown.orderBy(F.desc("severity_rank"), "rule_ord", "emit").collect()
            shown.coalesce(1).write.mode("overwrite").parquet(f"{self.checkpoint}/findings/batch={batch_id}")
            shown.unpersist()
            new.unpersist()
        finally:
            batch.unpersist()
        if rows and self.on_findings:
            self.on_findings([r.asDict(recursive=True) for r in rows])

    def process_available(self) -> None:
        """Wait until all that the files hold now is processed."""
        self.query.processAllAvailable()

    def _keep_counts(self) -> None:
        """Totals of the batches reported so far go to the checkpoint, one row a batch that read lines."""
        for batch in sorted(set(self._progress.counts) - self._written):
            events, failures = self._progress.counts[batch]
            self.spark.createDataFrame([(events, failures)], "events long, failures long").coalesce(1).write.mode("overwrite").parquet(f"{self.checkpoint}/totals/batch={batch}")
            self._written.add(batch)

    def counters(self) -> dict[str, int]:
        """Totals over the life of the checkpoint: whatever ran before, and however many batches."""
        end = time.monotonic() + 5
        while self.query and self.query.lastProgress and self._progress.last < self.query.lastProgress["batchId"] and time.monotonic() < end:
            time.sleep(0.05)  # a batch is reported a moment after it ends
        self._keep_counts()
        out = {"events": 0, "failures": 0, "findings": 0}
        for folder, names, sums in (("totals", ("events", "failures"), (F.sum("events"), F.sum("failures"))), ("findings", ("findings",), (F.count(F.lit(1)),))):
            try:
                got = self.spark.read.parquet(f"{self.checkpoint}/{folder}").agg(*sums).first()
            except AnalysisException:  # nothing is written yet
                continue
            out |= {k: v or 0 for k, v in zip(names, got, strict=True)}
        return out

    def run(self, stop: threading.Event | None = None, max_seconds: float | None = None, max_polls: int | None = None) -> None:
        """Until stopped, interrupted, out of time or after so many polls (of the files, with or without new lines)."""
        self.start()
        stop, end = stop or threading.Event(), time.monotonic() + (max_seconds if max_seconds is not None else float("inf"))
        try:
            while time.monotonic() < end and self.query.isActive and (max_polls is None or self._progress.polls < max_polls):
                if stop.wait(min(self.interval, max(0.0, end - time.monotonic()), 1.0)):
                    break
        except KeyboardInterrupt:
            pass
        finally:
            self.stop()

    def stop(self) -> None:
        if self.query:
            self.query.stop()
            self.counters()
            self.spark.streams.removeListener(self._progress)
