"""Analysis jobs on one Spark session: a bounded queue, worker threads in a FAIR pool, cancellation by tag."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from enum import StrEnum
from typing import Any, Protocol

from pyspark.sql import SparkSession

from ..functions.text import redact_text
from ..plans.analyze import analyze
from ..rules import AppConfig
from ..sinks.export import to_dicts
from .users import Permission, User, require_own_or


class JobStatus(StrEnum):
    QUEUED = "queued"
    RUNNING = "running"
    DONE = "done"
    FAILED = "failed"
    CANCELLED = "cancelled"


class QueueFull(Exception):
    """The queue holds as many jobs as it may."""


@dataclass(frozen=True)
class Job:
    job_id: str
    files: tuple[str, ...]
    submitted_by: str = ""
    status: JobStatus = JobStatus.QUEUED
    submitted_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    started_at: datetime | None = None
    finished_at: datetime | None = None
    findings: tuple[dict[str, Any], ...] = ()
    error: str | None = None
    stats: dict[str, float] = field(default_factory=dict)


class CancelToken(threading.Event):
    """Set when the job is to stop."""

    cancel = threading.Event.set
    cancelled = property(threading.Event.is_set)


class JobWorker(Protocol):
    def run(self, job: Job, cancel: CancelToken) -> dict[str, Any]:
        """events, failures (counts) and findings (dicts)."""


class SparkWorker:
    def __init__(self, spark: SparkSession, config: AppConfig, fmt: str = "auto"):
        self.spark, self.config, self.fmt = spark, config, fmt

    def run(self, job: Job, cancel: CancelToken) -> dict[str, Any]:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.job_id)
        self.spark.addTag(job.job_id)
        try:
            result = analyze(self.spark, list(job.files), self.config, self.fmt)
            out = {"events": result.events.count(), "failures": result.failures.count(), "findings": to_dicts(result.findings)}
            result.unpersist()
            return out
        finally:
            self.spark.removeTag(job.job_id)

    def interrupt(self, job_id: str) -> None:
        self.spark.interruptTag(job_id)


class JobQueue:
    """Jobs go QUEUED, RUNNING, then DONE, FAILED or CANCELLED; each change is one step under one lock."""

    def __init__(self, worker: JobWorker, workers: int = 4, max_pending: int = 100, on_done: Callable[[Job], None] | None = None):
        self._worker, self._on_done = worker, on_done
        self._pending: queue.Queue[str] = queue.Queue(max_pending)
        self._jobs: dict[str, Job] = {}
        self._tokens: dict[str, CancelToken] = {}
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._threads = [threading.Thread(target=self._loop, daemon=True, name=f"job-{i}") for i in range(workers)]
        for t in self._threads:
            t.start()

    def submit(self, files: list[str], submitted_by: str = "") -> str:
        job = Job(uuid.uuid4().hex, tuple(files), submitted_by)
        with self._lock:
            if self._stop.is_set():
                raise RuntimeError("the queue is shut down")
            self._jobs[job.job_id], self._tokens[job.job_id] = job, CancelToken()
            try:
                self._pending.put_nowait(job.job_id)
            except queue.Full:
                del self._jobs[job.job_id], self._tokens[job.job_id]
                raise QueueFull(f"{self._pending.maxsize} jobs are waiting") from None
        return job.job_id

    def get(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def list_jobs(self) -> list[Job]:
        """Latest first."""
        with self._lock:
            return sorted(self._jobs.values(), key=lambda j: j.submitted_at, reverse=True)

    def findings(self) -> list[dict[str, Any]]:
        """Of all jobs done, loudest first."""
        rank = {"LOW": 10, "MEDIUM": 20, "HIGH": 30, "CRITICAL": 40}
        return sorted((f for j in self.list_jobs() if j.status == JobStatus.DONE for f in j.findings), key=lambda f: -rank[f["severity"]])

    def cancel(self, job_id: str) -> bool:
        """A queued job at once; a running one by interrupting its Spark jobs."""
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job.status not in (JobStatus.QUEUED, JobStatus.RUNNING):
                return False
            self._tokens[job_id].cancel()
            if job.status == JobStatus.QUEUED:
                self._jobs[job_id] = replace(job, status=JobStatus.CANCELLED, finished_at=datetime.now(UTC))
                return True
        if hasattr(self._worker, "interrupt"):
            self._worker.interrupt(job_id)
        return True

    def cancel_as(self, user: User, job_id: str) -> bool:
        """A user's own jobs; those of others only with the permission for any."""
        job = self.get(job_id)
        require_own_or(user, job.submitted_by if job else user.username, Permission.STOP_OWN_JOB, Permission.STOP_ANY_JOB)
        return self.cancel(job_id)

    def wait(self, job_id: str, timeout: float = 60) -> Job | None:
        end = time.monotonic() + timeout
        while time.monotonic() < end:
            job = self.get(job_id)
            if job is None or job.status not in (JobStatus.QUEUED, JobStatus.RUNNING):
                return job
            time.sleep(0.02)
        return self.get(job_id)

    def shutdown(self, timeout: float = 10) -> bool:
        """No new jobs; waits for those that run. True if all workers ended."""
        self._stop.set()
        end = time.monotonic() + timeout
        for t in self._threads:
            t.join(max(0, end - time.monotonic()))
        return not any(t.is_alive() for t in self._threads)

    def _change(self, job_id: str, expect: JobStatus, **new: Any) -> Job | None:
        with self._lock:
            if self._jobs[job_id].status != expect:
                return None
            self._jobs[job_id] = job = replace(self._jobs[job_id], **new)
            return job

    def _loop(self) -> None:
        while not self._stop.is_set():
            try:
                job_id = self._pending.get(timeout=0.1)
            except queue.Empty:
                continue
            job = self._change(job_id, JobStatus.QUEUED, status=JobStatus.RUNNING, started_at=datetime.now(UTC))
            if job is not None:
                self._run(job)

    def _run(self, job: Job) -> None:
        token, began = self._tokens[job.job_id], time.monotonic()
        try:
            got = self._worker.run(job, token)
            stats = {"events": got["events"], "failures": got["failures"], "findings": len(got["findings"]), "duration_seconds": time.monotonic() - began}
            done = replace(job, status=JobStatus.DONE, findings=tuple(got["findings"]), stats=stats, finished_at=datetime.now(UTC))
            if token.cancelled:
                done = replace(done, status=JobStatus.CANCELLED, findings=())
            elif self._on_done:  # before DONE is published
                self._on_done(done)
        except Exception as e:
            status = JobStatus.CANCELLED if token.cancelled else JobStatus.FAILED
            done = replace(job, status=status, error=redact_text(e), finished_at=datetime.now(UTC))
        with self._lock:
            self._jobs[job.job_id] = done
