"""Redacted logs of the tool itself, and reading them back."""

from __future__ import annotations

import json
import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact_text

LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


class RedactionFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redact_text(record.getMessage()), ()
        return True


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = redact_text(self.formatException(record.exc_info))
        return json.dumps(out, ensure_ascii=False)


def configure_logging(folder: str, level: int = logging.INFO) -> None:
    """app.log and app.jsonl, 1 MB and three backups each; called again it replaces what it set up before."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    root = logging.getLogger("logsentinel")
    root.setLevel(level)
    for old in [h for h in root.handlers if isinstance(h, RotatingFileHandler)]:
        root.removeHandler(old)
        old.close()
    for name, form in (("app.log", logging.Formatter("%(asctime)s %(levelname)s %(message)s")), ("app.jsonl", JsonFormatter())):
        handler = RotatingFileHandler(Path(folder) / name, maxBytes=1_000_000, backupCount=3, encoding="utf-8")
        handler.setFormatter(form)
        handler.addFilter(RedactionFilter())
        root.addHandler(handler)


def read_tool_log(spark: SparkSession, path: str, level: str = "INFO", last: int = 500) -> DataFrame:
    """line: 'ts LEVEL message' of the last lines at or above the level, oldest first; bad JSON is skipped."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_i"))
    tail = raw.orderBy(F.desc("_i")).limit(last)  # each task keeps its last ones
    rec = tail.select("_i", F.from_json("value", "ts string, level string, message string").alias("r")).where("r.level IS NOT NULL")
    rank = F.coalesce(*(F.when(F.col("r.level") == k, v) for k, v in LEVELS.items()), F.lit(0))
    return rec.where(rank >= LEVELS[level.upper()]).orderBy("_i").select(F.concat_ws(" ", "r.ts", "r.level", "r.message").alias("line"))
