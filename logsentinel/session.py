"""The Spark session of the command line, and folders that all of its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .rules import ConfigError


def session(name: str = "logsentinel") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset, but only with a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ConfigError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
    return tempfile.mkdtemp(prefix=f"logsentinel-{name}-")
