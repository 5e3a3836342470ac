"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []

#: Bytes of a batch of texts for a Python worker, where the session has Spark's default.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "4194304"


def bounded_batches(spark: SparkSession) -> None:
    """Long texts by the thousand would make batches too large for small executors; a setting of one's own stays."""
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and the master is local (tests), a temporary one of
    our own: on a cluster each executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="logsentinel-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def free_name(df: DataFrame, name: str) -> str:
    """name, or with as many marks before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_SCOPES: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """All tables staged within go at the end, but for those whose path is put into the list that it yields."""
    keep: list[str] = []
    _SCOPES.append([])
    try:
        yield keep
    finally:
        for path in _SCOPES.pop():
            if path not in keep:
                remove(spark, path)


#: Parquet's writer looks at the size of a page, or of a group of rows, only after 100 rows, and then again when it expects
#: it to be full, after 1000 at most; of rows of megabytes, or where small rows come before them, it would make groups of
#: hundreds of megabytes, which a reader holds as a whole. So it looks every few rows.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4", "parquet.block.size": str(8 << 20)}


def written(df: DataFrame, name: str, large_rows: bool = False) -> str:
    """Write df there; its path."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return path


def staged(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write df there and read it again: lineage ends at files that outlive any executor."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, large_rows))
