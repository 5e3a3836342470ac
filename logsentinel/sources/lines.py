"""Text files to numbered lines, and the first lines of each file without reading the rest."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..rules import ConfigError

#: Line boundaries that Spark's line reader doesn't know, and all of them.
MORE_BREAKS = "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BREAKS = f"\r\n|[\n\r]|{MORE_BREAKS}"
#: Files above this size are read in blocks; their lines are the same.
WHOLE_BYTES = 4 << 20
#: A read of the start of a file, the files read at once, and the bytes of a lookup table that may be broadcast.
HEAD_BYTES, READERS, BROADCAST_BYTES = 64 << 10, 32, 64 << 20


class LogFile(NamedTuple):
    name: str  # as it is reported
    path: str  # as it is read
    uri: str  # as Spark's file metadata has it
    size: int


def listed(spark: SparkSession, paths: list[str]) -> list[LogFile]:
    """The files of all paths in argument order, those of a folder or pattern by name (empty ones there are left out); a file
    given twice is there twice."""
    out = []
    for path in paths:
        try:
            found = spark.read.format("binaryFile").load(path).select("path", "length", F.col("_metadata.file_path").alias("uri")).orderBy("path").collect()
        except AnalysisException as e:
            raise ConfigError(f"log file not found: {path}") from e
        except Exception as e:
            raise ConfigError(f"cannot read {path}: {e}") from e
        if not found and _is_empty_file(spark, path):
            out.append(LogFile(path, path, path, 0))
            continue
        if not found:
            raise ConfigError(f"log file not found: {path} holds no files")
        plain = [r.path.removeprefix("file://").removeprefix("file:") for r in found]
        own = len(found) == 1 and plain[0].endswith("/" + path.rsplit("/", 1)[-1])
        out += [LogFile(path if own else name, r.path, r.uri, r.length) for r, name in zip(found, plain, strict=True)]
    if not out:
        raise ConfigError("no log files given")
    return out


def _is_empty_file(spark: SparkSession, path: str) -> bool:
    """Spark's listing leaves files without bytes out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isFile()


def _each_open(spark: SparkSession, files: list[LogFile], fn: Callable[[LogFile, Any], Any]) -> list:
    """fn of each file and its open stream, through the file system that Spark reads it from."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def one(file: LogFile):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.path)
        stream = path.getFileSystem(conf).open(path)
        try:
            return fn(file, stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(min(READERS, max(1, len(files)))) as pool:
        return list(pool.map(one, files))


def heads(spark: SparkSession, files: list[LogFile], lines: int, longest: int) -> list[list[str]]:
    """The first lines of each file, cut at so many characters. Of a file no more is read than HEAD_BYTES or what these lines
    take, and only one read is held."""

    def first(_: LogFile, stream) -> list[str]:
        out, rest, got = [], b"", b"-"
        while got and len(out) < lines:
            got = bytes(stream.readNBytes(HEAD_BYTES))
            data, at = rest + got, 0
            for m in _BYTE_BREAKS.finditer(data):
                if got and m.end() > len(data) - 2:
                    break  # it may go on in the next read
                out.append(data[at : m.start()])
                at = m.end()
            rest = data[at:]
            if len(rest) > 8 * longest:
                rest = rest[: 4 * longest] + rest[-2:]  # the line goes on, but no more of it counts
        if not got and rest:
            out.append(rest)
        return [x.decode("utf-8", "replace")[:longest] for x in out[:lines]]

    return _each_open(spark, files, first)


#: The same boundaries in UTF-8.
_BYTE_BREAKS = re.compile(b"\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")


def _named(spark: SparkSession, files: list[tuple[int, LogFile]], rows: DataFrame) -> DataFrame:
    """Adds file and file_ord by _uri; a file that is given twice has its rows twice."""
    names = spark.createDataFrame([(f.uri, f.name, i) for i, f in files], "_of string, file string, file_ord int")
    small = sum(len(f.uri) + len(f.name) + 32 for _, f in files) <= BROADCAST_BYTES
    return rows.join(F.broadcast(names) if small else names, F.col("_uri") == F.col("_of"))


def whole(spark: SparkSession, files: list[tuple[int, LogFile]]) -> DataFrame:
    """Files as (file, file_ord, line_no, value), in one scan; invalid UTF-8 becomes U+FFFD."""
    text = spark.read.text(sorted({f.path for _, f in files}), wholetext=True).select(F.split(F.make_valid_utf8("value"), BREAKS, -1).alias("v"), F.col("_metadata.file_path").alias("_uri"))
    n = F.size("v") - F.when(F.element_at("v", -1) == "", 1).otherwise(0)
    rows = _named(spark, files, text.select("_uri", F.posexplode(F.slice("v", F.lit(1), n)).alias("pos", "value")))
    return rows.select("file", "file_ord", (F.col("pos") + 1).cast("long").alias("line_no"), "value")


def blocks(spark: SparkSession, files: list[tuple[int, LogFile]], kept: list[DataFrame] | None = None) -> DataFrame:
    """Large files, split where Spark splits them, all in one scan: a line's number is its place in its block plus the lines
    of the blocks of its file before it, so no file passes through one task. A first scan counts the lines of each block;
    the counts, a row a block, are kept (put into ``kept``, to be released).

    Where other boundaries stand within Spark's lines these are cut there; in blocks that hold such, lines are counted in
    order. Two things of a file that Spark's lines don't show are read from its ends: a byte order mark, which is part of
    the first line, and whether the last line is ended."""
    facts = _each_open(spark, [f for _, f in files], _ends)
    odd = [(f.uri, mark, ended) for (_, f), (mark, ended) in zip(files, facts, strict=True) if mark or not ended]
    paths = sorted({f.path for _, f in files})
    pieces = F.split(F.make_valid_utf8("value"), MORE_BREAKS, -1)
    df = spark.read.text(paths).select(pieces.alias("v"), F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = df.groupBy("_uri", "_block").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.sum(F.size("v")).alias("_n"), F.max(F.size("v")).alias("_most")).persist()
    if kept is not None:
        kept.append(sizes)
    seen = sizes.agg(F.max("_most").alias("most"), F.coalesce(F.sum(F.octet_length("_uri") + 64), F.lit(0)).alias("bytes")).first()
    before = Window.partitionBy("_uri").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("_block") == F.max("_block").over(Window.partitionBy("_uri"))
    places = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_end": F.when(last, F.col("_last"))})
    places = places.select(F.col("_uri").alias("_u"), F.col("_block").alias("_b"), "_first", "_most", "_before", "_end")
    rows = df.join(F.broadcast(places) if seen.bytes <= BROADCAST_BYTES else places, (F.col("_uri") == F.col("_u")) & (F.col("_block") == F.col("_b"))).drop("_u", "_b")
    place = F.col("_id") - F.col("_first")
    if (seen.most or 1) > 1:
        so_far = F.sum(F.size("v")).over(Window.partitionBy("_uri", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
        plain = rows.where(F.col("_most") == 1).withColumn("_at", place)
        rows, place = plain.unionByName(rows.where(F.col("_most") > 1).withColumn("_at", F.coalesce(so_far, F.lit(0)))), F.col("_at")
    rows = rows.withColumn("_line", place + F.col("_before") + 1)
    if odd:
        ends = spark.createDataFrame(odd, "_o string, _mark boolean, _ended boolean")
        small = sum(len(u) + 32 for u, *_ in odd) <= BROADCAST_BYTES
        rows = rows.join(F.broadcast(ends) if small else ends, F.col("_uri") == F.col("_o"), "left")
        open_end = ~F.coalesce("_ended", F.lit(True)) & (F.col("_id") == F.col("_end")) & (F.element_at("v", -1) == "") & (F.size("v") > 1)
        v = F.when(open_end, F.slice("v", F.lit(1), F.size("v") - 1)).otherwise(F.col("v"))
        marked = F.coalesce("_mark", F.lit(False)) & (F.col("_line") == 1)
        rows = rows.withColumn("v", F.transform(v, lambda x, i: F.when(marked & (i == 0), F.concat(F.lit("\ufeff"), x)).otherwise(x)))
    rows = _named(spark, files, rows.select("_uri", "_line", F.posexplode("v").alias("pos", "value")))
    return rows.select("file", "file_ord", (F.col("_line") + F.col("pos")).cast("long").alias("line_no"), "value")


def _ends(file: LogFile, stream) -> tuple[bool, bool]:
    """Whether a file starts with a byte order mark, and whether a line feed or carriage return ends it."""
    mark = bytes(stream.readNBytes(3)) == b"\xef\xbb\xbf"
    stream.seek(max(0, file.size - 1))
    return mark, bytes(stream.readNBytes(1)) in (b"\n", b"\r")


def read_files(spark: SparkSession, files: list[LogFile], kept: list[DataFrame] | None = None) -> DataFrame:
    """kept: gets what stays in memory for the lines of large files."""
    large = [(i, f) for i, f in enumerate(files) if f.size > WHOLE_BYTES]
    small = [(i, f) for i, f in enumerate(files) if f.size <= WHOLE_BYTES]
    parts = [whole(spark, small)] if small else []
    parts += [blocks(spark, large, kept)] if large else []
    return reduce(DataFrame.unionByName, parts)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files of all paths; their ordinals are their places in ``listed``."""
    return read_files(spark, listed(spark, paths))
