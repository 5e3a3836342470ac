"""A stream source that follows text files: only complete lines, bounded bytes a poll, rotation restarts a file.

Offsets (inode, byte, line of each file) are durable in the query's checkpoint. With format ``auto`` a file's lines wait
until its format is recognised; of those waiting the latest 100 are kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.text import MAX_LINE
from ..sources.parsers import PARSERS, SNIFF_SHARE

POLL_BYTES = 8 << 20
PENDING = 100
SCHEMA = "file string, file_ord int, line_no long, value string, format string"


def sniff(lines: list[str]) -> str | None:
    """Name of the parser that recognises enough of the lines."""
    seen = [x.rstrip("\r\n")[:MAX_LINE] for x in lines if x.strip()]
    best, score = None, 0.0
    for p in PARSERS:
        share = sum(bool(re.match(p.line, x)) for x in seen) / len(seen) if seen else 0.0
        if share >= SNIFF_SHARE and share > score:
            best, score = p.name, share
    return best


class TailSource(DataSource):
    """Options: paths (a JSON list), format (auto or a parser's name), maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(json.loads(self.options["paths"]), self.options.get("format", "auto"), int(self.options.get("maxBytes", POLL_BYTES)))


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, paths: list[str], fmt: str = "auto", limit: int = POLL_BYTES):
        self.paths, self.fmt, self.limit = paths, fmt, limit

    def initialOffset(self) -> dict:
        return {str(i): [0, 0, 0, "" if self.fmt == "auto" else self.fmt] for i in range(len(self.paths))}

    def _lines(self, path: str, at: int, end: int | None) -> tuple[list[str], int]:
        """Complete lines from byte at, and the byte after them; a line longer than the limit is read to its end."""
        try:
            with open(path, "rb") as f:
                f.seek(at)
                data = f.read(self.limit if end is None else end - at)
                while end is None and data and b"\n" not in data and (more := f.read(self.limit)):
                    data += more
        except OSError:
            return [], at
        data = data[: data.rfind(b"\n") + 1]
        return [x.rstrip(b"\r").decode("utf-8", "replace") for x in data.split(b"\n")[:-1]], at + len(data)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, new = [], {}
        for i, path in enumerate(self.paths):
            inode, at, line, fmt = start.get(str(i), [0, 0, 0, "" if self.fmt == "auto" else self.fmt])
            try:
                stat = os.stat(path)
            except OSError:
                new[str(i)] = [inode, at, line, fmt]
                continue
            if (inode and stat.st_ino != inode) or stat.st_size < at:
                at, line = 0, 0
            got, to = self._lines(path, at, None)
            if not fmt and got:
                fmt = sniff(got) or ""
                if not fmt:  # wait, but only for the latest lines
                    drop = max(0, len(got) - PENDING)
                    if drop:
                        with open(path, "rb") as f:
                            f.seek(at)
                            at += sum(len(f.readline()) for _ in range(drop))
                        line += drop
                    new[str(i)] = [stat.st_ino, at, line, ""]
                    continue
            rows += [(path, i, line + k + 1, x, fmt) for k, x in enumerate(got)]
            new[str(i)] = [stat.st_ino, to, line + len(got), fmt]
        return iter(rows), new

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for i, path in enumerate(self.paths):
            _, at, line, _ = start.get(str(i), [0, 0, 0, ""])
            _, to, last, fmt = end[str(i)]
            if to < at or last < line:
                at, line = 0, 0
            if fmt and to > at:
                for k, x in enumerate(self._lines(path, at, to)[0]):
                    yield path, i, line + k + 1, x, fmt

    def commit(self, end: dict) -> None:
        pass
