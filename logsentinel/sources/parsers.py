"""Lines to events and failures, in built-in expressions only.

A parser takes a DataFrame of (file, file_ord, line_no, value) and returns the EVENT columns plus ``reason``, which is
null for an event and says what is wrong for a failure. A malformed line is data, never an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_LINE, java_regex
from ..schema import EVENT
from .lines import LogFile, heads

# Line formats (fixed values).
ACCESS_LINE = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\d+|-)(\s+"([^"]*)"\s+"([^"]*)")?\s*$'
AUTH_LINE = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
FROM_IP = r"\bfrom\s+(\d{1,3}(?:\.\d{1,3}){3})\b"
USERS = (r"\bfor\s+invalid user\s+(\S+)", r"\bfor\s+user\s+(\S+)", r"\bfor\s+(\S+)\s+from\b", r"\binvalid user\s+(\S+)", r"\buser\s+(\S+)", r"^(\S+)\s+:\s+TTY=")
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

SNIFF_LINES, SNIFF_SHARE = 20, 0.6


class UnknownFormatError(Exception):
    """No parser recognises a file, or there is none of that name."""


def clean(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, r"[\r\n]+$", ""), 1, MAX_LINE)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, java_regex(pattern), group)


#: A character that hardly any text holds; parts the groups of a line that is matched once. In texts that hold it, it is
#: written as the other character and 1 before the match, and put back in each group.
_SEP, _ESCAPE = "\uffff", "\ufffe"


def _swapped(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of one match ('' for those without part in it), or the text alone where it does not match."""

    def cut(t: Column) -> Column:
        return F.split(F.regexp_replace(t, java_regex(pattern), _SEP.join(f"${i}" for i in range(1, n + 1))), _SEP)

    held = _swapped(text, (_ESCAPE, f"{_ESCAPE}0"), (_SEP, f"{_ESCAPE}1"))
    rare = F.transform(cut(held), lambda x: _swapped(x, (f"{_ESCAPE}1", _SEP), (f"{_ESCAPE}0", _ESCAPE)))
    return F.when(text.contains(_SEP), rare).otherwise(cut(text))


def _null_if(text: Column, what: str) -> Column:
    return F.when(text != what, text)


def parse_access(lines: DataFrame, reference: Column | datetime | None = None) -> DataFrame:
    """Web access lines in the common or combined format."""
    raw = F.col("_raw")
    df = lines.withColumn("_raw", clean(F.col("value"))).withColumn("_p", _groups(raw, ACCESS_LINE, 9)).withColumn("_ok", F.size("_p") == 9)
    part = lambda i: F.get("_p", F.lit(i - 1))
    at = part(3)
    ts = F.coalesce(*(F.try_to_timestamp(at, F.lit(f"d/MMM/yyyy:HH:mm:ss {z}")) for z in ("Z", "xxx")))
    request = F.split(part(4), " ")
    tail = part(7) != ""
    df = df.withColumn("timestamp", F.when(F.col("_ok"), ts))
    reason = F.when(raw == "", "empty line").when(~F.col("_ok"), "does not match Apache access-log format").when(F.col("timestamp").isNull(), "invalid or missing Apache timestamp")
    extra = F.struct(
        F.get(request, F.lit(2)).alias("protocol"), F.when(tail, part(8)).alias("referer"), F.when(tail, part(9)).alias("user_agent"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("program", "string"), ("pid", "bigint"), ("host", "string"), ("future_dated", "boolean"))))
    return df.select(
        F.lit("web").alias("source"), "file", "file_ord", "line_no", "timestamp", raw.alias("raw"), _null_if(part(1), "-").alias("ip"), _null_if(part(2), "-").alias("user"),
        _null_if(F.get(request, F.lit(0)), "").alias("method"), F.get(request, F.lit(1)).alias("path"), part(5).try_cast("int").alias("status"),
        part(6).try_cast("bigint").alias("size"), F.lit(None).cast("string").alias("message"), extra.alias("extra"), reason.alias("reason"))


def auth_timestamp(month: Column, day: Column, clock: Column, reference: Column) -> Column:
    """The year that a yearless timestamp most plausibly has: the reference's, one less for a month well ahead of it,
    and for an impossible date the nearest earlier year that has it."""
    h, m, s = (F.substring(clock, p, 2).cast("int") for p in (1, 4, 7))
    year = F.year(reference)

    def at(back: int) -> Column:
        made = F.try_make_timestamp(year - back, month, day, h, m, s.cast("decimal(16,6)"))
        return F.when((s < 60) & (m < 60) & (h < 24), made)

    wrapped = month > F.month(reference) + 1
    return F.coalesce(F.when(at(0).isNotNull() & wrapped, at(1)), at(0), *(at(k) for k in range(1, 8)))


def parse_auth(lines: DataFrame, reference: Column | datetime | None = None) -> DataFrame:
    """Syslog auth lines; reference is the instant that years are inferred from (now, if none is given)."""
    ref = F.current_timestamp() if reference is None else reference if isinstance(reference, Column) else F.lit(reference)
    raw, message = F.col("_raw"), F.col("_message")
    df = lines.withColumn("_raw", clean(F.col("value"))).withColumn("_p", _groups(raw, AUTH_LINE, 7)).withColumn("_ok", F.size("_p") == 7).withColumn("_ref", ref)
    part = lambda i: F.get("_p", F.lit(i - 1))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(1)).cast("int")
    day = part(2).try_cast("int")
    df = df.withColumn("timestamp", F.when(F.col("_ok") & (month > 0), auth_timestamp(month, day, part(3), F.col("_ref")))).withColumn("_message", F.when(F.col("_ok"), part(7)))
    reason = F.when(raw == "", "empty line").when(~F.col("_ok"), "does not match syslog auth format").when(F.col("timestamp").isNull(), "invalid syslog timestamp")
    extra = F.struct(
        *(F.lit(None).cast("string").alias(n) for n in ("protocol", "referer", "user_agent")), part(5).alias("program"), part(6).try_cast("bigint").alias("pid"),
        part(4).alias("host"), F.when(F.col("timestamp") > F.col("_ref") + F.expr("INTERVAL 1 DAY"), True).alias("future_dated"))
    return df.select(
        F.lit("auth").alias("source"), "file", "file_ord", "line_no", "timestamp", raw.alias("raw"), ip_of(message).alias("ip"), user_of(message).alias("user"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("method", "string"), ("path", "string"), ("status", "int"), ("size", "bigint"))), message.alias("message"), extra.alias("extra"), reason.alias("reason"))


def ip_of(message: Column) -> Column:
    return _null_if(_part(message, FROM_IP, 1), "")


def user_of(message: Column) -> Column:
    """The first of the patterns, in their order, that finds a user."""
    return F.coalesce(*(_null_if(_part(message, p, 1), "") for p in USERS))


@dataclass(frozen=True)
class Parser:
    name: str
    source: str
    line: str
    parse: Callable[..., DataFrame]


ACCESS = Parser("apache", "web", ACCESS_LINE, parse_access)
AUTH = Parser("syslog", "auth", AUTH_LINE, parse_auth)
#: In order of preference where scores tie.
PARSERS = [ACCESS, AUTH]
NAMES: dict[str, Parser] = {"apache": ACCESS, "web": ACCESS, "access": ACCESS, "syslog": AUTH, "auth": AUTH}


def register(parser: Parser, *names: str) -> None:
    """Add a parser of one's own under its names; it is sniffed after those before it."""
    PARSERS.append(parser)
    NAMES.update({n.strip().lower(): parser for n in (parser.name, *names)})


def available_formats() -> tuple[str, ...]:
    return tuple(sorted(NAMES))


def get_parser(name: str) -> Parser:
    key = name.strip().lower()
    if key not in NAMES:
        raise UnknownFormatError(f"unknown format {name!r}; valid: {', '.join(available_formats())}")
    return NAMES[key]


def sniff_scores(lines: DataFrame) -> DataFrame:
    """file_ord and, for each parser, the share of the first non-blank lines that it recognises."""
    shares = [F.coalesce(F.avg(clean(F.col("value")).rlike(java_regex(p.line)).cast("int")), F.lit(0.0)).alias(p.name) for p in PARSERS]
    blank = F.trim(F.regexp_replace("value", r"(?U)\s+", "")) == ""
    return lines.where((F.col("line_no") <= SNIFF_LINES) & ~blank).groupBy("file_ord").agg(*shares)


def sniffed(spark: SparkSession, files: list[LogFile]) -> list[Parser]:
    """The parser of each file, from its first lines alone; a file that none recognises is an error."""
    rows = [(i, k, x) for i, first in enumerate(heads(spark, files, SNIFF_LINES, MAX_LINE)) for k, x in enumerate(first, 1)]
    scores = {}
    if rows:
        scores = {r.file_ord: r.asDict() for r in sniff_scores(spark.createDataFrame(rows, "file_ord int, line_no long, value string")).collect()}  # a row a file
    chosen = [choose(scores.get(i, {})) for i in range(len(files))]
    for file, parser in zip(files, chosen, strict=True):
        if parser is None:
            raise UnknownFormatError(f"could not detect the log format of {file.name}")
    return chosen


def choose(score: dict[str, float]) -> Parser | None:
    best = max(PARSERS, key=lambda p: score.get(p.name, 0.0))
    return best if score.get(best.name, 0.0) >= SNIFF_SHARE else None


def events_and_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where("reason IS NULL").select(EVENT.names), parsed.where("reason IS NOT NULL").select("file", "line_no", "reason")
