"""Row types shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severities and their ranks (fixed values).
SEVERITY = {"low": 10, "medium": 20, "high": 30, "critical": 40}
#: Web files come before auth files in the total order of events.
SOURCE_RANK = {"web": 0, "auth": 1}

EVIDENCE = "struct<file:string,line_no:bigint,excerpt:string>"



def _struct(**columns: str | T.DataType) -> T.StructType:
    out = T.StructType()
    for name, kind in columns.items():
        out.add(name, kind)
    return out


EVENT = _struct(
    source="string", file="string", file_ord="integer", line_no="long", timestamp="timestamp", raw="string", ip="string", user="string", method="string", path="string", status="integer", size="long", message="string",
    extra=_struct(protocol="string", referer="string", user_agent="string", program="string", pid="long", host="string", future_dated="boolean"))
FAILURE = _struct(file="string", line_no="long", reason="string")

#: Position of an event in the total order; ties of the one-second timestamps are decided by file and line.
ORDER = "struct<us:bigint,source_rank:int,file_ord:int,line_no:bigint>"

_STRINGS = T.ArrayType(T.StringType())
FINDING = _struct(
    finding_id="string", rule_id="string", severity="string", severity_rank="integer", title="string", description="string", first_seen="timestamp", last_seen="timestamp", count="long", ip="string", users=_STRINGS,
    evidence=T.ArrayType(_struct(file="string", line_no="long", excerpt="string")), correlated_rule_ids=_STRINGS, rule_ord="integer", emit=_struct(us="long", source_rank="integer", file_ord="integer", line_no="long"))


def order_of() -> Column:
    rank = F.when(F.col("source") == "web", 0).otherwise(1)
    return F.struct(F.unix_micros("timestamp").alias("us"), rank.alias("source_rank"), F.col("file_ord").cast("int").alias("file_ord"), F.col("line_no").cast("long").alias("line_no"))


def severity_rank(name: str) -> int:
    key = str(name).strip().lower()
    if key not in SEVERITY:
        raise ValueError(f"unknown severity {name!r}; valid: {', '.join(SEVERITY)}")
    return SEVERITY[key]
