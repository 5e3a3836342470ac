"""Findings to JSON, CSV, SARIF and a console report. Every text leaves through ``exported``, which redacts it.

A document is written piece by piece: executors make the text of each finding, in report order, and the driver passes one
partition of them at a time on to the file, between a head and a tail."""

from __future__ import annotations

import csv
import itertools
import json
import os
import textwrap
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from io import StringIO
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.text import iso, redact
from ..plans.analyze import in_order, nested
from ..schema import EVIDENCE, ORDER

#: Findings rendered at once.
ROWS = 64
# Fixed values of the formats.
FIELDS = ["finding_id", "rule_id", "severity", "title", "description", "ip", "first_seen", "last_seen", "count", "users", "correlated_rule_ids", "evidence"]
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
LEVELS = {"LOW": "note", "MEDIUM": "warning", "HIGH": "error", "CRITICAL": "error"}


def exported(findings: DataFrame, ordered: bool = True) -> DataFrame:
    """The columns that leave the engine, redacted; in report order, unless part files without one will do."""
    safe = F.transform("evidence", lambda e: F.struct(e["file"].alias("file"), e["line_no"].alias("line_no"), redact(e["excerpt"]).alias("excerpt")))
    return (in_order(findings) if ordered else findings).select(*_safe(), safe.alias("evidence"))


def _safe() -> list[Column | str]:
    """All columns that leave but the evidence, redacted."""
    return [
        "finding_id", "rule_id", "severity", redact(F.col("title")).alias("title"), redact(F.col("description")).alias("description"), "ip", F.transform("users", redact).alias("users"),
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"), "count", "correlated_rule_ids"]


def to_dicts(findings: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in exported(findings).toLocalIterator()]


def _rendered(findings: DataFrame, render: Callable[[dict[str, Any]], Any], depth: int) -> DataFrame:
    """(text) of what render makes of each finding, indented as it stands in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                said = [_indented(render(r), depth) for r in b.slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], names=["text"])

    return exported(findings).mapInArrow(run, "text string")


def _joined(rows: DataFrame, head: str, tail: str, empty: str) -> Iterator[str]:
    """Pieces of a document; a partition of rows at a time is on the driver."""
    between = head
    for r in rows.toLocalIterator():
        yield between
        yield r.text
        between = ",\n"
    yield tail if between != head else empty


@dataclass(frozen=True)
class Layout:
    """How a document puts findings and their evidence together: text of a finding up to its evidence, text of a line of
    evidence, and what stands before, between and after these."""

    finding: Callable[[dict[str, Any]], str]
    line: Callable[[dict[str, Any]], str]
    start: str
    between: str
    stop: str
    none: str
    end: str
    next: str


def _pieces_apart(findings: DataFrame, evidence: DataFrame, layout: Layout) -> DataFrame:
    """(is_finding, text): each finding and then its evidence, line by line, in report order. The sort's ranges cut through the
    evidence of a large finding, so no row and no partition grows with it."""
    order = ["rule_ord", "emit", "ip", "finding_id"]
    heads = findings.select(*order, F.lit(-1).alias("part"), F.lit(None).cast(ORDER).alias("place"), F.struct(*_safe()).alias("f"), F.lit(None).cast(EVIDENCE).alias("e"))
    line = F.struct("file", "line_no", redact(F.col("excerpt")).alias("excerpt")).cast(EVIDENCE)
    lines = evidence.join(findings.select(*order), "finding_id").select(*order, "part", "place", F.lit(None).cast(heads.schema["f"].dataType).alias("f"), line.alias("e"))
    rows = heads.unionByName(lines).orderBy(*order, "part", "place").select("f", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                got = b.slice(at, ROWS).to_pylist()
                said = [layout.line(r["e"]) if r["f"] is None else layout.finding(r["f"]) for r in got]
                yield pa.RecordBatch.from_arrays([pa.array([r["f"] is not None for r in got]), pa.array(said, pa.string())], names=["is_finding", "text"])

    return rows.mapInArrow(run, "is_finding boolean, text string")


def _joined_apart(rows: DataFrame, layout: Layout, head: str, tail: str, empty: str) -> Iterator[str]:
    """Pieces of a document, as they come."""
    said, lines = False, False
    for r in rows.toLocalIterator():
        if r.is_finding:
            yield (layout.stop if lines else layout.none) + layout.end + layout.next if said else head
            said, lines = True, False
        else:
            yield layout.between if lines else layout.start
            lines = True
        yield r.text
    yield (layout.stop if lines else layout.none) + layout.end + tail if said else empty


def _indented(value: Any, depth: int) -> str:
    return textwrap.indent(json.dumps(value, indent=2, ensure_ascii=False), " " * depth, lambda line: True)


def _objects(key: str, depth: int, none: str, finding: Callable[[dict[str, Any]], Any], line: Callable[[dict[str, Any]], Any]) -> Layout:
    """A JSON object a finding, whose last member is the list of its evidence."""
    pad, end = " " * (depth + 2), "\n" + " " * depth + "}"
    return Layout(lambda f: _indented(finding(f), depth).removesuffix(end), lambda e: _indented(line(e), depth + 4), f',\n{pad}"{key}": [\n', ",\n", f"\n{pad}]", none, end, ",\n")


def json_pieces(findings: DataFrame, evidence: DataFrame | None = None) -> Iterator[str]:
    """evidence: the table of it, where the findings' own lists are empty; the document is the same."""
    if evidence is None:
        return _joined(_rendered(findings, dict, 2), "[\n", "\n]", "[]")
    layout = _objects("evidence", 2, ',\n    "evidence": []', dict, dict)
    return _joined_apart(_pieces_apart(findings, evidence, layout), layout, "[\n", "\n]", "[]")


def to_json(findings: DataFrame) -> str:
    return "".join(json_pieces(findings))


def csv_columns(findings: DataFrame, ordered: bool = True) -> DataFrame:
    """One string or number a field: users and rule ids joined by ';', evidence as file:line."""
    places = F.transform("evidence", lambda e: F.concat(e["file"], F.lit(":"), e["line_no"].cast("string")))
    return exported(findings, ordered).withColumns({"users": F.array_join("users", ";"), "correlated_rule_ids": F.array_join("correlated_rule_ids", ";"), "evidence": F.array_join(places, ";")}).select(FIELDS)


def _csv_row(values: Iterable[Any]) -> str:
    out = StringIO()
    csv.writer(out).writerow(["" if v is None else v for v in values])
    return out.getvalue()


def csv_pieces(findings: DataFrame, evidence: DataFrame | None = None) -> Iterator[str]:
    """evidence: as for json_pieces; its cells are quoted then."""
    if evidence is None:
        return map(_csv_row, itertools.chain([FIELDS], csv_columns(findings).toLocalIterator()))

    def finding(f: dict[str, Any]) -> str:
        f |= {"users": ";".join(f["users"]), "correlated_rule_ids": ";".join(f["correlated_rule_ids"])}
        return _csv_row([*(f[c] for c in FIELDS[:-1]), ""]).removesuffix("\r\n")

    layout = Layout(finding, lambda e: f"{e['file']}:{e['line_no']}".replace('"', '""'), '"', ";", '"', "", "\r\n", "")
    names = _csv_row(FIELDS)
    return _joined_apart(_pieces_apart(findings, evidence, layout), layout, names, "", names)


def to_csv(findings: DataFrame) -> str:
    return "".join(csv_pieces(findings))


def artifact_uri(file: str, base: str | None = None) -> str:
    """A file's path with forward slashes, relative to base (the working folder) if it is absolute."""
    uri = file.replace("\\", "/").removeprefix("./")
    return os.path.relpath(uri, base).replace("\\", "/") if os.path.isabs(uri) else uri


def level_of(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == k, v) for k, v in LEVELS.items()), F.lit("warning"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """id, name and level (of the first finding) of each rule that reports."""
    first = F.min_by("severity", F.struct("rule_ord", "emit"))
    got = findings.groupBy(F.col("rule_id").alias("id")).agg(first.alias("s"))
    return got.select("id", F.initcap(F.replace(F.col("id"), F.lit("-"), F.lit(" "))).alias("name"), level_of(F.col("s")).alias("level")).orderBy("id")


def _sarif_result(f: dict[str, Any]) -> dict[str, Any]:
    return {"ruleId": f["rule_id"], "level": LEVELS.get(f["severity"], "warning"), "message": {"text": f["description"]}}


def _sarif_location(e: dict[str, Any], base: str) -> dict[str, Any]:
    return {"physicalLocation": {"artifactLocation": {"uri": artifact_uri(e["file"], base)}, "region": {"startLine": max(e["line_no"], 1)}}}


def sarif_results(findings: DataFrame) -> DataFrame:
    """(text) of each finding's result, in report order."""
    base = os.getcwd()

    def result(f: dict[str, Any]) -> dict[str, Any]:
        places = {"locations": [_sarif_location(e, base) for e in f["evidence"]]} if f["evidence"] else {}
        return _sarif_result(f) | places

    return _rendered(findings, result, 8)


def sarif_pieces(findings: DataFrame, evidence: DataFrame | None = None) -> Iterator[str]:
    """evidence: as for json_pieces."""
    rules = [{"id": r.id, "name": r.id, "shortDescription": {"text": r.name}, "defaultConfiguration": {"level": r.level}} for r in sarif_rules(findings).collect()]  # a row a rule
    tool = {"driver": {"name": "logsentinel", "version": __version__, "rules": rules}}
    around = json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": tool, "results": []}]}, indent=2, ensure_ascii=False)
    head, tail = around.rsplit("[]", 1)
    if evidence is None:
        return _joined(sarif_results(findings), f"{head}[\n", f"\n      ]{tail}", around)
    base = os.getcwd()
    layout = _objects("locations", 8, "", _sarif_result, lambda e: _sarif_location(e, base))
    return _joined_apart(_pieces_apart(findings, evidence, layout), layout, f"{head}[\n", f"\n      ]{tail}", around)


def to_sarif(findings: DataFrame) -> dict[str, Any]:
    return json.loads("".join(sarif_pieces(findings)))


def _write(pieces: Iterator[str], path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as out:
        for piece in pieces:
            out.write(piece)


WRITERS = {
    "json": lambda findings, path: _write(json_pieces(findings), path),
    "csv": lambda findings, path: _write(csv_pieces(findings), path),
    "sarif": lambda findings, path: _write(sarif_pieces(findings), path),
}


#: Of those, the ones that can take the evidence as a table.
PIECES = {"json": json_pieces, "csv": csv_pieces, "sarif": sarif_pieces}


def write(findings: DataFrame, path: str, fmt: str, evidence: DataFrame | None = None) -> None:
    """To one file. evidence: the table of it, where the findings' own lists are empty; writers of one's own get lists."""
    if evidence is None:
        WRITERS[fmt](findings, path)
    elif fmt in PIECES:
        _write(PIECES[fmt](findings, evidence), path)
    else:
        WRITERS[fmt](nested(findings, evidence), path)


def write_distributed(findings: DataFrame, path: str, fmt: str = "json", evidence: DataFrame | None = None) -> None:
    """Many findings: part files written by the executors (json lines, csv or parquet). With a table of evidence, folders
    findings and evidence, the second with finding_id, part and place as keys."""
    if evidence is not None:
        place = [F.col(f"place.{c}").alias(c) for c in ("us", "source_rank", "file_ord")]
        out = evidence.select("finding_id", "part", *place, "file", "line_no", redact(F.col("excerpt")).alias("excerpt"))
        out.write.format(fmt).options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).save(f"{path}/evidence")
        path = f"{path}/findings"
    df = csv_columns(findings, ordered=False) if fmt == "csv" else exported(findings, ordered=False)
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    df.write.format(fmt).options(**options).save(path)


def report(findings: DataFrame, events: int, failures: int) -> str:
    """Callouts of correlations, a table by severity and first sight, a summary."""
    order = findings.orderBy(F.desc("severity_rank"), "first_seen", "rule_ord", "emit")
    rows = order.select("severity", "rule_id", redact(F.col("title")).alias("title"), F.coalesce("ip", F.lit("-")).alias("ip"), "count", iso(F.col("first_seen")).alias("first"), iso(F.col("last_seen")).alias("last"), "correlated_rule_ids").collect()
    out = []
    joint = [r for r in rows if r.correlated_rule_ids]
    if joint:
        out += ["Correlated multi-vector attacks", *(f"  • {r.title} — rules: {', '.join(r.correlated_rule_ids)}" for r in joint), ""]
    table = [("Severity", "Rule", "Title", "IP", "Count", "First seen", "Last seen"), *((r.severity, r.rule_id, r.title, r.ip, str(r["count"]), r["first"], r["last"]) for r in rows)]
    width = [max(len(x[i]) for x in table) for i in range(7)]
    out += ["Findings", *("  ".join(c.ljust(w) for c, w in zip(x, width, strict=True)).rstrip() for x in table)]
    out.append(f"\n{len(rows)} finding(s) across {events} event(s); {failures} line(s) failed to parse.")
    return "\n".join(out)
