"""The batch plan: files to events, failures and findings."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors
from ..operators.correlate import correlate
from ..operators.shared import detect as detect_shared
from ..operators.shared import detect_apart as detect_shared_apart
from ..rules import AppConfig, RuleConfig
from ..schema import FINDING
from ..sources import lines as text
from ..sources import parsers

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class AnalysisResult:
    events: DataFrame
    failures: DataFrame
    findings: DataFrame
    kept: tuple[DataFrame, ...] = ()
    #: Where it stands apart from the findings: rows of (finding_id, part, place, file, line_no, excerpt).
    evidence: DataFrame | None = None
    seen: Observation | None = None

    def totals(self) -> dict[str, int]:
        """Events and failures, as the pass that parsed the lines has counted them."""
        if self.seen is None:
            return {"events": self.events.count(), "failures": self.failures.count()}
        return dict(self.seen.get)

    def unpersist(self) -> None:
        """Release what the plan keeps; the frames can still be computed."""
        for df in self.kept:
            df.unpersist()


def parse_files(spark: SparkSession, paths: list[str], fmt: str = "auto", reference: datetime | None = None, kept: list[DataFrame] | None = None) -> DataFrame:
    """All lines of all files, parsed. Web files are parsed first: their latest event is the instant that the yearless
    auth timestamps are read against (else now), unless a reference is given. kept: gets what stays in memory."""
    files = text.listed(spark, paths)
    chosen = parsers.sniffed(spark, files) if fmt.strip().lower() == "auto" else [parsers.get_parser(fmt)] * len(files)
    lines = text.read_files(spark, files, kept)

    def of(parser: parsers.Parser) -> DataFrame:
        return lines.where(F.col("file_ord").isin(*(i for i, p in enumerate(chosen) if p is parser)))

    used = list(dict.fromkeys(chosen))
    web = [p.parse(of(p)) for p in used if p.source != "auth"]
    parts = list(web)
    if any(p.source == "auth" for p in used):
        if reference is None and web:
            latest = reduce(DataFrame.unionByName, web).agg(F.unix_micros(F.max("timestamp")).alias("us")).first().us
            reference = datetime.fromtimestamp(latest / 1e6, UTC) if latest is not None else None
        reference = reference or datetime.now(UTC)
        parts += [p.parse(of(p), F.timestamp_micros(F.lit(round(reference.timestamp() * 1e6)))) for p in used if p.source == "auth"]
    return reduce(DataFrame.unionByName, parts)


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def split_rules(config: AppConfig) -> tuple[list[tuple[int, RuleConfig]], list[tuple[int, RuleConfig]], dict[str, str | None]]:
    """Enabled detectors and correlations with their places, and the source of each rule."""
    rules = list(enumerate(config.enabled_rules()))
    last = len(rules)
    found = [(i, r) for i, r in rules if r.type != "multi-vector-correlation"]
    return found, [(last + i, r) for i, r in rules if r.type == "multi-vector-correlation"], {r.id: r.source for _, r in rules}


def detect(events: DataFrame, config: AppConfig) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Findings of all enabled rules, correlations last; these never feed other correlations. And what is kept for them."""
    rules, joint, sources = split_rules(config)
    shared, own = [(i, r) for i, r in rules if r.type in detectors.KINDS], [(i, r) for i, r in rules if r.type not in detectors.KINDS]
    parts, kept = [detectors.build(events, r, i) for i, r in own], ()
    if shared:
        found, kept = detect_shared(events, shared, keep=True)
        parts.insert(0, found)
    found = reduce(DataFrame.unionByName, parts) if parts else empty_findings(events.sparkSession)
    if joint:
        found = found.persist(StorageLevel.MEMORY_AND_DISK)  # read by each correlation and the union
        kept = (*kept, found)
    return reduce(DataFrame.unionByName, [correlate(found, r, sources, i) for i, r in joint], found), kept


def detect_apart(events: DataFrame, config: AppConfig) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """As detect, with the evidence as a table beside the findings: no row grows with the hits of an address. That of a
    correlation is that of its members, one part after the other."""
    rules, joint, sources = split_rules(config)
    shared, own = [(i, r) for i, r in rules if r.type in detectors.KINDS], [(i, r) for i, r in rules if r.type not in detectors.KINDS]
    found, proof, kept = [empty_findings(events.sparkSession)], [], ()
    if shared:
        findings, rows, kept = detect_shared_apart(events, shared)
        found, proof = [findings], [rows]
    for i, r in own:  # detectors of one's own make lists
        listed = detectors.build(events, r, i)
        proof.append(unnested(listed))
        found.append(listed.withColumn("evidence", F.slice("evidence", 1, 0)))
    findings = reduce(DataFrame.unionByName, found)
    rows = reduce(DataFrame.unionByName, proof) if proof else unnested(findings)
    if joint:
        joined = reduce(DataFrame.unionByName, [correlate(findings, r, sources, i, "members") for i, r in joint]).persist(StorageLevel.MEMORY_AND_DISK)
        members = joined.select(F.col("finding_id").alias("_of"), F.posexplode("members").alias("_part", "finding_id"))
        theirs = rows.join(members, "finding_id").select(F.col("_of").alias("finding_id"), F.col("_part").alias("part"), "place", "file", "line_no", "excerpt")
        findings, rows, kept = findings.unionByName(joined.drop("members")), rows.unionByName(theirs), (*kept, joined)
    return findings, rows, kept


def unnested(findings: DataFrame) -> DataFrame:
    """The evidence lists of findings as a table."""
    place = F.struct(F.col("_i").cast("long").alias("us"), F.lit(0).alias("source_rank"), F.lit(0).alias("file_ord"), F.lit(0).cast("long").alias("line_no"))
    return findings.select("finding_id", F.posexplode("evidence").alias("_i", "_e")).select("finding_id", F.lit(0).alias("part"), place.alias("place"), "_e.*")


def nested(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with their evidence as lists again, for those who want single rows: one holds all lines of its finding."""
    lists = evidence.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "file", "line_no", "excerpt"))).alias("_l"))
    lists = lists.select(F.col("finding_id").alias("_id"), F.transform("_l", lambda x: F.struct(x["file"].alias("file"), x["line_no"].alias("line_no"), x["excerpt"].alias("excerpt"))).alias("_l"))
    got = findings.join(lists, findings["finding_id"] == lists["_id"], "left")
    return got.withColumn("evidence", F.coalesce("_l", "evidence").cast(findings.schema["evidence"].dataType)).select(*findings.columns)


def analyze(spark: SparkSession, paths: list[str], config: AppConfig, fmt: str = "auto", reference: datetime | None = None, warn: int = 20, apart: bool = False) -> AnalysisResult:
    """Parsed lines are kept for the rules that read them (memory, then disk); failures are counted and the first logged.
    apart: the evidence is a table of the result, and the lists of the findings are empty."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    kept: list[DataFrame] = []
    seen = Observation("lines")
    parsed = parse_files(spark, paths, fmt, reference, kept).observe(seen, F.count(F.when(F.col("reason").isNull(), 1)).alias("events"), F.count("reason").alias("failures"))
    parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    events, failures = parsers.events_and_failures(parsed)
    for f in failures.orderBy("file", "line_no").limit(max(1, warn)).collect()[:warn]:  # reads, keeps and counts all lines
        log.warning("%s:%d: %s", f.file, f.line_no, f.reason)
    proof = None
    if apart:
        findings, proof, more = detect_apart(events, config)
    else:
        findings, more = detect(events, config)
    return AnalysisResult(events, failures, findings, (parsed, *more, *kept), proof, seen)


def in_order(findings: DataFrame) -> DataFrame:
    """The order in which the rules report."""
    return findings.orderBy("rule_ord", "emit", "ip")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    from ..rules import ConfigError
    from ..schema import severity_rank

    try:
        return findings.where(F.col("severity_rank") >= severity_rank(severity))
    except ValueError as e:
        raise ConfigError(str(e)) from e


def exit_code(visible: DataFrame) -> int:
    """1 if any finding shown is high or critical."""
    return 0 if visible.where("severity_rank >= 30").isEmpty() else 1
