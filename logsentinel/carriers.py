"""Each operator of the engine as a query over the driver's tables, with the same thing in DuckDB SQL.

The events table stands in for logs: users become addresses, event types become statuses, paths and messages.
Timestamps are cut to seconds, as in both log formats, and event_id is the line number that decides ties.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import REDACTIONS, iso, redact, unquote
from .operators import detectors
from .operators.correlate import correlate, new_correlations
from .plans.analyze import at_least, detect_apart, exit_code
from .rules import AlertConfig, AppConfig, RuleConfig
from .session import shared_folder
from .sinks import export
from .sinks.alerts import loud
from .sources import lines as text
from .sources import parsers

DAY = 86_400

EV = """ev AS (SELECT event_id, epoch_us(date_trunc('{cut}', ts)) AS us, date_trunc('{cut}', ts) AS t, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip FROM events)"""


def base(spark: SparkSession, sf_dir: str, cut: str = "second") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    return e.select("event_id", F.date_trunc(cut, F.col("ts").cast("timestamp")).alias("timestamp"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), ip.alias("ip"))


def _status() -> Column:
    return F.when(F.col("event_type") == "error", 401).when(F.col("event_type") == "signup", 200).when(F.col("event_type") == "click", 404).when(F.col("event_type") == "view", 204).otherwise(302)


STATUS = "CASE event_type WHEN 'error' THEN 401 WHEN 'signup' THEN 200 WHEN 'click' THEN 404 WHEN 'view' THEN 204 ELSE 302 END"


def as_events(spark: SparkSession, sf_dir: str, cut: str = "second", path: Column | None = None) -> DataFrame:
    """Both a web and an auth reading of each event, told apart by source."""
    b = base(spark, sf_dir, cut).withColumns({"file": F.lit("events"), "file_ord": F.lit(0), "line_no": F.col("event_id"), "method": F.lit("GET"), "size": F.lit(None).cast("bigint"), "_k": F.col("k").cast("string")})
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "ip")
    nothing = F.lit(None).cast("string")

    def extra(program: str | None) -> Column:
        return F.struct(*(nothing.alias(n) for n in ("protocol", "referer", "user_agent")), F.lit(program).cast("string").alias("program"), F.lit(None).cast("bigint").alias("pid"), nothing.alias("host"), F.lit(None).cast("boolean").alias("future_dated"))

    said = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed password for root from "), "ip")).when(F.col("event_type") == "signup", F.concat(F.lit("Accepted password for root from "), "ip"))
        .when(F.col("event_type") == "view", F.concat(F.lit("Failed for invalid user n"), "_k")).otherwise(F.concat(F.lit("alice : TTY=pts/0 ; COMMAND=/bin/cat /etc/"), F.when(F.col("k") % 2 == 0, "shadow").otherwise("hosts"))))
    web = b.withColumns({"source": F.lit("web"), "raw": line, "user": nothing, "path": F.concat(F.lit("/p"), "_k") if path is None else path, "status": _status(), "message": nothing, "extra": extra(None)})
    auth = b.withColumns({"source": F.lit("auth"), "raw": line, "user": F.when(F.col("event_type") == "view", F.concat(F.lit("n"), "_k")).when(F.col("event_type") == "click", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))), "path": nothing, "status": F.lit(None).cast("int"), "message": said, "extra": extra("sudo")})
    return web.unionByName(auth).drop("k", "_k", "user_id", "event_type", "event_id")


def rule(kind: str, source: str, window: int = DAY, severity: str = "high", **params) -> RuleConfig:
    return RuleConfig(kind, kind, True, severity, source, window, params)


RULES = {
    "brute_force": rule("brute-force", "web", threshold=3, statuses=[401]),
    "brute_force_success": rule("brute-force-success", "web", severity="critical", threshold=3, statuses=[401], success_statuses=[200]),
    "rate_limit": rule("rate-limit-abuse", "web", severity="medium", threshold=3, statuses=[404]),
    "scanner_distinct": rule("scanner-burst", "web", 2 * DAY, "medium", threshold=4, statuses=[404], probe_paths=["/p"]),
    "user_enum_distinct": rule("ssh-invalid-user-enum", "auth", 2 * DAY, "low", threshold=3),
    "rapid_success": rule("rapid-success-after-failures", "auth", min_failures=3, max_gap_seconds=6 * 3600),
}
CORRELATION = RuleConfig("multi-vector-correlation", "multi-vector-correlation", True, "critical", None, 5 * DAY, {"min_distinct_rules": 2})
JOINED = ("brute_force", "rate_limit", "user_enum_distinct", "rapid_success")


def _shape(found: DataFrame) -> DataFrame:
    return found.select("ip", F.col("count").alias("n"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.size("evidence").cast("long").alias("n_evidence"), F.array_join("users", ",").alias("users"), "severity_rank")


def _detector(name: str, cut: str = "second"):
    return lambda spark, sf_dir: _shape(detectors.build(as_events(spark, sf_dir, cut), RULES[name]))


def _order(t: str = "") -> str:
    return f"{t}us, {t}event_id"


def _fires(name: str, where: str, w: int, th: int, distinct: str = "") -> str:
    """First firing row of each ip and its window, as CTEs {name}_f and {name}_h."""
    us = w * 1_000_000
    hit = f"n >= {th}" if not distinct else f"(SELECT count(DISTINCT x.v) FROM {name}_w x WHERE x.ip = y.ip AND x.rn BETWEEN y.rn - y.n + 1 AND y.rn) >= {th}"
    return f"""{name}_w AS (SELECT *, {distinct or 'NULL'} AS v, row_number() OVER (PARTITION BY ip ORDER BY {_order()}) AS rn,
  row_number() OVER (PARTITION BY ip ORDER BY {_order()}) - count(*) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {us + 1} PRECEDING) AS n FROM ev WHERE {where}),
{name}_f AS (SELECT * FROM {name}_w y WHERE {hit} QUALIFY row_number() OVER (PARTITION BY ip ORDER BY {_order()}) = 1),
{name}_h AS (SELECT f.ip, count(*) AS n, min(w.us) AS first_us, max(w.us) AS last_us, string_agg(DISTINCT w.v, ',' ORDER BY w.v) AS users, max(f.us) AS fire_us, max(f.event_id) AS fire_id FROM {name}_f f JOIN {name}_w w ON w.ip = f.ip AND w.rn BETWEEN f.rn - f.n + 1 AND f.rn GROUP BY f.ip)"""


_RAPID = f"""rs_t AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY {_order()} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM ev WHERE event_type IN ('error', 'signup')),
rs_g AS (SELECT ip, streak, count(*) AS n, min(us) AS first_us, max(us) AS last_us, max(CASE WHEN event_type = 'signup' THEN us END) AS s_us, max(CASE WHEN event_type = 'signup' THEN event_id END) AS fire_id, max(CASE WHEN event_type = 'error' THEN us END) AS f_us FROM rs_t GROUP BY ALL),
rs_h AS (SELECT ip, n, first_us, last_us, NULL AS users, s_us AS fire_us, fire_id FROM rs_g WHERE s_us IS NOT NULL AND n > 3 AND s_us - f_us BETWEEN 0 AND {6 * 3600 * 1_000_000})"""


def _out(name: str, rank: int, users: bool = False) -> str:
    return f"SELECT ip, n, first_us, last_us, n AS n_evidence, {'users' if users else chr(39) * 2} AS users, {rank} AS severity_rank FROM {name}_h"


_SECOND, _HOUR = EV.format(cut="second"), EV.format(cut="hour")
_BF = _fires("bf", "event_type = 'error'", DAY, 3)
_RL = _fires("rl", "event_type = 'click'", DAY, 3)
_UE = _fires("ue", "event_type = 'view'", 2 * DAY, 3, "'n' || k")
_SC = _fires("sc", "event_type = 'click'", 2 * DAY, 4, "'/p' || k")
_SUCCESS = f"""bs_t AS (SELECT *, event_type = 'error' AS f FROM ev WHERE event_type IN ('error', 'signup')),
bs_w AS (SELECT *, sum(f::INT) OVER (PARTITION BY ip ORDER BY {_order()} ROWS UNBOUNDED PRECEDING) - coalesce(sum(f::INT) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY * 1_000_000 + 1} PRECEDING), 0) AS nf FROM bs_t),
bs_f AS (SELECT * FROM bs_w WHERE NOT f AND nf >= 3 QUALIFY row_number() OVER (PARTITION BY ip ORDER BY {_order()}) = 1),
bs_h AS (SELECT s.ip, count(*) + 1 AS n, min(t.us) AS first_us, max(s.us) AS last_us FROM bs_f s JOIN bs_t t ON t.ip = s.ip AND t.f AND (t.us, t.event_id) < (s.us, s.event_id) AND t.us >= s.us - {DAY * 1_000_000} GROUP BY s.ip)"""
_ALL = f"""{_SECOND}, {_BF}, {_RL}, {_UE}, {_RAPID},
fi AS (SELECT 'brute-force' AS rule_id, 'web' AS src, 0 AS ord, 30 AS severity_rank, * FROM bf_h UNION ALL SELECT 'rate-limit-abuse', 'web', 1, 20, * FROM rl_h
  UNION ALL SELECT 'ssh-invalid-user-enum', 'auth', 2, 10, * FROM ue_h UNION ALL SELECT 'rapid-success-after-failures', 'auth', 3, 30, * FROM rs_h)"""
_CORR = f"""{_ALL}, fx AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY first_us, ord, fire_us, fire_id) AS i FROM fi),
an AS (SELECT a.ip, a.i, a.first_us FROM fx a JOIN fx m ON m.ip = a.ip AND m.i >= a.i AND m.first_us <= a.first_us + {5 * DAY * 1_000_000} GROUP BY a.ip, a.i, a.first_us
  HAVING count(DISTINCT m.rule_id) >= 2 AND count(DISTINCT m.src) >= 2 QUALIFY row_number() OVER (PARTITION BY a.ip ORDER BY a.i) = 1),
co AS (SELECT a.ip, string_agg(DISTINCT m.rule_id, ',' ORDER BY m.rule_id) AS rules, sum(m.n)::BIGINT AS n, min(m.first_us) AS first_us, max(m.last_us) AS last_us, count(*) AS members
  FROM an a JOIN fx m ON m.ip = a.ip AND m.i >= a.i AND m.first_us <= a.first_us + {5 * DAY * 1_000_000} GROUP BY a.ip)"""



def _proof(name: str, rule_id: str) -> str:
    return f"SELECT '{rule_id}' AS rule_id, f.ip, f.event_id AS fire_id, w.us, w.event_id, w.event_type FROM {name}_f f JOIN {name}_w w ON w.ip = f.ip AND w.rn BETWEEN f.rn - f.n + 1 AND f.rn"


_EVIDENCE = f"""{_CORR}, pr AS ({_proof("bf", "brute-force")} UNION ALL {_proof("rl", "rate-limit-abuse")} UNION ALL {_proof("ue", "ssh-invalid-user-enum")}
  UNION ALL SELECT 'rapid-success-after-failures', h.ip, h.fire_id, t.us, t.event_id, t.event_type FROM rs_h h JOIN rs_g g ON g.ip = h.ip AND g.fire_id = h.fire_id JOIN rs_t t ON t.ip = g.ip AND t.streak = g.streak),
me AS (SELECT m.ip, m.rule_id, m.fire_id, CAST(row_number() OVER (PARTITION BY m.ip ORDER BY m.i) - 1 AS INTEGER) AS part FROM an a JOIN fx m ON m.ip = a.ip AND m.i >= a.i AND m.first_us <= a.first_us + {5 * DAY * 1_000_000})"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = as_events(spark, sf_dir)
    return reduce(DataFrame.unionByName, [detectors.build(e, RULES[k], i) for i, k in enumerate(JOINED)])


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {RULES[k].id: RULES[k].source for k in JOINED}
    return correlate(findings(spark, sf_dir), CORRELATION, sources, len(JOINED))


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    line = F.concat(F.col("ip"), F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit("?k="), F.col("k").cast("string"), F.lit(' HTTP/1.1" '), _status().cast("string"), F.lit(" "),
                    F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.col("event_id").cast("string")), F.when(F.col("event_id") % 3 == 0, "").otherwise(' "-" "agent x"'), F.lit("\r\n"))
    return b.select(F.lit("events").alias("file"), F.lit(0).alias("file_ord"), F.col("event_id").alias("line_no"), line.alias("value"))


def parse_access_log(spark, sf_dir):
    """SRC-3, 7, 8, 9: events rendered as access lines and parsed again."""
    got = parsers.parse_access(access_lines(spark, sf_dir)).where("reason IS NULL")
    return got.select("line_no", F.unix_micros("timestamp").alias("us"), "ip", "user", "method", "path", "status", "size", F.col("extra.protocol").alias("protocol"), F.col("extra.referer").alias("referer"), F.col("extra.user_agent").alias("agent"))


def parse_failures(spark, sf_dir):
    """FLT-13: reasons of lines that were damaged in four ways."""
    n = F.col("line_no")
    bad = F.when(n % 97 == 0, F.lit("nonsense")).when(n % 97 == 1, F.lit("\r\n")).when(n % 97 == 2, F.regexp_replace("value", r" \+0000", "")).when(n % 97 == 3, F.regexp_replace("value", r"\[../", "[32/")).otherwise(F.col("value"))
    return parsers.events_and_failures(parsers.parse_access(access_lines(spark, sf_dir).withColumn("value", bad)))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def sniff_scores(spark, sf_dir):
    """SRC-4, 5: a file for each user, a third of its lines in the other format."""
    from pyspark.sql import Window

    lines = access_lines(spark, sf_dir).join(base(spark, sf_dir).select(F.col("event_id").alias("line_no"), F.col("user_id").cast("int").alias("_u")), "line_no").withColumn("file_ord", F.col("_u"))
    lines = lines.withColumn("value", F.when(F.col("line_no") % 3 == 0, F.lit("Jul  3 10:15:32 h sshd[1]: x")).when(F.col("line_no") % 7 == 0, F.lit("  ")).otherwise(F.col("value")))
    lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file_ord").orderBy("line_no")))
    return parsers.sniff_scores(lines).select("file_ord", F.round("apache", 9).alias("apache"), F.round("syslog", 9).alias("syslog"))


def syslog_year_inference(spark, sf_dir):
    """SRC-10 to 13: yearless timestamps read against an instant two days into the table."""
    b = base(spark, sf_dir)
    ref = b.agg((F.min("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("r")).first().r
    line = F.concat(F.date_format(F.when(F.col("event_id") % 4 == 0, F.col("timestamp") + F.expr("INTERVAL 120 DAYS")).otherwise(F.col("timestamp")), "MMM d HH:mm:ss"), F.lit(" web-01 sshd["), F.col("event_id").cast("string"), F.lit("]: Failed password for root from "), "ip")
    got = parsers.parse_auth(b.select(F.lit("f").alias("file"), F.lit(0).alias("file_ord"), F.col("event_id").alias("line_no"), line.alias("value")), ref)
    return got.select("line_no", F.unix_micros("timestamp").alias("us"), "ip", "user", F.col("extra.pid").alias("pid"), F.coalesce("extra.future_dated", F.lit(False)).alias("future"), "reason")


_SHAPES = ("'Failed password for invalid user u' || k || ' from ' || ip || ' port 1 ssh2'", "'Accepted password for v' || k || ' from ' || ip || ' port 2'", "'New session 9 of user w' || k || '.'", "'x' || k || ' : TTY=pts/0 ; COMMAND=/bin/ls'", "'Invalid user z from ' || ip", "'nothing here'")


def user_ip_extract(spark, sf_dir):
    """SRC-14, 15."""
    m = F.expr("CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END")
    return base(spark, sf_dir).withColumn("m", m).select("event_id", parsers.ip_of(F.col("m")).alias("ip"), parsers.user_of(F.col("m")).alias("user"))


def redact_documents(spark, sf_dir):
    """STR-6, EVD-1."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(redact(F.col("text")).cast("binary")).alias("md5"))


#: Ends of encoded texts that stay as they are: a plus sign and malformed escapes (fixed values of the query).
UNDECODED = "+%zz%2"


def unquote_documents(spark, sf_dir):
    """STR-5: percent-encoded texts decoded again."""
    coded = F.concat(F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")), F.lit(UNDECODED))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(unquote(coded).cast("binary")).alias("md5"))


#: Files that the lines of numbered_lines are dealt to.
FILES = 64


def numbered_lines(spark, sf_dir):
    """SRC-1, 2: access lines written to files, each cut at a vertical tab where its number allows, and read in blocks."""
    lines = access_lines(spark, sf_dir).select(F.concat("value", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("\x0bmore "), "line_no")).otherwise("")).alias("value"), "line_no", (F.col("line_no") % FILES).alias("part"))
    folder = f"{shared_folder(spark, 'lines')}/{uuid.uuid4().hex}"
    dealt = lines.withColumn("value", F.replace("value", F.lit("\r\n"), F.lit(""))).repartition("part").sortWithinPartitions("part", "line_no")
    dealt.select("part", "value").write.partitionBy("part").option("lineSep", "\r\n").text(folder)
    files = text.listed(spark, [f"{folder}/*"])
    got = text.blocks(spark, list(enumerate(files)))
    return got.select(F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("long").alias("part"), "line_no", F.md5(F.col("value").cast("binary")).alias("md5"))


_ATTACK = "CASE WHEN event_id % 11 = 0 THEN '/../etc' WHEN event_id % 11 = 1 THEN '/%2e%2e/x' WHEN event_id % 11 = 2 THEN '/%25252e' ELSE '/ok' || k END"


def pattern_hits_by_ip(spark, sf_dir):
    """FLT-8, AGG-2."""
    e = as_events(spark, sf_dir, path=F.expr(_ATTACK))
    return _shape(detectors.build(e, rule("path-traversal", "web", patterns=[r"\.\./", r"%2e%2e", r"%252e"])))


def sudo_by_user(spark, sf_dir):
    """AGG-3, FLT-9."""
    got = detectors.build(as_events(spark, sf_dir), rule("sudo-sensitive-command", "auth", sensitive_patterns=["/etc/shadow"]))
    return _shape(got).drop("ip")


def correlate_findings(spark, sf_dir):
    """JOIN-1, 2, AGG-4, 5, WIN-7."""
    return correlations(spark, sf_dir).select("ip", F.array_join("correlated_rule_ids", ",").alias("rules"), F.col("count").alias("n"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def severity_rollup(spark, sf_dir):
    """AGG-6, FLT-10 to 12: findings by severity, of those at medium and above; whether any is high."""
    got = at_least(findings(spark, sf_dir), "medium").groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("count").alias("events"))
    return got.withColumn("fails", F.col("severity").isin("HIGH", "CRITICAL"))


def report_order(spark, sf_dir):
    """ORD-3: place of each finding in the report."""
    from pyspark.sql import Window

    got = findings(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity_rank"), "first_seen", "rule_ord", "emit")).cast("long"))
    return got.select("place", "rule_id", "ip", iso(F.col("first_seen")).alias("first_seen"))


def export_csv_rows(spark, sf_dir):
    """SNK-1, 3: the CSV fields of one rule's findings."""
    got = export.csv_columns(detectors.build(as_events(spark, sf_dir), RULES["brute_force"]))
    return got.select("rule_id", "severity", "title", "description", "ip", "first_seen", "last_seen", "count", "users", "evidence")


def sarif_rules(spark, sf_dir):
    """SNK-4, AGG-7, STR-8."""
    return export.sarif_rules(findings(spark, sf_dir))


def sarif_results(spark, sf_dir):
    """SNK-4: the results of a document, read back from their text."""
    part = lambda path: F.get_json_object("text", f"$.{path}")
    got = export.sarif_results(detectors.build(as_events(spark, sf_dir), RULES["brute_force"]))
    lines = F.from_json(part("locations"), "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>")
    return got.select(part("ruleId").alias("rule"), part("level").alias("level"), part("message.text").alias("message"), F.array_join(F.transform(lines, lambda x: F.concat(x["physicalLocation"]["artifactLocation"]["uri"], F.lit(":"), x["physicalLocation"]["region"]["startLine"].cast("string"))), ";").alias("lines"))


def dedup_correlations(spark, sf_dir):
    """SET-2: correlations not reported yet; even addresses have been."""
    found = correlations(spark, sf_dir)
    seen = found.where(F.substring_index("ip", ".", -1).cast("int") % 2 == 0)
    return new_correlations(found, seen).select("ip", F.array_join("correlated_rule_ids", ",").alias("rules"))


def evidence_lines(spark, sf_dir):
    """EVD-1, UID-1: the evidence of each finding of one rule, line by line, under an id that no two findings share."""
    found = detectors.build(as_events(spark, sf_dir), RULES["brute_force"])
    ids = found.groupBy("finding_id").agg(F.count(F.lit(1)).alias("_same"))
    rows = found.join(ids, "finding_id").select("ip", "_same", F.explode("evidence").alias("e"))
    return rows.select("ip", F.col("e.line_no").alias("line_no"), F.col("e.excerpt").alias("excerpt"), F.col("_same").alias("findings_of_the_id"))


def evidence_table(spark, sf_dir):
    """EVD-1, AGG-2 to AGG-4: the evidence of all findings and of their correlations, as a table beside them."""
    config = AppConfig(1, DAY, AlertConfig(), (*(RULES[k] for k in JOINED), CORRELATION))
    found, rows, _ = detect_apart(as_events(spark, sf_dir), config)
    got = found.select("finding_id", "rule_id", "ip").join(rows, "finding_id")
    return got.select("rule_id", "ip", "part", F.col("place.line_no").alias("line_no"), "excerpt")


def sniff_choice(spark, sf_dir):
    """SRC-5: the format that each file's scores choose."""
    named = [(r.file_ord, p.name if (p := parsers.choose(r.asDict())) else None) for r in sniff_scores(spark, sf_dir).collect()]  # a row a file
    return spark.createDataFrame(named, "file_ord int, format string")


def exit_codes(spark, sf_dir):
    """FLT-12: by least severity shown, the exit code of a run that shows the findings at or above it."""
    found = findings(spark, sf_dir)
    return spark.createDataFrame([(s, exit_code(at_least(found, s))) for s in ("low", "medium", "high", "critical")], "shown string, code int")


def redact_twice(spark, sf_dir):
    """STR-6: documents that the first redaction changes, and those that a second one would change again (see ``redact``)."""
    once = redact(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.when(redact(once) != once, 1)).alias("twice"), F.count(F.when(once != F.col("text"), 1)).alias("once"))


def loud_first(spark, sf_dir):
    """FLT-11, TOPK-1: findings at or above an alert's severity, and the three that come first."""
    from pyspark.sql import Window

    first = loud(findings(spark, sf_dir), "high").limit(3)
    place = F.row_number().over(Window.orderBy("rule_ord", "emit", "ip"))  # three rows
    return first.withColumn("place", place.cast("long")).select("place", "rule_id", "ip", F.col("count").alias("n"))


QUERIES = {
    **{k: _detector(k) for k in RULES},
    "brute_force_ties": _detector("brute_force", "hour"), "user_enum_ties": _detector("user_enum_distinct", "hour"), "rapid_success_ties": _detector("rapid_success", "hour"),
    **{f.__name__: f for f in (parse_access_log, parse_failures, sniff_scores, syslog_year_inference, user_ip_extract, redact_documents, unquote_documents, numbered_lines, pattern_hits_by_ip, sudo_by_user, correlate_findings, severity_rollup, report_order, export_csv_rows, sarif_rules, sarif_results, dedup_correlations, evidence_lines, evidence_table, sniff_choice, exit_codes, redact_twice, loud_first)},
}


def _redacted(text: str) -> str:
    for pattern, flags, new in REDACTIONS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'g{flags}')"
    return text


ORACLES = {
    "brute_force": f"WITH {_SECOND}, {_BF} {_out('bf', 30)}",
    "brute_force_ties": f"WITH {_HOUR}, {_BF} {_out('bf', 30)}",
    "rate_limit": f"WITH {_SECOND}, {_RL} {_out('rl', 20)}",
    "scanner_distinct": f"WITH {_SECOND}, {_SC} {_out('sc', 20)}",
    "user_enum_distinct": f"WITH {_SECOND}, {_UE} {_out('ue', 10, True)}",
    "user_enum_ties": f"WITH {_HOUR}, {_UE} {_out('ue', 10, True)}",
    "brute_force_success": f"WITH {_SECOND}, {_SUCCESS} {_out('bs', 40)}",
    "rapid_success": f"WITH {_SECOND}, {_RAPID} {_out('rs', 30)}",
    "rapid_success_ties": f"WITH {_HOUR}, {_RAPID} {_out('rs', 30)}",
    "parse_access_log": f"""WITH {_SECOND} SELECT event_id AS line_no, us, ip, CAST(NULL AS VARCHAR) AS "user", 'GET' AS method, '/' || event_type || '?k=' || k AS path, {STATUS} AS status,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS size, 'HTTP/1.1' AS protocol, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '-' END AS referer, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'agent x' END AS agent FROM ev""",
    "parse_failures": """SELECT CASE event_id % 97 WHEN 0 THEN 'does not match Apache access-log format' WHEN 1 THEN 'empty line' ELSE 'invalid or missing Apache timestamp' END AS reason, count(*) AS n FROM events WHERE event_id % 97 < 4 GROUP BY 1""",
    "sniff_scores": """WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT * FROM l WHERE i <= 20 AND (event_id % 3 = 0 OR event_id % 7 <> 0))
SELECT CAST(user_id AS INTEGER) AS file_ord, round(avg(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END), 9) AS apache, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS syslog FROM s GROUP BY user_id""",
    "syslog_year_inference": f"""WITH {_SECOND}, r AS (SELECT min(t) + INTERVAL 2 DAY AS ref FROM ev), l AS (SELECT event_id, ip, CASE WHEN event_id % 4 = 0 THEN t + INTERVAL 120 DAY ELSE t END AS t FROM ev),
y AS (SELECT *, year(ref) - CASE WHEN month(t) > month(ref) + 1 THEN 1 ELSE 0 END AS yy FROM l, r),
z AS (SELECT *, CASE WHEN month(t) = 2 AND day(t) = 29 AND NOT (yy % 4 = 0 AND (yy % 100 <> 0 OR yy % 400 = 0)) THEN yy - yy % 4 ELSE yy END AS y2 FROM y),
w AS (SELECT *, make_timestamp(y2, month(t), day(t), hour(t), minute(t), second(t)) AS m FROM z)
SELECT event_id AS line_no, epoch_us(m) AS us, ip, 'root' AS "user", event_id AS pid, m > ref + INTERVAL 1 DAY AS future, CAST(NULL AS VARCHAR) AS reason FROM w""",
    "user_ip_extract": f"""WITH {_SECOND} SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 4) THEN ip END AS ip, CASE event_id % 6 WHEN 0 THEN 'u' || k WHEN 1 THEN 'v' || k WHEN 2 THEN 'w' || k || '.' WHEN 3 THEN 'x' || k WHEN 4 THEN 'z' END AS "user" FROM ev""",
    "redact_documents": f"SELECT doc_id, md5({_redacted('text')}) AS md5 FROM documents",
    "unquote_documents": f"SELECT doc_id, md5(text || '{UNDECODED}') AS md5 FROM documents",
    "numbered_lines": f"""WITH {_SECOND}, v AS (SELECT event_id, event_id % {FILES} AS part, ip || ' - - [' || strftime(t, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || '?k=' || k || ' HTTP/1.1" ' || {STATUS} || ' '
  || CASE WHEN event_id % 5 = 0 THEN '-' ELSE event_id::VARCHAR END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' "-" "agent x"' END AS value FROM ev),
p AS (SELECT part, event_id, 0 AS i, value FROM v UNION ALL SELECT part, event_id, 1, 'more ' || event_id FROM v WHERE event_id % 5 = 0)
SELECT part, row_number() OVER (PARTITION BY part ORDER BY event_id, i) AS line_no, md5(value) AS md5 FROM p""",
    "pattern_hits_by_ip": f"WITH {_SECOND} SELECT ip, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(*) AS n_evidence, '' AS users, 30 AS severity_rank FROM ev WHERE event_id % 11 < 3 GROUP BY ip",
    "sudo_by_user": f"""WITH {_SECOND}, h AS (SELECT *, CASE WHEN event_type = 'click' THEN 'u' || (user_id % 7) ELSE 'unknown' END AS u FROM ev WHERE event_type IN ('click', 'purchase') AND k % 2 = 0)
SELECT count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(*) AS n_evidence, u AS users, 30 AS severity_rank FROM h GROUP BY u""",
    "correlate_findings": f"WITH {_CORR} SELECT ip, rules, n, first_us, last_us FROM co",
    "severity_rollup": f"WITH {_ALL} SELECT CASE severity_rank WHEN 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS findings, sum(n)::BIGINT AS events, severity_rank = 30 AS fails FROM fi WHERE severity_rank >= 20 GROUP BY severity_rank",
    "report_order": f"WITH {_ALL} SELECT row_number() OVER (ORDER BY severity_rank DESC, first_us, ord, fire_us, fire_id) AS place, rule_id, ip, strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_seen FROM fi",
    "export_csv_rows": f"""WITH {_SECOND}, {_BF} SELECT 'brute-force' AS rule_id, 'HIGH' AS severity, 'Brute-force attempt from ' || h.ip AS title, h.n || ' authentication failures from ' || h.ip || ' within 86400s (threshold 3).' AS description, h.ip AS ip,
  strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_seen, strftime(make_timestamp(last_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_seen, h.n AS count, '' AS users,
  (SELECT string_agg('events:' || w.event_id, ';' ORDER BY w.rn) FROM bf_w w JOIN bf_f f ON f.ip = w.ip WHERE w.ip = h.ip AND w.rn BETWEEN f.rn - f.n + 1 AND f.rn) AS evidence FROM bf_h h""",
    "sarif_results": f"""WITH {_SECOND}, {_BF} SELECT 'brute-force' AS rule, 'error' AS level, h.n || ' authentication failures from ' || h.ip || ' within 86400s (threshold 3).' AS message,
  (SELECT string_agg('events:' || greatest(w.event_id, 1), ';' ORDER BY w.rn) FROM bf_w w JOIN bf_f f ON f.ip = w.ip WHERE w.ip = h.ip AND w.rn BETWEEN f.rn - f.n + 1 AND f.rn) AS lines FROM bf_h h""",
    "sarif_rules": f"""WITH {_ALL} SELECT DISTINCT rule_id AS id, CASE rule_id WHEN 'brute-force' THEN 'Brute Force' WHEN 'rate-limit-abuse' THEN 'Rate Limit Abuse' WHEN 'ssh-invalid-user-enum' THEN 'Ssh Invalid User Enum' ELSE 'Rapid Success After Failures' END AS name,
  CASE severity_rank WHEN 30 THEN 'error' WHEN 20 THEN 'warning' ELSE 'note' END AS level FROM fi""",
    "dedup_correlations": f"WITH {_CORR} SELECT ip, rules FROM co WHERE CAST(string_split(ip, '.')[4] AS INTEGER) % 2 = 1",
    "evidence_lines": f"""WITH {_SECOND}, {_BF} SELECT w.ip, w.event_id AS line_no, w.event_id || ' ' || w.event_type || ' ' || w.ip AS excerpt, 1::BIGINT AS findings_of_the_id
  FROM bf_w w JOIN bf_f f ON f.ip = w.ip AND w.rn BETWEEN f.rn - f.n + 1 AND f.rn""",
    "evidence_table": f"""WITH {_EVIDENCE}, al AS (SELECT rule_id, ip, 0 AS part, event_id, event_type FROM pr
  UNION ALL SELECT 'multi-vector-correlation', me.ip, me.part, pr.event_id, pr.event_type FROM me JOIN pr ON pr.ip = me.ip AND pr.rule_id = me.rule_id AND pr.fire_id = me.fire_id)
SELECT rule_id, ip, part, event_id AS line_no, event_id || ' ' || event_type || ' ' || ip AS excerpt FROM al""",
    "exit_codes": f"WITH {_ALL} SELECT shown, CAST(coalesce(max(CASE WHEN severity_rank >= 30 THEN 1 END), 0) AS INTEGER) AS code FROM (VALUES ('low', 10), ('medium', 20), ('high', 30), ('critical', 40)) AS s(shown, least) LEFT JOIN fi ON severity_rank >= least GROUP BY shown",
    "redact_twice": f"SELECT count(*) FILTER (WHERE {_redacted('once')} <> once) AS twice, count(*) FILTER (WHERE once <> text) AS once FROM (SELECT text, {_redacted('text')} AS once FROM documents)",
    "loud_first": f"WITH {_ALL} SELECT place, rule_id, ip, n FROM (SELECT row_number() OVER (ORDER BY ord, fire_us, fire_id, ip) AS place, * FROM fi WHERE severity_rank >= 30) WHERE place <= 3",
}
ORACLES["sniff_choice"] = f"SELECT file_ord, CASE WHEN greatest(apache, syslog) < {parsers.SNIFF_SHARE} THEN NULL WHEN syslog > apache THEN 'syslog' ELSE 'apache' END AS format FROM ({ORACLES['sniff_scores']})"
