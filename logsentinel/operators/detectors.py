"""What the rule types look for, how their findings read, and the registry of detectors of one's own.

The types of this package run in one pass over the events (``shared``). Findings carry ``emit``, the place in the total
order at which the rule reports them, and ``rule_ord``. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_match, any_prefix, excerpt, unquote
from ..rules import OWN_TYPES, RULE_TYPES, RuleConfig
from ..schema import EVIDENCE, FINDING, order_of, severity_rank

# Markers and defaults (fixed values).
FAILED, ACCEPTED, INVALID_USER = "Failed password", "Accepted password", "invalid user"
FAILURE_STATUSES, SUCCESS_STATUSES, SCANNER_STATUSES, RATE_STATUSES = [401, 403], [200, 302], [403, 404], [429]

Detector = Callable[[DataFrame, RuleConfig], DataFrame]
REGISTRY: dict[str, Detector] = {}


def detector(*types: str) -> Callable[[Detector], Detector]:
    """Register a detector for rule types; so may code outside this package, and rule files may then name its types. Its
    findings need ip, users, title, description, emit and the columns of from_list. A stream needs ``streaming.detector.
    follows`` for the type too."""

    def add(fn: Detector) -> Detector:
        REGISTRY.update(dict.fromkeys(types, fn))
        OWN_TYPES.update(set(types) - set(RULE_TYPES))
        return fn

    return add


def build(events: DataFrame, rule: RuleConfig, ordinal: int = 0) -> DataFrame:
    """Findings of one rule over the events of its source."""
    from . import shared

    if rule.type in KINDS:
        return shared.detect(events, [(ordinal, rule)])[0]
    if rule.source:
        events = events.where(F.col("source") == rule.source)
    found = REGISTRY[rule.type](events.withColumn("_o", order_of()), rule)
    return finish(found, rule, ordinal)


def finish(found: DataFrame, rule: RuleConfig, ordinal: int, *more: str) -> DataFrame:
    name = rule.severity
    return shaped(found.withColumns({"rule_id": F.lit(rule.id), "severity": F.lit(name.upper()), "severity_rank": F.lit(severity_rank(name)), "rule_ord": F.lit(ordinal)}), *more)


def shaped(found: DataFrame, *more: str) -> DataFrame:
    """The columns of findings, with their ids, of those that say which rule they are of; and more of their columns."""
    named = F.concat_ws("|", "rule_id", F.coalesce("ip", F.element_at("users", 1), F.lit("")), F.unix_micros("first_seen").cast("string"), F.to_json("emit"))
    found = found.withColumn("finding_id", F.md5(named.cast("binary")))
    kinds = {f.name: f.dataType for f in FINDING}
    return found.select(*(F.col(c).cast(kinds[c]).alias(c) for c in FINDING.names), *more)


def in_statuses(status: Column, allowed: list[int]) -> Column:
    return F.coalesce(status.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def says(marker: str) -> Column:
    return F.coalesce(F.col("message").contains(marker), F.lit(False))


def failure(rule: RuleConfig) -> Column:
    web = in_statuses(F.col("status"), rule.params.get("statuses", FAILURE_STATUSES)) & any_prefix(F.col("path"), rule.params.get("match_paths", []))
    return F.when(F.col("source") == "web", web).otherwise(says(FAILED))


def success(rule: RuleConfig) -> Column:
    return F.when(F.col("source") == "web", in_statuses(F.col("status"), rule.params.get("success_statuses", SUCCESS_STATUSES))).otherwise(says(ACCEPTED))


def _proof() -> Column:
    """An event as a list entry that sorts in the total order and holds its timestamp and evidence."""
    return F.struct("_o", F.col("timestamp").alias("ts"), F.struct("file", "line_no", excerpt(F.col("raw"), F.col("message")).alias("excerpt")).alias("e"))


def from_list(grouped: DataFrame) -> DataFrame:
    """first_seen, last_seen, count and evidence of the sorted list _hits."""
    return grouped.withColumns({
        "first_seen": F.element_at("_hits", 1)["ts"], "last_seen": F.element_at("_hits", -1)["ts"], "count": F.size("_hits").cast("long"),
        "evidence": F.transform("_hits", lambda x: x["e"]).cast(f"array<{EVIDENCE}>"), "correlated_rule_ids": F.array().cast("array<string>"),
    })


def pattern_hit(rule: RuleConfig) -> Column:
    patterns = rule.params.get("patterns", [])
    return any_match(F.col("path"), patterns) | any_match(unquote(F.col("path")), patterns)


def sudo_hit(rule: RuleConfig) -> Column:
    return F.coalesce(F.col("extra.program") == "sudo", F.lit(False)) & any_match(F.coalesce("message", F.lit("")), rule.params.get("sensitive_patterns", []))


def who() -> Column:
    return F.coalesce(F.when(F.col("user") != "", F.col("user")), F.lit("unknown"))


#: How each type of this package decides: by counting a window's rows or different values, by a success after the counted
#: rows of a window, by streaks that a success ends, or by every hit.
KINDS = {"brute-force": "count", "rate-limit-abuse": "count", "scanner-burst": "distinct", "ssh-invalid-user-enum": "distinct", "brute-force-success": "success", "rapid-success-after-failures": "streak", "path-traversal": "all", "sqli-probe": "all", "sudo-sensitive-command": "all"}
#: Of the window kinds, where a rule gives none (fixed values).
THRESHOLDS = {"brute-force": 5, "brute-force-success": 5, "rate-limit-abuse": 5, "scanner-burst": 6, "ssh-invalid-user-enum": 4}
BY_USER = ("sudo-sensitive-command",)


def threshold_of(rule: RuleConfig) -> int:
    return rule.params.get("threshold", THRESHOLDS.get(rule.type, 5))


def mark(rule: RuleConfig) -> tuple[Column, Column, Column]:
    """(counts, succeeds, value) of an event under a rule of this package's types; a row that is both only counts."""
    no, none, p = F.lit(False), F.lit(None).cast("string"), rule.params
    counts, succeeds, value = {
        "brute-force": lambda: (failure(rule), no, none),
        "brute-force-success": lambda: (failure(rule), success(rule), none),
        "rate-limit-abuse": lambda: (in_statuses(F.col("status"), p.get("statuses", RATE_STATUSES)), no, none),
        "scanner-burst": lambda: (in_statuses(F.col("status"), p.get("statuses", SCANNER_STATUSES)) & any_prefix(F.col("path"), p.get("probe_paths", [])), no, F.col("path")),
        "ssh-invalid-user-enum": lambda: (says(INVALID_USER), no, F.col("user")),
        "rapid-success-after-failures": lambda: (says(FAILED), says(ACCEPTED), none),
        "path-traversal": lambda: (pattern_hit(rule), no, none),
        "sqli-probe": lambda: (pattern_hit(rule), no, none),
        "sudo-sensitive-command": lambda: (sudo_hit(rule), no, who()),
    }[rule.type]()
    source = F.lit(True) if rule.source is None else F.col("source") == rule.source
    return source & counts, source & succeeds & ~counts, value


#: users, title and description of findings by type, from ip, count, _values, _wait and _user: part of the output format
#: (fixed values). DESCRIBE has the same as functions that add the columns; types of one's own register there.
SAYS: dict[str, Callable[[RuleConfig], dict[str, Column]]] = {}
DESCRIBE: dict[str, Callable[[DataFrame, RuleConfig], DataFrame]] = {}


def describes(kind: str):
    """Register what adds users, title and description to hits; batch and stream share it."""

    def add(fn):
        DESCRIBE[kind] = fn
        return fn

    return add


def _says(kind: str):
    def add(fn):
        SAYS[kind] = fn
        describes(kind)(lambda found, rule: found.withColumns(fn(rule)))
        return fn

    return add


def _text(title: str, *parts: Column | str, who: str = "ip", users: Column | None = None) -> dict[str, Column]:
    said = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return {"users": F.array().cast("array<string>") if users is None else users, "title": F.concat(F.lit(title), who), "description": said}


def _n(less: int = 0) -> Column:
    return (F.col("count") - less if less else F.col("count")).cast("string")


_says("brute-force")(lambda r: _text("Brute-force attempt from ", _n(), " authentication failures from ", F.col("ip"), f" within {r.window_seconds}s (threshold {threshold_of(r)})."))
_says("rate-limit-abuse")(lambda r: _text("Rate-limit abuse from ", _n(), " rate-limited (429) responses to ", F.col("ip"), f" within {r.window_seconds}s (threshold {threshold_of(r)})."))
_says("scanner-burst")(lambda r: _text("Scanner burst from ", F.col("ip"), " probed ", F.size("_values").cast("string"), f" distinct sensitive paths within {r.window_seconds}s (threshold {threshold_of(r)})."))
_says("ssh-invalid-user-enum")(lambda r: _text("SSH invalid-user enumeration from ", F.col("ip"), " attempted ", F.size("_values").cast("string"), f" distinct invalid usernames within {r.window_seconds}s (threshold {threshold_of(r)}).", users=F.col("_values")))
_says("brute-force-success")(lambda r: _text("Brute-force followed by successful login from ", _n(1), " authentication failures from ", F.col("ip"), " were followed by a successful login within the same window — the attack likely succeeded."))
_says("rapid-success-after-failures")(lambda r: _text("Rapid success after failures from ", "A login from ", F.col("ip"), " succeeded ", F.format_string("%.0f", F.col("_wait")), "s after ", _n(1), " consecutive failures."))
_says("path-traversal")(lambda r: _text("Path traversal attempt from ", _n(), " request(s) from ", F.col("ip"), " attempted directory traversal."))
_says("sqli-probe")(lambda r: _text("SQL injection probe from ", _n(), " request(s) from ", F.col("ip"), " matched a SQL-injection pattern."))
_says("sudo-sensitive-command")(lambda r: _text("Sensitive sudo command by ", F.col("_user"), " ran ", _n(), " sudo command(s) touching a sensitive path.", who="_user", users=F.array("_user")) | {"ip": F.lit(None).cast("string")})
