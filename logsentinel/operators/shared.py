"""All rules of this package's types in one pass: events are tagged once with the rules they matter to, the rules' windows
share one exchange, and findings are put together for all rules at once, so the plan doesn't grow with the rule file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import RuleConfig
from ..schema import EVIDENCE, order_of, severity_rank
from . import detectors as d
from .windows import streaks, trailing

Rules = list[tuple[int, RuleConfig]]


def by_rule(rules: Rules, fn: Callable[[RuleConfig], Column]) -> Column:
    """A column that depends on which rule a row is of."""
    out = F.when(F.col("rule") == rules[0][0], fn(rules[0][1]))
    for i, r in rules[1:]:
        out = out.when(F.col("rule") == i, fn(r))
    return out


def of_kind(rules: Rules, *kinds: str) -> Rules:
    return [(i, r) for i, r in rules if d.KINDS[r.type] in kinds]


def is_of(rules: Rules) -> Column:
    return F.col("rule").isin(*(i for i, _ in rules))


def tagged(events: DataFrame, rules: Rules) -> DataFrame:
    """A row for each event and rule that it matters to, with its key (ip or user) and what it counts as. Most events matter to
    none and are dropped here."""
    notes = []
    for i, r in rules:
        counts, succeeds, value = d.mark(r)
        key = value if r.type in d.BY_USER else F.col("ip")
        notes.append(F.when((counts | succeeds) & key.isNotNull(), F.struct(F.lit(i).alias("rule"), key.alias("key"), counts.alias("counts"), value.alias("value"))))
    noted = F.explode(F.filter(F.array(*notes), lambda x: x.isNotNull())).alias("_note")
    return events.select(order_of().alias("_o"), "file", "line_no", "timestamp", "raw", "message", noted).select("_note.*", "_o", "file", "line_no", "timestamp", "raw", "message")


_KEY = ["rule", "key"]


#: What a finding's rows are folded by: a streak is one of several of its key, all other findings are one a key.
_ONE = [*_KEY, "_streak"]


def _window_rows(tags: DataFrame, rules: Rules) -> DataFrame:
    """The rows of the window that ends at the first row at which a key of a rule has enough in it."""
    rows = tags.where(is_of(rules))
    span, enough = by_rule(rules, lambda r: F.lit(r.window_seconds * 1_000_000)), by_rule(rules, lambda r: F.lit(d.threshold_of(r)))
    distinct, success = of_kind(rules, "distinct"), of_kind(rules, "success")
    n = F.when(is_of(distinct), F.col("_m")).otherwise(F.col("_n")) if distinct else F.col("_n")
    takes = F.when(is_of(success), ~F.col("counts")).otherwise(F.col("counts")) if success else F.col("counts")
    w = trailing(rows.select(*_KEY, "counts", "value", "_o"), span, bool(distinct))
    fires = w.where(takes & (n >= enough)).groupBy(*_KEY).agg(F.min(F.struct("_o", "_span")).alias("_f"))
    fires = fires.select(*_KEY, F.col("_f._o").alias("emit"), (F.col("_f._o.us") - F.col("_f._span")).alias("_since"))
    inside = rows.join(fires, _KEY).where((F.col("_o") <= F.col("emit")) & (F.col("_o.us") >= F.col("_since")) & (F.col("counts") | (F.col("_o") == F.col("emit"))))
    return inside.withColumns({"_streak": F.lit(0).cast("long"), "_wait": F.lit(None).cast("double")})


def _streak_rows(tags: DataFrame, rules: Rules) -> DataFrame:
    """The rows of streaks that are long enough and that a success ends in time; only of these are rows gathered."""
    rows = streaks(tags.where(is_of(rules)))
    sums = rows.groupBy(*_ONE).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(~F.col("counts"), F.col("_o"))).alias("emit"), F.max(F.when(F.col("counts"), F.col("_o.us"))).alias("_last"))
    least, gap = by_rule(rules, lambda r: F.lit(max(1, r.params.get("min_failures", 3)))), by_rule(rules, lambda r: F.lit(r.params.get("max_gap_seconds", 30)))
    ends = sums.withColumn("_wait", (F.col("emit.us") - F.col("_last")) / 1e6).where((F.col("_n") > least) & F.col("_wait").between(0, gap))
    return rows.join(ends.drop("_n", "_last"), _ONE).withColumn("value", F.lit(None).cast("string"))


def _all_rows(tags: DataFrame, rules: Rules) -> DataFrame:
    """Every hit of a key."""
    return tags.where(is_of(rules)).withColumns({"_streak": F.lit(0).cast("long"), "emit": F.col("_o"), "_wait": F.lit(None).cast("double"), "value": F.lit(None).cast("string")})


def _placed(got: DataFrame, events: DataFrame, rules: Rules) -> DataFrame:
    """An ip's place in the report is its first appearance among all events of the rule's source."""
    by_ip = [(i, r) for i, r in rules if r.type not in d.BY_USER]
    if not by_ip:
        return got
    sources = sorted({r.source or "" for _, r in by_ip})
    first = [F.min(order_of() if not s else F.when(F.col("source") == s, order_of())).alias(f"_at_{s}") for s in sources]
    seen = events.where("ip IS NOT NULL").groupBy(F.col("ip").alias("_ip")).agg(*first)
    at = by_rule(by_ip, lambda r: F.col(f"_at_{r.source or ''}"))
    return got.join(seen, (F.col("key") == F.col("_ip")) & is_of(by_ip), "left").withColumn("emit", F.coalesce(at, "emit")).drop("_ip", *(f"_at_{s}" for s in sources))


def _folded(rows: DataFrame, lists: bool) -> DataFrame:
    """A row a finding: with all its rows as a list, or only with their number and the first and last time."""
    sums = [F.array_sort(F.collect_list(d._proof())).alias("_hits")] if lists else [F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("count")]
    values = F.array_sort(F.collect_set(F.when(F.col("value") != "", F.col("value")))).alias("_values")
    return rows.groupBy(*_ONE).agg(*sums, F.min("emit").alias("emit"), F.max("_wait").alias("_wait"), values)


def described(hits: DataFrame, rules: Rules, *more: str) -> DataFrame:
    """Findings of (rule, key, _hits or what from_list makes of them, emit, _values, _wait), and more columns of these."""
    user = [(i, r) for i, r in rules if r.type in d.BY_USER]
    found = hits.withColumns({"_user": F.col("key"), "ip": F.when(is_of(user), None).otherwise(F.col("key")) if user else F.col("key")})
    if "_hits" in found.columns:
        found = d.from_list(found)
    said = {i: d.SAYS[r.type](r) for i, r in rules}
    pick = lambda name: reduce(lambda out, i: out.when(F.col("rule") == i, said[i][name]), list(said)[1:], F.when(F.col("rule") == next(iter(said)), next(iter(said.values()))[name]))
    return d.shaped(found.withColumns({
        **{name: pick(name) for name in ("users", "title", "description")}, "rule_id": by_rule(rules, lambda r: F.lit(r.id)), "severity": by_rule(rules, lambda r: F.lit(r.severity.upper())),
        "severity_rank": by_rule(rules, lambda r: F.lit(severity_rank(r.severity))), "rule_ord": F.col("rule"),
    }), *more)


def _parts(tags: DataFrame, rules: Rules) -> list[tuple[Rules, DataFrame]]:
    """The rows of findings by kind, each with its finding's emit and _wait."""
    kinds = [(("count", "distinct", "success"), _window_rows), (("streak",), _streak_rows), (("all",), _all_rows)]
    return [(own, rows(tags, own)) for names, rows in kinds if (own := of_kind(rules, *names))]


def _hits(parts: list[tuple[Rules, DataFrame]], events: DataFrame, lists: bool) -> DataFrame:
    out = []
    for own, rows in parts:
        got = _folded(rows, lists)
        out.append(_placed(got, events, own) if of_kind(own, "all") else got)
    return reduce(DataFrame.unionByName, out)


def detect(events: DataFrame, rules: Rules, keep: bool = False) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Findings of all rules, each with its evidence as a list, and what is kept for them if so asked: the tagged rows, which
    each kind reads twice."""
    tags = tagged(events, rules)
    if keep:
        tags = tags.persist(StorageLevel.MEMORY_AND_DISK)
    return described(_hits(_parts(tags, rules), events, True), rules), (tags,) if keep else ()


def detect_apart(events: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Findings of all rules without evidence, their evidence as a table, and what is kept for them. No row grows with the hits of
    a key: findings are sums with partial aggregates, and evidence stays rows of (finding_id, part, place, file, line_no, excerpt)."""
    tags = tagged(events, rules).persist(StorageLevel.MEMORY_AND_DISK)
    # findings, evidence and the evidence of correlations read these rows: without it each would run all windows again
    parts = [(own, p.persist(StorageLevel.MEMORY_AND_DISK)) for own, p in _parts(tags, rules)]
    none = {"evidence": F.array().cast(f"array<{EVIDENCE}>"), "correlated_rule_ids": F.array().cast("array<string>")}
    found = described(_hits(parts, events, False).withColumns(none), rules, *_ONE).persist(StorageLevel.MEMORY_AND_DISK)
    rows = reduce(DataFrame.unionByName, [p.select(*_ONE, d._proof().alias("_p")) for _, p in parts])
    proof = rows.join(found.select("finding_id", *_ONE), _ONE).select("finding_id", F.lit(0).alias("part"), F.col("_p._o").alias("place"), "_p.e.*")
    return found.drop(*_ONE), proof, (tags, *(p for _, p in parts), found)
