"""Correlation: findings of one ip, from different rules and sources, within one window.

Rules report an ip once (streaks aside), so an ip's findings are few; all windows and the groups share one exchange by ip, and
the findings are computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RuleConfig
from .detectors import finish


def correlate(findings: DataFrame, rule: RuleConfig, sources: dict[str, str | None], ordinal: int, *more: str) -> DataFrame:
    """At most one finding for each ip: of the earliest anchor whose forward window holds enough rules and sources. more:
    columns beside those of findings, as ``members``, the ids of the findings that it joins, in order."""
    least, span = rule.params.get("min_distinct_rules", 2), rule.window_seconds * 1_000_000
    order = ["first_seen", "rule_ord", "emit"]
    known = {k: v for k, v in sources.items() if v}
    source = F.coalesce(*(F.when(F.col("rule_id") == k, v) for k, v in known.items())) if known else F.lit(None).cast("string")
    by_ip = Window.partitionBy("ip")
    f = findings.where("ip IS NOT NULL").withColumn("_us", F.unix_micros("first_seen")).withColumn("_source", source).withColumn("_i", F.row_number().over(Window.partitionBy("ip").orderBy(*order)))
    ahead = Window.partitionBy("ip").orderBy("_us").rangeBetween(0, span)
    near = F.filter(F.collect_list(F.struct("_i", "rule_id", "_source")).over(ahead), lambda x: x["_i"] >= F.col("_i"))
    rules = F.size(F.array_distinct(F.transform(near, lambda x: x["rule_id"])))
    enough = rules >= least
    if rule.params.get("require_distinct_sources", True):
        enough = enough & (F.size(F.array_distinct(F.filter(F.transform(near, lambda x: x["_source"]), lambda s: s.isNotNull()))) >= 2)
    # reports follow the place of each ip's first finding: by rule, then by time
    f = f.withColumn("_a", F.min(F.when(enough, F.struct("_i", "_us"))).over(by_ip)).withColumn("_first", F.min(F.struct("rule_ord", "emit")).over(by_ip))
    group = f.where((F.col("_i") >= F.col("_a._i")) & (F.col("_us") <= F.col("_a._us") + span))
    members = F.array_sort(F.collect_list(F.struct("_i", "evidence", "users", "rule_id", "finding_id")))
    got = group.groupBy("ip").agg(members.alias("_m"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"), F.min("_first").alias("_first"))
    ids = F.array_sort(F.array_distinct(F.transform("_m", lambda x: x["rule_id"])))
    got = got.withColumns({
        "correlated_rule_ids": ids, "users": F.array_sort(F.array_distinct(F.flatten(F.transform("_m", lambda x: x["users"])))), "evidence": F.flatten(F.transform("_m", lambda x: x["evidence"])),
        "members": F.transform("_m", lambda x: x["finding_id"]), "title": F.concat(F.lit("Multi-vector attack correlated on "), "ip"),
        "description": F.concat(F.col("ip"), F.lit(" triggered "), F.size(ids).cast("string"), F.lit(" distinct rules ("), F.array_join(ids, ", "), F.lit(") across multiple log sources within one window — likely a single coordinated attack.")),
    })
    place = F.struct((F.col("_first.rule_ord") * F.lit(10**17) + F.col("_first.emit.us")).alias("us"), "_first.emit.source_rank", "_first.emit.file_ord", "_first.emit.line_no")
    got = got.withColumn("emit", place)
    return finish(got, rule, ordinal, *more)


def new_correlations(found: DataFrame, reported: DataFrame) -> DataFrame:
    """Those whose (ip, set of rules) has not been reported before."""
    seen = reported.select(F.col("ip").alias("_ip"), F.col("correlated_rule_ids").alias("_ids")).distinct()
    return found.join(seen, (found["ip"] == seen["_ip"]) & (found["correlated_rule_ids"] == seen["_ids"]), "left_anti")
