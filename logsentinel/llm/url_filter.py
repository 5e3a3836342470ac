"""URL filters: rules by longest fit, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (good or not) are shrunk from suffix to registered domain to host. At each level the counts of
a unit follow a beta-binomial around its parent's mean; the prior's strength is the method-of-moments estimate over
all units of that level. A host's verdict is its posterior bound: ``allow`` where the lower bound of the good share
is at least ``threshold``, else ``block``. Hosts without labels get their domain's prior, and so on up to the whole.

Counts are partial aggregates by host, so a host with a third of all pages is a few rows before any shuffle; the host
table is written once, the levels above it are read from there, and it is joined, not collected. The driver sees five numbers:
the whole's mean and the strengths. A suffix is the last label, or the last two where a country code follows a short label
of the kind under which names are registered (``SECOND_LEVELS``). Defined cases: a null url or one without ``://`` has empty host and path and
the verdict of the global prior; rows that repeat a page_id are judged alike; empty tables give no rows or, for the
outcomes, a flat prior; null outcomes are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Labels before a two-letter country code that make a suffix with it (fixed values), whatever the country.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a host of one label is its own domain."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.lit(k)))
    long = (n > 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVELS)
    return F.when(long, last(3)).otherwise(last(2)), F.when(long, last(2)).otherwise(last(1))


def _strength(units: DataFrame, good: str, n: str, mean: str) -> float:
    """The prior's strength over units with counts good of n around mean, by moments."""
    spread = F.col(n) * F.pow(F.col(good) / F.col(n) - F.col(mean), F.lit(2))
    noise = F.col(mean) * (1 - F.col(mean))
    got = units.where(F.col(n) > 0).agg(F.sum(spread).alias("s"), F.sum(noise).alias("v"), F.sum((F.col(n) - 1) * noise).alias("w")).first()
    rho = (got["s"] - got["v"]) / got["w"] if got["w"] else 0.0
    return 1 / min(0.9, max(0.001, rho)) - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, good (1, 0 or null), a row for each page. host, alpha, beta of the posterior for each host."""
    host = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("y"))
    domain, suffix = domain_parts(F.col("host"))
    host = staged(host.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    by_domain = staged(host.groupBy("suffix", "domain").agg(F.sum("n").alias("nd"), F.sum("y").alias("yd")), "domains")
    by_suffix = staged(by_domain.groupBy("suffix").agg(F.sum("nd").alias("ns"), F.sum("yd").alias("ys")), "suffixes")
    whole = by_suffix.agg(F.sum("ys").alias("y"), F.sum("ns").alias("n")).first()
    m0 = ((whole["y"] or 0) + 1) / ((whole["n"] or 0) + 2)
    by_suffix = by_suffix.withColumn("m0", F.lit(m0))
    k = _strength(by_suffix, "ys", "ns", "m0")
    by_domain = by_domain.join(by_suffix.select("suffix", ((F.col("ys") + k * F.col("m0")) / (F.col("ns") + k)).alias("ms")), "suffix")
    k = _strength(by_domain, "yd", "nd", "ms")
    host = host.join(by_domain.select("suffix", "domain", ((F.col("yd") + k * F.col("ms")) / (F.col("nd") + k)).alias("md")), ["suffix", "domain"])
    k = _strength(host, "y", "n", "md")
    return host.select("host", (F.col("y") + k * F.col("md")).alias("alpha"), (F.col("n") - F.col("y") + k * (1 - F.col("md"))).alias("beta"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, posterior_bound for every row of pages. outcomes: page_id, good."""
    host, path = url_parts(F.col(url_col).cast("string"))
    page = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    votes = outcomes.select(F.col("page_id").alias("_page"), F.col("good").cast("long").alias("_good"))
    labelled = page.join(votes, page["page_id"] == votes["_page"], "left").select("host", F.col("_good").alias("good"))
    score = reputation(labelled).withColumnRenamed("host", "_host")
    a, b = F.col("alpha"), F.col("beta")
    bound = a / (a + b) - F.lit(z) * F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))
    score = score.select("_host", bound.alias("posterior_bound"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("posterior_bound") >= threshold, "allow").otherwise("block")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return page.join(score, page["host"] == score["_host"]).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "posterior_bound")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
page AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, try_cast(regexp_extract(url, '://[^/?#]*/[a-z]{2}/([0-9]+)', 1) AS BIGINT) AS doc FROM parts),
lab AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
votes AS (SELECT page_id, max(good) AS good FROM page JOIN lab ON doc = doc_id GROUP BY page_id),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS y FROM page LEFT JOIN votes USING (page_id) GROUP BY host),
h2 AS (SELECT *, string_split(host, '.') AS l FROM h),
h25 AS (SELECT *, CASE WHEN len(l) > 2 AND regexp_full_match(l[len(l)], '[a-z]{2}') AND l[len(l) - 1] IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'gouv', 'mil', 'ne', 'net', 'nom', 'or', 'org') THEN 1 ELSE 0 END AS more FROM h2),
h3 AS (SELECT host, n, y, array_to_string(l[greatest(1, len(l) - 1 - more):], '.') AS domain, array_to_string(l[len(l) - more:], '.') AS suffix FROM h25),
d AS (SELECT suffix, domain, sum(n) AS nd, sum(y) AS yd FROM h3 GROUP BY ALL),
s AS (SELECT suffix, sum(nd) AS ns, sum(yd) AS ys FROM d GROUP BY ALL),
m AS (SELECT (coalesce(sum(ys), 0) + 1) / (coalesce(sum(ns), 0) + 2) AS m0 FROM s),
ks AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(CASE WHEN w > 0 THEN (a - v) / w ELSE 0 END, 0.001))) - 1 AS k FROM (
  SELECT sum(ns * pow(ys / ns - m0, 2)) AS a, sum(m0 * (1 - m0)) AS v, sum((ns - 1) * m0 * (1 - m0)) AS w FROM s, m WHERE ns > 0)),
s2 AS (SELECT suffix, (ys + k * m0) / (ns + k) AS ms FROM s, m, ks),
d1 AS (SELECT * FROM d JOIN s2 USING (suffix)),
kd AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(CASE WHEN w > 0 THEN (a - v) / w ELSE 0 END, 0.001))) - 1 AS k FROM (
  SELECT sum(nd * pow(yd / nd - ms, 2)) AS a, sum(ms * (1 - ms)) AS v, sum((nd - 1) * ms * (1 - ms)) AS w FROM d1 WHERE nd > 0)),
d2 AS (SELECT suffix, domain, (yd + k * ms) / (nd + k) AS md FROM d1, kd),
h4 AS (SELECT * FROM h3 JOIN d2 USING (suffix, domain)),
kh AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(CASE WHEN w > 0 THEN (a - v) / w ELSE 0 END, 0.001))) - 1 AS k FROM (
  SELECT sum(n * pow(y / n - md, 2)) AS a, sum(md * (1 - md)) AS v, sum((n - 1) * md * (1 - md)) AS w FROM h4 WHERE n > 0)),
ab AS (SELECT host, y + k * md AS a, n - y + k * (1 - md) AS b FROM h4, kh),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound FROM ab),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM page JOIN bound USING (host)
"""
