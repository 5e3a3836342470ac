"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Sources are ranked by code point (null last) and weigh ``weights`` in turn. The budget (``share`` of all words) is
divided by weight; a source's target stops at ``cap`` times its words and the excess goes to the others (water
filling, in closed form over the table of sources).

Each document is shuffled by a keyed digest and queued in its source, and once more behind the source's last document,
so that it can be taken twice and no more. A long document is served in packets of at most 1 / ``PACKETS`` of the budget.
A packet's virtual finish time is the words of its source up to and including it, divided by the source's target. All
packets of all sources are ranged by finish time and truncated at the total budget (each target rounded down); the
packet that crosses the budget is cut at that word. Nothing else limits a source: that order alone makes each come
within a packet of its target.

The cut in the global order is found by counting words in ranges of finish time, twice, each time within the range that
holds the budget; only the packets of the last range (2**-24 of a target) are sorted. Running sums never gather a source: it
is cut into ``buckets`` by digest, the (source, bucket) sums give each bucket its offset, and only a bucket's rows are
ordered together; the count of buckets grows with the number of rows.

Defined cases: a null text has size 0; a null source is a source; size 0 takes 0; an empty table gives no rows; rows
that repeat an id are rows of their own; a source without words has target 0. ``mixed`` keeps the columns of the input;
where one has the name of a result column, the result's stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

WORD = r"[^\x20\x09-\x0D]+"
PACKETS = 1 << 17
#: Ranges of finish time in a unit of it, and how often a range is parted again; times from ``LAST`` on are one range.
RANGES, LAST = 4096, 2.0
#: Rows of a bucket, about; and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 10_000, 1024

_KEY = ["_source", "_bucket", "_n"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes: one row a source (_source, _size). Adds _weight and _target."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_limit", F.lit(cap) * F.col("_size") / F.col("_weight"))
    order = Window.orderBy("_limit", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_size").over(order), F.lit(0))  # sources that are full at a lower level
    weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(order), F.lit(0))
    level = (F.lit(share) * F.sum("_size").over(everything) - F.lit(cap) * below) / weight
    ranked = ranked.withColumn("_level", level)
    fair = F.max(F.when(F.col("_level") <= F.col("_limit"), F.col("_level"))).over(everything)
    target = F.least(F.lit(cap) * F.col("_size"), F.coalesce(fair, F.col("_limit")) * F.col("_weight"))
    return ranked.withColumn("_target", target.cast("double")).select("_source", "_size", "_weight", "_target")


def _base(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("_words"), F.xxhash64(text_col).alias("_tie"), *more)
    return base.withColumn("_digest", F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")))


def _in_bucket(base: DataFrame, buckets: int) -> DataFrame:
    return base.withColumn("_bucket", F.conv(F.substring("_digest", 1, 6), 16, 10).cast("long") % buckets)


def _queued(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds _n (place in the bucket), _before (words of the source ahead), _size and _target of the source."""
    plan = plan.withColumnsRenamed({"_source": "_source2", "_bucket": "_bucket2"})
    rows = base.join(plan, base["_source"].eqNullSafe(plan["_source2"]) & (base["_bucket"] == plan["_bucket2"])).drop("_source2", "_bucket2")
    order = Window.partitionBy("_source", "_bucket").orderBy("_digest", "_id", "_words", "_tie")
    return rows.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.col("_offset") + F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words")).drop("_offset")


def _packet(entry: Column, quantum: int) -> tuple[Column, Column]:
    """Words and finish time of a document's packet: its first round's in order, then its second's."""
    parts = F.ceil(F.col("_words") / quantum)
    at = (entry % parts) * quantum
    words = F.least(F.lit(quantum), F.col("_words") - at)
    return words, (F.col("_before") + F.floor(entry / parts) * F.col("_size") + at + words) / F.col("_target")


def _entries(quantum: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), (2 * F.ceil(F.col("_words") / quantum) - 1).cast("long"))


def _cut(packets: DataFrame, budget: int) -> tuple[float, float, int]:
    """The range of finish times that holds the budget: its two ends, and the words ahead of it."""
    low, width, ahead = 0.0, 1.0 / RANGES, 0
    at = F.least(F.col("_finish"), F.lit(LAST))
    for _ in range(2):
        place = F.floor((at - low) / width)
        sums = packets.where((at >= low) & (at < low + width * RANGES * (LAST + 1))).groupBy(place.alias("_place")).agg(F.sum("_piece").alias("_sum"))
        run = F.sum("_sum").over(Window.orderBy("_place")) + ahead  # at most RANGES * (LAST + 1) rows
        found = sums.withColumn("_run", run).where(F.col("_run") > budget).orderBy("_place").first()
        if found is None:
            return LAST, float("inf"), ahead
        low, ahead = low + found["_place"] * width, int(found["_run"] - found["_sum"])
        width /= RANGES
    return low, low + width * RANGES, ahead


def _mix(docs: DataFrame, keep: bool, weights: tuple[int, ...], share: float, cap: float, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    base = staged(_base(docs, seed, id_col, text_col, source_col), "words")
    buckets = max(LEAST_BUCKETS, base.count() // BUCKET_ROWS)
    sums = _in_bucket(base, buckets).groupBy("_source", "_bucket").agg(F.sum("_words").alias("_sum"))
    in_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(in_source), F.lit(0))), "offsets")
    goals = staged(targets(offsets.groupBy("_source").agg(F.sum("_sum").alias("_size")), weights, share, cap), "targets")
    budget = goals.select(F.sum(F.floor("_target")).alias("b")).first()["b"] or 0
    quantum = -(-budget // PACKETS) or 1
    plan = staged(offsets.join(goals, offsets["_source"].eqNullSafe(goals["_source"])).select(offsets["_source"], "_bucket", "_offset", "_size", "_target"), "offsets")
    queue = staged(_queued(_in_bucket(base, buckets), plan), "queue")

    words, finish = _packet(F.col("_entry"), quantum)
    packets = queue.where("_words > 0 and _target > 0").withColumn("_entry", F.explode(_entries(quantum))).withColumns({"_piece": words, "_finish": finish})
    low, high, ahead = _cut(packets.select("_piece", "_finish"), budget)
    # only the packets of the range that the budget falls in are sorted one by one
    last = packets.where((F.least(F.col("_finish"), F.lit(LAST)) >= low) & (F.col("_finish") < high))
    order = Window.orderBy("_finish", "_source", "_digest", "_n", "_entry").rowsBetween(Window.unboundedPreceding, 0)
    left = F.lit(budget - ahead) - (F.sum("_piece").over(order) - F.col("_piece"))
    last = last.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_piece"), left))).groupBy(*_KEY).agg(F.sum("_more").alias("_more")).where("_more > 0")
    last = staged(last, "last").withColumnsRenamed({k: f"{k}2" for k in _KEY})

    rows = queue if not keep else _queued(_in_bucket(_base(docs, seed, id_col, text_col, source_col, F.struct(*docs.columns).alias("_row")), buckets), plan)
    rows = rows.join(last, rows["_source"].eqNullSafe(last["_source2"]) & (rows["_bucket"] == last["_bucket2"]) & (rows["_n"] == last["_n2"]), "left")

    def whole(total, entry):
        piece, at = _packet(entry, quantum)
        return total + F.when(at < low, piece).otherwise(0)

    served = F.when((F.col("_words") > 0) & (F.col("_target") > 0), F.aggregate(_entries(quantum), F.lit(0).cast("long"), whole)).otherwise(F.lit(0).cast("long"))
    first = F.when((F.col("_target") > 0), (F.col("_before") + F.col("_words")) / F.col("_target")).otherwise(1.0)
    return rows.withColumns({"_taken": (served + F.coalesce("_more", F.lit(0))).cast("long"), "_first": first})


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_finish (of its first round) for every row of docs."""
    got = _mix(docs, False, weights, share, cap, seed, id_col, text_col, source_col)
    return got.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), *_results())


def _results() -> list[Column]:
    return [F.col(a).alias(b) for a, b in (("_words", "size"), ("_size", "source_size"), ("_target", "target"), ("_taken", "taken"), ("_first", "virtual_finish"))]


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs with its text as the mix takes it (once more behind a line feed where it is repeated, cut at a
    word where the budget ends, empty where nothing is taken; n_chars follows), and the columns of ``mix`` behind."""
    got = _mix(docs, True, weights, share, cap, seed, id_col, text_col, source_col)
    text = F.col("_row")[text_col].cast("string")
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    begin = lambda n: F.array_join(F.slice(parts, F.lit(1), n.cast("int")), " ")
    taken, words = F.col("_taken"), F.col("_words")
    new = F.when(taken == words, text).when(taken == 0, "").when(taken < words, begin(taken)).when(taken == 2 * words, F.concat(text, F.lit("\n"), text)).otherwise(F.concat(text, F.lit("\n"), begin(taken - words)))
    got = got.withColumn("_new", new)
    results = ("size", "source_size", "target", "taken", "virtual_finish")
    kept = [F.col("_new").alias(c) if c == text_col else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns if c not in results]
    return got.select(*kept, *_results())


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(digest, 1, 6) AS BIGINT) % 1024 AS bucket FROM base),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM keyed GROUP BY source),
weighed AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
lim AS (SELECT *, 2.0::DOUBLE * source_size / w AS lim FROM weighed),
lev AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
  FROM lim WINDOW o AS (ORDER BY lim, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT *, least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN lev <= lim THEN lev END) OVER (), lim) * w) AS target FROM lev),
budget AS (SELECT sum(floor(target))::BIGINT AS b, greatest(1, ceil(sum(floor(target)) / 131072))::BIGINT AS q FROM goal),
run AS (SELECT k.doc_id, k.source, k.size, k.digest, g.source_size, g.target, row_number() OVER o AS n,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.bucket, k.digest, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source WINDOW o AS (ORDER BY k.source NULLS FIRST, k.bucket, k.digest, k.doc_id, k.size)),
entry AS (SELECT n, digest, source, size, source_size, target, before, q, unnest(range(0, 2 * ceil(size / q)::BIGINT)) AS e FROM run, budget WHERE size > 0 AND target > 0),
packet AS (SELECT n, digest, source, e, least(q, size - (e % ceil(size / q)::BIGINT) * q) AS piece,
    (before + (e // ceil(size / q)::BIGINT) * source_size + (e % ceil(size / q)::BIGINT) * q + least(q, size - (e % ceil(size / q)::BIGINT) * q)) / target AS finish FROM entry),
queued AS (SELECT n, piece, sum(piece) OVER (ORDER BY finish, source NULLS FIRST, digest, n, e ROWS UNBOUNDED PRECEDING) - piece AS ahead FROM packet),
served AS (SELECT n, sum(greatest(0, least(piece, b - ahead))) AS taken FROM queued, budget GROUP BY n)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN (before + size) / target ELSE 1.0 END AS virtual_finish
FROM run LEFT JOIN served USING (n)
"""
