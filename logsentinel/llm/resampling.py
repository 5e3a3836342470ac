"""Importance resampling towards a target distribution, by hashed n-grams.

In each partition DuckDB cuts the texts of a batch into words, lines them up as n-grams by window functions and hashes
each different one with a registered CRC-32. The counts of a partition's buckets are spilled to Parquet in the shared
folder, where Spark merges them; as many rows as there are buckets, whatever the corpus, come to the driver as gains. A
second pass of the same SQL adds up the gains of each text; the draw is Gumbel top-k, ordered by range partitions.

Rows: a null or empty text, or one of separators only, has no features and weight 0. Ids may be null (these draw as the
empty text would name them) or repeat: each row is drawn by itself, rows with equal score and id in any order. Empty tables
give no rows, and gains of an empty corpus are those of the added ones alone. Extra columns are not read. A text may be of
any length; its words are held at once, as those of its batch are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, staged

#: What words are made of, after A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(f.encode()) for f in features.to_pylist()], pa.int64())


def _session() -> duckdb.DuckDBPyConnection:
    """A database in the task's memory, one thread."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})
    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _grams(longest: int, buckets: int) -> str:
    """SQL from the batch (row, _text) to gram(row, bucket, k): how often the row's features fall into the bucket."""
    words = f"SELECT row, unnest(regexp_extract_all({_LOWER.format('_text')}, '{WORDS}')) AS w FROM batch"
    if longest == 1:
        grams = "SELECT row, w AS g FROM word"
    else:
        words = f"SELECT row, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT row, regexp_extract_all({_LOWER.format('_text')}, '{WORDS}') AS w FROM batch)"
        ahead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY row ORDER BY i) AS w{k}" for k in range(1, longest))
        each = " UNION ALL ".join(f"SELECT row, concat_ws(' ', w{''.join(f', w{j}' for j in range(1, k))}) AS g FROM line" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, longest + 1))
        grams = f"SELECT row, g FROM ({each})"
        words = f"SELECT row, w, {ahead} FROM ({words})"
    name = "word" if longest == 1 else "line"
    return f"""WITH {name} AS MATERIALIZED ({words}), seen AS MATERIALIZED (SELECT row, g, count(*) AS k FROM ({grams}) GROUP BY row, g),
      hashed AS MATERIALIZED (SELECT g, crc(g) % {buckets} AS bucket FROM (SELECT DISTINCT g FROM seen)), gram AS (SELECT row, bucket, k FROM seen JOIN hashed USING (g))"""


def _texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *more)


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all features of all texts; buckets that have none are missing. Partitions spill theirs to Parquet."""
    sql = f"{_grams(longest, buckets)} SELECT bucket, sum(k)::BIGINT AS n FROM gram GROUP BY bucket"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, total = _session(), np.zeros(buckets, np.int64)
        for b in batches:
            con.register("batch", pa.table({"row": pa.array(range(len(b)), pa.int64()), "_text": b.column("_text")}))
            got = con.execute(sql).fetchnumpy()
            total[got["bucket"]] += got["n"]
            con.unregister("batch")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    spilled = staged(_texts(docs, text_col).mapInArrow(run, "bucket long, n long"), "buckets")
    return spilled.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """What a feature of each bucket adds to a weight: 1000 ln of its share in the target by its share in the corpus, each
    count with one added, rounded down."""
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (corpus, target))  # a row a bucket
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return np.array([math.floor(1000 * math.log(float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id_col, n_words, n_features, weight) of each text."""
    slim = _texts(docs, text_col, F.col(id_col).alias("_id"))
    sent = slim.sparkSession.sparkContext.broadcast(gain)
    sql = f"{_grams(longest, len(gain))} SELECT row, sum(k)::BIGINT AS n, sum(k * gain)::BIGINT AS weight FROM gram JOIN gains USING (bucket) GROUP BY row"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        con.register("given", pa.table({"bucket": pa.array(range(len(sent.value)), pa.int64()), "gain": pa.array(sent.value)}))
        con.execute("CREATE TABLE gains AS SELECT * FROM given")
        for b in batches:
            con.register("batch", pa.table({"row": pa.array(range(len(b)), pa.int64()), "_text": b.column("_text")}))
            got = con.execute(sql).fetchnumpy()
            con.unregister("batch")
            n, weight = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            n[got["row"]], weight[got["row"]] = got["n"], got["weight"]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(_words(n, longest)), pa.array(n), pa.array(weight)], names=["_id", "n_words", "n_features", "weight"])

    got = slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return got.withColumnRenamed("_id", id_col)


def _words(features: np.ndarray, longest: int) -> np.ndarray:
    """Words of texts with so many runs of 1 to longest words: w + (w - 1) + ... as far as they reach."""
    least = np.cumsum(np.arange(1, longest + 1))  # features of a text of 1, 2, ... words
    short = np.searchsorted(least, features, side="right")
    return np.where(features < least[-1], short, (features + longest * (longest - 1) // 2) // longest)


def draw(scored: DataFrame, fraction: tuple[int, int], least_words: int, id_col: str = "doc_id") -> DataFrame:
    """Adds rank, from 1, to the highest scores among texts of at least so many words, fraction of them rounded down; ties
    to the smaller id. Range partitions are sorted each by itself, and hold their rows' places; a row a partition is summed."""
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col(id_col).asc()]
    place = F.monotonically_increasing_id()  # by partition and place in it, in the order of the sort
    placed = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at")), "drawn")
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    most = sum(n for _, n in sizes) * fraction[0] // fraction[1]
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    starts = placed.sparkSession.createDataFrame(rows, "_p long, _before long")
    rank = F.col("_before") + F.col("_at") + 1
    ranked = placed.join(F.broadcast(starts), F.col("_part") == F.col("_p"), "left").withColumn("rank", F.when(rank <= most, rank))
    return ranked.drop("_part", "_at", "_p", "_before").unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, seed: str, fraction: tuple[int, int] = (10, 100), least_words: int = 20, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every text of docs as (id_col, n_features, weight, score, rank): those with a rank are drawn. score: the weight plus
    noise that the seed and the id alone decide, so a row draws alike wherever it stands."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    weighed = weigh(docs, gain, id_col, text_col, longest)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = staged(weighed.withColumn("score", F.col("weight") + noise), "scored")
    return draw(scored, fraction, least_words, id_col).select(id_col, "n_features", "weight", "score", "rank")


#: The same in SQL alone; CRC-32 bit by bit, once for each different feature.
ORACLE = rf"""
WITH src AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
word AS (SELECT r, unnest(regexp_extract_all({_LOWER.format('text')}, '{WORDS}')) AS g FROM src),
aim AS (SELECT unnest(regexp_extract_all({_LOWER.format('text')}, '{WORDS}')) AS g FROM benchmark),
one AS (SELECT g, lower(hex(encode(g))) AS h FROM (SELECT g FROM word UNION SELECT g FROM aim)),
hashed AS (SELECT g, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END))) % 10000 AS b FROM one),
s AS (SELECT b, count(*) AS k FROM word JOIN hashed USING (g) GROUP BY b), t AS (SELECT b, count(*) AS k FROM aim JOIN hashed USING (g) GROUP BY b),
size AS (SELECT (SELECT count(*) FROM word) + 10000 AS ss, (SELECT count(*) FROM aim) + 10000 AS tt),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.k, 0) + 1)::DOUBLE * ss::DOUBLE / ((coalesce(s.k, 0) + 1)::DOUBLE * tt::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b), size),
doc AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM word JOIN hashed USING (g) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, r, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM src LEFT JOIN doc USING (r)),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN fit USING (r)
"""
