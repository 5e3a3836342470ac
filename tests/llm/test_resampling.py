"""Importance resampling against loops over the rows; the registered query is held against SQL in test_queries.py."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from logsentinel.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, seed, fraction, least, longest, buckets):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(s.sum() + buckets) / ((s[b] + 1) * float(t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    most = len(fit) * fraction[0] // fraction[1]
    return sorted(([r[0], r[2], r[3], r[4], None] for r in rows if r[1] < least), key=str), [[r[0], r[2], r[3], r[4], k + 1 if k < most else None] for k, r in enumerate(fit)]


def texts(n, seed=3):
    rnd = random.Random(seed)
    words = ["The", "cat", "sat", "naïve", "Straße", "x1", "漢字", "don't", "ÀB", "\U0001f600"] + [f"w{i}" for i in range(40)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 8, 30]))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_brute_force(spark, longest):
    docs = [(i, t) for i, t in enumerate(texts(300))] + [(900, None), (901, ""), (902, ".,- "), (903, "w1 " * 50_000), (None, "w2 w3 w4 w5 w6 w7")]
    target = [*texts(20, seed=5), None]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, weight int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resampling.resample(df, aim, "s", (30, 100), 3, longest, 500).collect()
    low, fit = brute(docs, target, "s", (30, 100), 3, longest, 500)
    got = [[r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in rows]
    assert sorted(got, key=str) == sorted(low + fit, key=str)


def test_words_from_features():
    for longest in range(1, 6):
        features = np.array([sum(max(0, w - n + 1) for n in range(1, longest + 1)) for w in range(30)])
        assert resampling._words(features, longest).tolist() == list(range(30))


def test_ties_and_repeats(spark):
    """Repeated rows have equal scores and ids: each takes a rank of its own; without weights the smaller id goes first."""
    df = spark.createDataFrame([(i % 3, "a b c") for i in range(12)], "doc_id long, text string")
    got = resampling.resample(df, df.limit(0), "s", (1, 1), 1).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 13))
    scored = spark.createDataFrame([(i, 5, 3, 7) for i in range(50)], "doc_id long, n_words long, n_features long, score long").repartition(4)
    got = {r.doc_id: r["rank"] for r in resampling.draw(scored, (10, 100), 5).collect()}
    assert got == {i: i + 1 if i < 5 else None for i in range(50)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none, "s").collect() == []
    one = resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none, "s").collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(2, None)]
