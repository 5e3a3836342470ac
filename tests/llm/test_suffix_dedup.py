import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsentinel.llm.suffix_dedup import dedup, doubled, position_names


def brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        cut = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                cut[i : i + n] = [True] * n
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((d, len(t), sum(cut), spans, bytes(x for x, c in zip(t, cut, strict=True) if not c)))
    return sorted(out, key=str)


def corpus(seed, scale):
    r = random.Random(seed)
    letters = "abcdefghij éñ\n"
    passages = ["".join(r.choices(letters, k=r.randint(scale // 2, scale * 3))) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, "a" * (scale * 2)), (3, "ab" * (scale * 2)), (4, "x" * scale), (4, "y" * (scale - 1))]
    for i in range(40):
        parts = []
        for _ in range(r.randint(1, 3)):
            parts.append("".join(r.choices(letters, k=r.randint(0, scale * 2))))
            p = r.choice(passages)
            if r.random() < 0.7:
                at = r.randrange(len(p))
                parts.append(p[at:] if r.random() < 0.5 else p[:at] + "#" + p[at:])
        rows.append((i * 2, "".join(parts)))
    rows += [(500 + i, rows[8 + i % 4][1]) for i in range(8)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,gram,step,limit", [(400, 16, 64, None), (60, 8, 8, None), (60, 8, 8, 0), (40, 10, 16, None), (40, 4, 2, None)])
def test_matches_brute_force(spark, length, gram, step, limit):
    rows = corpus(length, length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("kept", F.lit(1)).withColumn("_text", F.lit("x"))
    got = [(x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in dedup(df, length, gram, step, limit).collect()]
    want = brute(rows, length)
    assert sorted(got, key=str) == want
    assert any(w[2] for w in want)


def test_empty(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_position_names(spark):
    """Positions are named alike where Spark ranks them and where texts are walked."""
    keys, at = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901], [0, 1, 2**40, 7, 3, -5]
    want = [r.h for r in spark.createDataFrame([*zip(keys, at, strict=True)], "k long, i long").select(F.xxhash64("k", "i").alias("h")).collect()]
    assert position_names(np.array(keys), np.array(at)).view(np.int64).tolist() == want


def test_rounds_sort_pairs(spark):
    """Ranks double: of steps a b c d, e b c d, a b c x the pairs and fours that repeat stay, unique ones leave."""
    rows = [(1, [1, 2, 3, 4, 5]), (2, [9, 2, 3, 4, 5]), (3, [1, 2, 3, 8]), (4, [7])]
    got = {r.key: r.kind for r in doubled(spark.createDataFrame(rows, "key long, h array<long>"), 400, 64).collect()}
    name = lambda k, i: position_names(np.array([k]), np.array([i])).view(np.int64)[0]
    want = {(1, 0): 2, (1, 1): 4, (1, 2): 2, (1, 3): 2, (1, 4): 1, (2, 1): 4, (2, 2): 2, (2, 3): 2, (2, 4): 1, (3, 0): 2, (3, 1): 2, (3, 2): 1}
    assert got == {name(*k): v for k, v in want.items()}
