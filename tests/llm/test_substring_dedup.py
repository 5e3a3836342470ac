import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logsentinel.llm.substring_dedup import dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    docs = sorted({(-(1 << 63) if d is None else d) for d, _ in rows})
    words = {}
    for d, t in rows:
        words[-(1 << 63) if d is None else d] = WORD.findall(t or "")
    for d in docs:
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, t in rows:
        k = -(1 << 63) if d is None else d
        w = words[k]
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (k, i):
                cut[i : i + window] = [True] * window
        out[d] = (len(w), sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut, strict=True) if not c).encode()).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ñandú", "a,b"]
    passages = [" ".join(r.choices(vocab, k=r.randint(15, 60))) for _ in range(6)]
    line = " ".join(r.choices(vocab, k=12))
    rows = [(None, " ".join(r.choices(vocab, k=30))), (-5, None), (7000, ""), (7001, " \t\n "), (7002, "x " * 90), (7003, "a b c " * 40)]
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(" ".join(r.choices(vocab, k=r.randint(0, 50))))
            parts.append(r.choice(passages) if r.random() < 0.4 else line)
        rows.append((i * 3, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(900 + i, rows[10 + i % 3][1]) for i in range(9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit,hot", [(None, 1000), (None, 2), (0, 1000), (0, 3)])
def test_matches_brute_force(spark, limit, hot):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit(1)).withColumn("_id", F.lit("x"))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup(df, hot_anchor=hot, broadcast_rows=limit).collect()}
    want = brute(rows, 20)
    assert got == want
    assert any(v[1] for v in want.values())


def test_spans_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (2, "p q " + text + " r")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup(df).collect()}
    assert got[1].spans == [] and got[1].kept_text == text
    assert [(s.start, s.end) for s in got[2].spans] == [(2, 52)] and got[2].kept_text == "p q r"
    assert dedup(df.limit(0)).count() == 0


def test_repeated_ids_and_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in dedup(df).collect()) == [(1, 0), (1, 0), (2, 40)]
