import random
import re

import pytest
from pyspark.sql import functions as F

from logsentinel.llm import ngram_join
from logsentinel.llm.ngram_join import join, keep_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, n=3, threshold=90):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {d: 0 for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(x), root(d), links[d]) for d, x in sets}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "ß", "W1"]
    line = r.choices(vocab, k=14)
    rows = [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "a b"), (905, "A\tb"), (906, "a b c"), (907, "x " * 500), (908, "x x x")]
    for f in range(12):
        base = r.choices(vocab, k=r.choice([12, 40, 90, 300])) + line * (f % 2)
        for c in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((f * 20 + c, r.choice([" ", "\n"]).join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit,block", [(None, 128_000), (0, 128_000), (None, 900)])
def test_matches_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("root", F.lit(1)).withColumn("_text", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in join(df, broadcast_rows=limit).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[1] != d for d, v in want.items()) > 20


def test_keep_one_and_edges(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (None, "q r s t"), (7, None), (8, ""), (5, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in join(df).collect()) == [(-1, -1), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8)]
    assert sorted(str(r.doc_id) for r in keep_one(df).collect()) == ["3", "7", "8", "None"]
    assert join(df.limit(0)).count() == 0 and keep_one(df).columns == df.columns


def test_filters_find_pairs_at_the_threshold():
    """As many filters as the probability asks for; of 2000 pairs at the threshold each passes one."""
    import numpy as np

    assert [ngram_join.trials(x) for x in (80, 90, 100)] == [37, 20, 1]
    r = np.random.default_rng(3)
    for threshold in (80, 90):
        for _ in range(1000):
            x = r.integers(0, 1 << 63, 90, dtype=np.uint64)
            y = x.copy()
            gone = 90 - int(np.ceil(2 * 90 * threshold / (100 + threshold)))
            y[:gone] = r.integers(0, 1 << 63, gone, dtype=np.uint64)
            keys = ngram_join._profile(np.concatenate([x, y]), np.array([0, 90, 180]), ngram_join.trials(threshold))[2]
            assert (keys[0] == keys[1]).any()


def test_several_texts_under_one_id(spark):
    """Texts under one id, or under none, are one node: a copy of either is linked to it."""
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcd")
    rows = [(None, a), (None, b), (5, b + " x"), (6, a), (7, c), (7, d), (8, d + " y"), (9, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in join(df).collect()}
    assert got == {(None, None), (5, None), (6, None), (7, 7), (8, 7), (9, 7)}


def test_keep_one_takes_five_words_and_four_fifths(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("_gone", F.lit(2))
    root = brute(rows, 5, 80)
    assert {r.doc_id for r in keep_one(df).collect()} == {d for d, _ in rows if root[d][1] == d}
    assert root != brute(rows, 5, 90)
