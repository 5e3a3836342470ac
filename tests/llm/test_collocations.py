"""Collocations against plain counting; the registered query is held against SQL in test_queries.py."""

import random
import re
from collections import Counter, defaultdict

import pytest

from logsentinel.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest, most):
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        n = sum(k for p, k in count.items() if len(p) == 1)
        frequent = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in frequent.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = ["The", "New", "York", "times", "é", "Éa", "漢字", "a b", "x", "y", "z", "-", "\x1f"]
    stock = ["New York Times", "x y z x y", "of the", "é a \t b", "a a a a a a a"]
    docs = [(rnd.choice(["en", "de", None, "und"]), rnd.choice([" ", "  ", "\t"]).join(rnd.choice(words + stock) + rnd.choice(["", "", "", ".", ",", "\n", "\x0b", "?!"]) for _ in range(rnd.choice([0, 1, 5, 40])))) for _ in range(n)]
    return [*docs, ("en", None), ("fr", ""), ("fr", " .,\t\n"), ("en", "x y z " * 3_000), ("fr", "New York " * 30 + "!" + "New York." * 9)]


def table(spark, docs):
    return spark.createDataFrame([(t, g, i, "n", 1) for i, (g, t) in enumerate(docs)], "text string, lang string, slice int, word string, node int").repartition(5)


@pytest.mark.parametrize("nodes_bytes", [collocations.NODES_BYTES, -1])  # broadcast; joined
def test_brute_force(spark, monkeypatch, nodes_bytes):
    docs = corpus(1)
    got = collocations.mine(table(spark, docs), least=4, longest=4, most=60, nodes_bytes=nodes_bytes).collect()
    assert sorted(map(tuple, got)) == brute(docs, 4, 4, 60)


def test_small_slices_and_tries(spark, monkeypatch):
    """Texts cut between pieces, tries that are written in parts, and a piece longer than a slice."""
    docs = [*corpus(2, 60), ("en", "new york " * 500)]
    for name, value in (("SLICE_BYTES", 64), ("WAITING_BYTES", 100), ("TRIE_ROWS", 30)):
        monkeypatch.setattr(collocations, name, value)
    waiting = [t.encode() for _, t in docs if t]
    parts = [bytes(p) for p in collocations._slices(waiting)]
    assert b"".join(parts) == b"\n".join(waiting) and len(parts) > 20
    assert all(collocations._KIND[p[-1]] == 2 for p in parts[:-1])
    trie = collocations._PairTrie(__import__("pyarrow").schema([]))
    assert list(trie.flush()) == []
    got = collocations.mine(table(spark, docs), least=3, longest=5, most=500).collect()
    assert sorted(map(tuple, got)) == brute(docs, 3, 5, 500)


def test_sums_of_buckets(spark):
    """Pairs of the same bucket add up over slices, tasks and parts; only buckets that reach the least are heavy."""
    import numpy as np

    chunk = collocations.CHUNK
    one, two = np.zeros((2, chunk), "<u1")
    one[[0, 5]], two[[0, 6]] = [3, 2], [2, 4]
    rows = [(0, 0, bytearray(one.tobytes())), (0, 1, bytearray(two.tobytes())), (3, 0, bytearray(one.tobytes())), (3, 0, bytearray(two.tobytes())), (3, 2, bytearray(one.tobytes()))]
    heavy = collocations._heavy(spark.createDataFrame(rows, "chunk int, part int, sums binary").repartition(3), 4)
    assert np.flatnonzero(heavy).tolist() == [0, 6, 3 * chunk, 3 * chunk + 5, 3 * chunk + 6]


def test_products_beyond_64_bits(spark):
    """a * n and l * r are exact where they pass 2 ** 63."""
    big = 3_000_000_007
    row = spark.createDataFrame([(big, 4 * big + 1, [big + 2, big], [big + 4, big])], "n long, all long, lefts array<long>, rights array<long>")
    cut = row.selectExpr(f"{collocations._weakest_cut(2)} AS c").first().c
    assert (cut.score, cut.l, cut.r) == (1000 * big * (4 * big + 1) // ((big + 2) * (big + 4)), big + 2, big + 4)


def test_empty(spark):
    assert collocations.mine(table(spark, [("en", "a b")]).limit(0)).collect() == []
    assert collocations.mine(table(spark, [("en", "a b")])).collect() == []


def test_tries_by_core(spark, monkeypatch):
    """A frequent pair has a row a core, not a row for each file or part of the table that holds it."""
    real, rows = collocations.written, {}

    def spy(df, name, **more):
        path = real(df, name, **more)
        if name.startswith("tries"):
            rows[name] = spark.read.parquet(path).count()
        return path

    monkeypatch.setattr(collocations, "written", spy)
    docs = spark.createDataFrame([("en", "new york times of new york")] * 400, "lang string, text string").repartition(40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found, _ = collocations.phrases(docs, least=100, longest=3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[1].count() == 4 and found[2].count() == 4
    assert rows["tries2"] <= 4 * spark.sparkContext.defaultParallelism and rows["tries3"] <= 4 * spark.sparkContext.defaultParallelism


def test_buckets(spark):
    """Buckets follow the occurrences within bounds; a slice's sums stop at the least, also beyond a byte."""
    import numpy as np

    assert [collocations._buckets(n) for n in (0, 1 << 23, 1 << 25, 1 << 40)] == [1 << 20, 1 << 21, 1 << 23, 1 << 26]
    total = np.array([0, 99, 50, 7], "<u1")
    collocations._add(total, np.array([2, 0, 2, 1, 0]), np.array([30, 1000, 19, 1, 1]), 100)
    assert total.tolist() == [100, 100, 99, 7]


def test_joined_nodes_by_slice(spark):
    """Each slice's nodes come as one row, wherever its rows came from."""
    import numpy as np

    rows = [(s, p, 10 * s + p) for s in range(9) for p in range(s * 700)]
    got = collocations._lists(spark.createDataFrame(rows, "slice long, pos int, node long").repartition(7)).collect()
    assert sorted(r.slice for r in got) == list(range(1, 9))
    for r in got:
        pos, node = np.frombuffer(r._pos, "<i4"), np.frombuffer(r._node, "<i8")
        assert sorted(pos.tolist()) == list(range(r.slice * 700)) and (node == 10 * r.slice + pos).all()
