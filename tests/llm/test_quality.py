import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from logsentinel.llm import quality


def test_statistics_are_of_whole_texts():
    texts = ["", "A b|c!\n", "é" * 10, "w " * 50_000]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), off)
    assert x.shape == (4, len(quality.NAMES)) and np.isfinite(x).all()
    assert x[3, 0] == np.log1p(50_000) and x[0, 0] == 0
    for i, r in enumerate(raw):
        assert np.allclose(quality.statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0], x[i])


def test_held_out_accuracy(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(r.choices("abcdeio", k=r.randint(1, 8))) for _ in range(r.randint(5, 80))]
        good = r.random() < 0.8
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if r.random() < 0.5 else " | ".join(words)
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "x y"), (3, rows[3][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels + [(1, None), (1, labels[1][1])], "doc_id long, quality int")
    got = quality.classify(docs, known).collect()
    assert len(got) == 904 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    test = [x for x in got if x.held_out and x.doc_id in dict(labels)]
    assert np.mean([x.predicted == dict(labels)[x.doc_id] for x in test]) > 0.97
    kept = {x.doc_id for x in quality.keep_good(docs, known).collect()}
    assert kept == {x.doc_id for x in got if x.predicted}
    assert quality.keep_good(docs, known).columns == docs.columns


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in quality.classify(docs, none).collect()] == [0.5]
    assert quality.classify(docs.limit(0), none).count() == 0


def test_one_class_only(spark):
    """Without rows of both classes the score is the Laplace share of label 1."""
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30))
    assert {x.score for x in quality.classify(docs, labels).collect()} == {round((n + 1) / (n + 2), 9)}


def test_scores_against_densities(spark):
    """Scores from cached factors are those of the densities written out; the shrinkage is the best over the folds, and
    held-out rows have no part in it."""
    r = np.random.default_rng(8)
    d = len(quality.NAMES)
    mix = r.normal(size=(2, d, d)) * 0.4 + np.eye(d)
    y = (r.random(600) < 0.6).astype(int)
    x = np.stack([mix[k] @ r.normal(size=d) + 0.8 * k for k in y])
    fold = r.integers(0, quality.FOLDS, 600)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "x array<double>, label int, fold int").repartition(5)

    def direct(train, shrink, diagonal, at):
        cls = [x[train & (y == k)] for k in (0, 1)]
        cov = [np.cov(z.T, bias=True) for z in cls]
        pooled = sum(len(z) * c for z, c in zip(cls, cov, strict=True)) / train.sum()
        base = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        dense = []
        for z, c in zip(cls, cov, strict=True):
            s = min(1, shrink + d / len(z))
            full = (1 - s) * c + s * base
            off = at - z.mean(0)
            dense.append(np.log(len(z) / train.sum()) - 0.5 * np.linalg.slogdet(full)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(full), off))
        return 1 / (1 + np.exp(dense[0] - dense[1]))

    loss = {}
    for s in quality.SHRINKAGES:
        p = np.empty(600)
        for f in range(quality.FOLDS):
            p[fold == f] = direct(fold != f, *s, x[fold == f])
        p = np.clip(p, 1e-6, 1 - 1e-6)
        loss[s] = -np.log(np.where(y == 1, p, 1 - p)).sum()
    best = min(loss, key=loss.get)
    assert np.allclose(quality.fit(rows).score(x), direct(np.ones(600, bool), *best, x), atol=1e-7)
