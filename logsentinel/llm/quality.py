"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

``statistics`` turns each whole text into a fixed vector (shares of character classes, word lengths, repetition),
on a log or log-odds scale. ``fit`` takes each class's mean and covariance from distributed moment sums over all
training rows (no sample), shrinks the covariance towards the pooled one and its diagonal, and caches the Cholesky
factors. How far it shrinks is chosen among ``SHRINKAGES`` by log loss over ``FOLDS`` folds of the training rows: each fold
is scored by models of the other folds, whose moments are sums that are there already. ``score`` is the posterior of label 1 from the difference of the two Mahalanobis log densities.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1; only the text is an input of the score. Defined
cases: null text is empty; an empty text has a score like any other; with one class or none in training the score
is the (Laplace) share of label 1; labels repeated for a doc_id count once, by their maximum; null labels don't count;
a null doc_id is held in (its text form is empty).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, staged
from .tokens import Rolling, mix, slices, word_bounds, word_hashes

#: Byte classes: 0 rest, 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 punctuation, 7 exclamation, 8 symbol, 9 bar, 10 lead byte, 11 continuation.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "#$%&*@^~=+<>\\/_{}[]`"]] = 8
_CLASS[ord("|")] = 9
_CLASS[0xC0:] = 10
_CLASS[0x80:0xC0] = 11
_CLASSES = 12

NAMES = ("size", "upper", "digit", "line", "punctuation", "exclamation", "symbol", "bar", "accent", "word_mean", "word_spread", "odd_words", "new_words", "new_triples", "top_word")


def _share(part, whole):
    """Log odds of a share, smoothed so that 0 and 1 are finite and short texts are less extreme."""
    return np.log(part + 0.5) - np.log(whole - part + 0.5)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of the slice."""
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    c = np.bincount(row * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    start, end, first = word_bounds(data, off)
    words = word_hashes(data, start, end)
    count = np.diff(first)
    length = (end - start).astype(float)
    owner = np.repeat(np.arange(n), count)
    mean = np.bincount(owner, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(owner, length**2, n) / np.maximum(count, 1) - mean**2))
    symbols = np.concatenate([[0], np.cumsum((_CLASS[data] == 8) | (_CLASS[data] == 9) | (_CLASS[data] == 7))])
    odd = np.bincount(owner, (symbols[end] - symbols[start]) > 0, n)
    new, triples, top = np.zeros(n), np.zeros(n), np.zeros(n)
    grams = Rolling(words).grams(3)
    for i in np.flatnonzero(count):
        a, b = first[i], first[i + 1]
        w = np.sort(words[a:b])
        edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True])
        new[i], top[i] = len(edge) - 1, np.diff(edge).max()
        triples[i] = len(np.unique(grams[a : max(a, b - 2)]))
    letters = c[:, 1] + c[:, 2] + c[:, 10]
    return np.stack([
        np.log1p(count), _share(c[:, 2], letters), _share(c[:, 3], size), _share(c[:, 5], size), _share(c[:, 6], size), _share(c[:, 7], size), _share(c[:, 8], size), _share(c[:, 9], size), _share(c[:, 10], letters),
        np.log1p(mean), np.log1p(spread), _share(odd, count), _share(new, count), _share(triples, np.maximum(count - 2, 0)), _share(top, count)], 1)


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of doubles) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in slices(b.column(1)):
                x = statistics(data, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), flat], names=["doc_id", "x"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None  # (2, d)
    whiten: np.ndarray | None = None  # (2, d, d): inverses of the Cholesky factors
    offset: np.ndarray | None = None  # (2,): log prior minus half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        dense = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -700, 700)))


#: Weight of the pooled covariance in each class's, and of the diagonal in the pooled one; the first of equals is taken.
SHRINKAGES = tuple((a, b) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.1, 0.5, 0.9))
FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    """The fold of a training row; null ids are in the first."""
    return F.coalesce(F.crc32(F.concat(doc_id.cast("string"), F.lit("/fold")).cast("binary")) % FOLDS, F.lit(0)).cast("int")


def model_of(sums: np.ndarray, shrink: float, to_diagonal: float) -> Model:
    """sums: for each class its count, sum of vectors and sum of their outer products."""
    d = len(NAMES)
    n = sums[:, 0]
    prior = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 2:
        return Model(prior)
    mean = sums[:, 1 : d + 1] / n[:, None]
    cov = sums[:, d + 1 :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    base = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    whiten, offset = [], []
    for k in (0, 1):
        s = min(1.0, shrink + d / n[k])
        factor = np.linalg.cholesky((1 - s) * cov[k] + s * base)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(prior, mean, np.array(whiten), np.array(offset))


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).flatten().to_numpy().reshape(-1, len(NAMES))


def fit(rows: DataFrame, shrinkages: tuple[tuple[float, float], ...] = SHRINKAGES) -> Model:
    """rows: x, label (0 or 1), fold. Moments are summed where the rows are; the driver gets one vector a fold and class,
    and then one number a shrinkage."""
    d = len(NAMES)
    width = 1 + d + d * d
    rows = staged(rows.select("x", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold")), "training")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, width))
        for b in batches:
            x, y, fold = _rows(b), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in range(FOLDS):
                for k in (0, 1):
                    z = x[(y == k) & (fold == f)]
                    total[f, k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = np.zeros(FOLDS * 2 * width)
    for r in rows.mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        sums[r.i] = r.v
    sums = sums.reshape(FOLDS, 2, width)
    if sums.sum(0)[:, 0].min() < 2 or len(shrinkages) == 1:
        return model_of(sums.sum(0), *shrinkages[0])
    models = [[model_of(sums.sum(0) - sums[f], *s) for f in range(FOLDS)] for s in shrinkages]

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for b in batches:
            x, y, fold = _rows(b), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in np.unique(fold):
                at = fold == f
                for i, m in enumerate(models):
                    score = np.clip(m[f].score(x[at]), 1e-6, 1 - 1e-6)
                    total[i] -= np.log(np.where(y[at] == 1, score, 1 - score)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    got = {r.i: r.v for r in rows.mapInArrow(losses, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    best = min(range(len(models)), key=lambda i: (round(got[i], 6), i))
    return model_of(sums.sum(0), *shrinkages[best])


def _trained(x: DataFrame, labels: DataFrame, label_col: str) -> Model:
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.max(label_col).alias("label"))
    return fit(x.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_doc")).select("x", "label", fold_of(F.col("doc_id")).alias("fold")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    x = staged(vectors(docs, id_col, text_col), "vectors")
    model = _trained(x, labels, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.round(model.score(b.column(1).flatten().to_numpy().reshape(-1, len(NAMES))), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is predicted to be good, all columns unchanged; scored in place, so nothing is shuffled but vectors of training rows."""
    x = staged(vectors(docs), "vectors")
    model = _trained(x, labels, "quality")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.score(statistics(data, off)) >= 0.5 for _, _, data, off in slices(b.column(at))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
