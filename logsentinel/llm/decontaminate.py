"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

1. Inverse document frequencies of hashed words, over all passages (blocks of words) of all documents.
2. A randomised SVD of the TF-IDF passages, over the terms of the benchmark: one distributed pass accumulates
   Y = A'A * Omega for a random Omega; the small factorisation of (Omega, Y) on the driver gives the leading right
   singular vectors. The benchmark's own passages are rows of A too, weighted to carry as much as the corpus.
3. Each document is searched whole: windows of three sizes whose TF-IDF mass lies in benchmark terms are folded into
   the latent space and compared with the items by cosine; half of a candidate's mass must be words of the item.
   Items of fewer than ``SHORT`` words may fill too little of any window. They are looked up too by their heaviest terms:
   a place that holds the share of the item's mass holds one of them, so each such place is a candidate.
4. Around each candidate the longest common subsequence with the item must reach ``lcs`` of the item's words, and the
   item's answer (its last sentence, or what follows its question) must be there too, so paraphrases and edits are caught
   while chance likeness is not. Of an item of fewer than ``SHORT`` words all words must be there in order, with a quarter
   as many others between them at most; one of a word or two proves nothing inside a text, so that it only matches texts
   that are nothing else.

The benchmark is a stated query set: it goes out in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS``
characters, as many of them at once as ``LOT_BYTES`` hold, each against all documents: one pass for Y and one search a lot.
Y is summed in levels of ``FAN`` parts before it reaches the driver, parts by number of the task and in its order, so
tasks that run again give the same parts and reruns the same sums.
Defined cases: null and empty texts match nothing; items without words match nothing; equal items are reported each;
rows that repeat a doc_id are searched each and reported once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import prepared
from .storage import free_name, staged
from .tokens import IS_SPACE, U64, slices, word_bounds, word_hashes

#: So a block's dense item-term table stays under some 70 MB.
BLOCK_ITEMS, BLOCK_CHARS = 500, 200_000
#: Bytes of the dense tables of the blocks that one pass takes along.
LOT_BYTES = 150_000_000
FAN = 64
BUCKET_BITS = 16
PASSAGE = 32
SIZES = (12, 24, 48)
SHORT = 14  # words from which an item holds a whole window of the smallest size, wherever it stands
RANK, EXTRA = 48, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PARTS = IS_SPACE.copy()
_PARTS[[ord(c) for c in ".,;:!?\"'()[]{}<>|*#$%&"]] = True


def _words(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, off in slices(col):
        data = _LOWER[data]
        start, end, first = word_bounds(data, off, _PARTS)
        yield lo, hi, word_hashes(data, start, end), first


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _passages(first: np.ndarray) -> np.ndarray:
    """For each word, its passage: blocks of PASSAGE words that don't cross documents."""
    n = np.diff(first)
    inner = np.arange(first[-1]) - np.repeat(first[:-1], n)
    new = inner % PASSAGE == 0
    return np.cumsum(new) - 1


def frequencies(src: DataFrame) -> tuple[np.ndarray, float]:
    """Inverse document frequency for each bucket; number of passages."""
    buckets = 1 << BUCKET_BITS

    def count(batches):
        total, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for _, _, words, first in _words(b.column("_text")):
                # a row of at most PASSAGE buckets for each passage, sorted, so that repeats stand together
                size = np.diff(first)
                parts = -(-size // PASSAGE)
                inner = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PASSAGE
                begin = np.repeat(first[:-1], parts) + inner
                last = np.minimum(PASSAGE, np.repeat(size, parts) - inner) - 1
                bucket = _bucket(words).astype(np.uint16)
                for lo in range(0, len(begin), 8192):
                    at = begin[lo : lo + 8192, None] + np.minimum(np.arange(PASSAGE), last[lo : lo + 8192, None])
                    row = np.sort(bucket[at], axis=1)
                    new = np.ones(row.shape, bool)
                    new[:, 1:] = row[:, 1:] != row[:, :-1]
                    total += np.bincount(row[new], minlength=buckets)
                n += len(begin)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    got = src.select("_text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(buckets)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    whole = float(n[bucket < 0].sum())
    return np.log((whole + 1) / (df + 1)) + 0.1, whole


@dataclass
class Query:
    """A block of the benchmark, as it is sent to the tasks."""

    idf: np.ndarray
    terms: np.ndarray  # sorted hashes of the block's words
    weight: np.ndarray  # idf of each term
    ids: list[int]
    items: list[list[int]]  # word hashes
    answers: list[set[int]]
    vectors: np.ndarray  # (items, terms) TF-IDF, unit length
    basis: np.ndarray | None = None  # (terms, rank)
    latent: np.ndarray | None = None  # (items, rank), unit length
    short: list[tuple[int, np.ndarray, np.ndarray]] | None = None  # item, its terms (heaviest first), their shares of its mass


def _hash_text(text: str) -> list[int]:
    got = [w for _, _, w, _ in _words(pa.array([text], pa.string()))]
    return got[0].tolist() if got else []


def answer_of(text: str) -> str:
    """What follows the last question mark, else the last sentence."""
    text = text.strip()
    if "?" in text and text.rsplit("?", 1)[1].strip():
        return text.rsplit("?", 1)[1]
    parts = [p for p in text.replace("!", ".").split(".") if p.strip()]
    return parts[-1] if parts else text


def query_of(rows: list[tuple[int, str]], idf: np.ndarray) -> Query:
    rows = [(i, t) for i, t in rows if t and _hash_text(t)]
    items = [_hash_text(t) for _, t in rows]
    terms = np.unique(np.array([w for x in items for w in x], U64)) if items else np.zeros(0, U64)
    weight = idf[_bucket(terms)] if len(terms) else np.zeros(0)
    vectors = np.zeros((len(items), len(terms)), np.float32)
    for k, x in enumerate(items):
        np.add.at(vectors[k], np.searchsorted(terms, np.array(x, U64)), 1)
    vectors *= weight
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Query(idf, terms, weight.astype(np.float32), [i for i, _ in rows], items, [set(_hash_text(answer_of(t))) for _, t in rows], vectors)


def _short_items(q: Query) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for k, x in enumerate(q.items):
        if len(x) < SHORT:
            term = np.searchsorted(q.terms, np.unique(np.array(x, U64)))
            mass = q.weight[term].astype(np.float64) ** 2
            order = np.argsort(-mass, kind="stable")
            out.append((k, term[order], mass[order] / mass.sum()))
    return out


def _known(q: Query, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(q.terms, words), len(q.terms) - 1)
    return q.terms[at] == words, at


def singular_vectors(src: DataFrame, queries: list[Query], rank: int = RANK) -> list[np.ndarray]:
    """For each block, leading right singular vectors of the TF-IDF passages over its terms: (terms, rank), orthonormal."""
    omegas = []
    for q in queries:
        n = len(q.terms)
        omegas.append(np.random.default_rng(7).standard_normal((n, min(rank + EXTRA, n))).astype(np.float32))
    sent = src.sparkSession.sparkContext.broadcast((queries, omegas))
    names = ["block", "task", "part"]

    def project(batches):
        queries, omegas = sent.value
        totals = [np.zeros(o.shape) for o in omegas]
        for b in batches:
            for _, _, words, first in _words(b.column("_text")):
                if len(words):
                    passages = _passages(first)
                    for q, omega, total in zip(queries, omegas, totals, strict=True):
                        _project(q, omega, words, passages, total)
        task = TaskContext.get().partitionId()
        for k, total in enumerate(totals):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=names)

    def add(batches):
        key, total = None, None
        for b in batches:
            for block, task, part in zip(*(b.column(c) for c in names), strict=True):
                now, x = (block.as_py(), task.as_py() // FAN), np.frombuffer(part.as_buffer(), np.float32)
                if now != key and key is not None:
                    yield _part(key, total, names)
                    total = None
                key, total = now, x.astype(np.float64) if total is None else total + x
        if key is not None:
            yield _part(key, total, names)

    parts = src.select("_text").mapInArrow(project, "block long, task long, part binary")
    for _ in range(2):
        parts = parts.repartition("block", F.floor(F.col("task") / FAN)).sortWithinPartitions("block", "task").mapInArrow(add, "block long, task long, part binary")
    sums = [np.zeros(o.shape) for o in omegas]
    for r in parts.orderBy("block", "task").toLocalIterator():
        sums[r.block] += np.frombuffer(r.part, np.float32).reshape(sums[r.block].shape)
    return [_basis(q, omega, y, rank) for q, omega, y in zip(queries, omegas, sums, strict=True)]


def _part(key, total, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=names)


def _project(q: Query, omega: np.ndarray, words: np.ndarray, passages: np.ndarray, total: np.ndarray) -> None:
    """Adds A'A * omega of the passages of a slice to total (but for the weight of each term)."""
    has, at = _known(q, words)
    term, passage = at[has], passages[has]
    if not len(term):
        return
    scaled = omega * q.weight[:, None]
    norm = np.sqrt(np.bincount(passage, q.weight[term] ** 2))
    edge = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    z = np.zeros((int(passage[-1]) + 1, omega.shape[1]), np.float32)
    for k in range(0, len(edge), 20_000):
        lo, hi = edge[k], edge[k + 20_000] if k + 20_000 < len(edge) else len(term)
        z[passage[edge[k : k + 20_000]]] = np.add.reduceat(scaled[term[lo:hi]], edge[k : k + 20_000] - lo, axis=0)
    z /= np.maximum(norm, 1e-9)[:, None] ** 2  # both sides of A'A
    order = np.argsort(term, kind="stable")
    t, p = term[order], passage[order]
    for lo in range(0, len(t), 200_000):
        block = t[lo : lo + 200_000]
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        total[block[cut]] += np.add.reduceat(z[p[lo : lo + 200_000]], cut, axis=0)


def _basis(q: Query, omega: np.ndarray, y: np.ndarray, rank: int) -> np.ndarray:
    y = y * q.weight[:, None]
    own = q.vectors.T @ (q.vectors @ omega)
    y = y / max(np.linalg.norm(y), 1e-9) + own / max(np.linalg.norm(own), 1e-9)
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > 1e-7 * max(value.max(), 1e-30)
    left, _, _ = np.linalg.svd(y @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    return np.ascontiguousarray(left[:, :rank], dtype=np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the rows of its table as bits of an integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = where.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


def stands_in_order(item: list[int], region: list[int]) -> int:
    """Where a stretch of the region begins that holds all words of the item in order and few others; -1 if none does."""
    most = len(item) + len(item) // 4
    for i, x in enumerate(region[: max(0, len(region) - len(item) + 1)]):
        if x == item[0]:
            k = 1
            for y in region[i + 1 : i + most]:
                if k < len(item) and y == item[k]:
                    k += 1
            if k == len(item):
                return i
    return -1


def _search(q: Query, words: np.ndarray, lo: int, hi: int, has, at, mass, gate: float, cosine: float, share: float):
    """Candidates (item, word position) among the windows of one slice; lo, hi: first and end word of each window."""
    inside, whole = mass[0][hi] - mass[0][lo], mass[1][hi] - mass[1][lo]
    pick = np.flatnonzero(inside >= gate * np.maximum(whole, 1e-9))
    for part in range(0, len(pick), 20_000):
        w = pick[part : part + 20_000]
        a, n = lo[w], (hi - lo)[w]
        tok = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        win = np.repeat(np.arange(len(w)), n)
        keep = has[tok]
        term, win = at[tok[keep]], win[keep]
        edge = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
        x = np.zeros((len(w), q.basis.shape[1]), np.float32)
        x[win[edge]] = np.add.reduceat(q.basis[term] * q.weight[term][:, None], edge, axis=0)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        row, item = np.nonzero(x @ q.latent.T >= cosine)
        if not len(row):
            continue
        first = np.searchsorted(win, np.arange(len(w) + 1))
        size = (first[row + 1] - first[row]).astype(np.int64)
        flat = np.repeat(first[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.repeat(np.arange(len(row)), size)
        held = np.bincount(pair, q.weight[term[flat]] ** 2 * (q.vectors[item[pair], term[flat]] > 0), len(row))
        good = held >= share * whole[w[row]]
        yield from zip(item[good].tolist(), a[row[good]].tolist(), strict=True)


def _look_up(q: Query, words: np.ndarray, first: np.ndarray, has, at, share: float):
    """Candidates (item, row, first and end word) of the short items: places with ``share`` of the item's mass."""
    if not q.short:
        return
    anchors = []
    for _, term, mass in q.short:  # without these terms less than the share is left
        rest = 1 - np.cumsum(mass)
        anchors.append(term[: int(np.argmax(rest < share - 1e-9)) + 1])
    wanted = np.zeros(len(q.terms), bool)
    wanted[np.concatenate(anchors)] = True
    pos = np.flatnonzero(has)
    pos = pos[wanted[at[pos]]]
    pos = pos[np.argsort(at[pos], kind="stable")]
    held = at[pos]
    term_at = np.where(has, at, -1)
    for (item, term, mass), anchor in zip(q.short, anchors, strict=True):
        lo, hi = np.searchsorted(held, anchor), np.searchsorted(held, anchor, side="right")
        if not (hi - lo).sum():
            continue
        places = np.sort(np.concatenate([pos[a:b] for a, b in zip(lo, hi, strict=True)]))
        m = len(q.items[item])
        reach = m + m // 4
        for part in range(0, len(places), 20_000):
            p = places[part : part + 20_000]
            row = np.searchsorted(first, p, side="right") - 1
            a, z = np.maximum(first[row], p - reach + 1), np.minimum(first[row + 1], p + reach)
            span = a[:, None] + np.arange(2 * reach - 1)
            near = np.where(span < z[:, None], term_at[np.minimum(span, len(words) - 1)], -1)
            mine = sum(w * (near == t).any(axis=1) for t, w in zip(term, mass, strict=True))
            good = np.flatnonzero(mine >= share - 1e-9)
            yield from zip([item] * len(good), row[good].tolist(), a[good].tolist(), z[good].tolist(), strict=True)


def find(docs: DataFrame, benchmark: DataFrame, lcs_share: float = 0.6, gate: float = 0.6, cosine: float = 0.5, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, lcs (share of the item's words), start (word) of the best match: one row a leaking pair."""
    src = prepared(docs, id_col, text_col)
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, lcs double, start long"
    out = spark.createDataFrame([], schema)
    idf = None
    for lot in _lots(benchmark):
        if idf is None:
            idf, _ = frequencies(src)
        queries = [q for q in (query_of(block, idf) for block in lot) if q.items]
        if not queries:
            continue
        for q, basis in zip(queries, singular_vectors(src, queries), strict=True):
            q.basis = basis
            latent = q.vectors @ basis
            q.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
            q.short = _short_items(q)
        out = out.union(_matches(src, spark.sparkContext.broadcast(queries), schema, lcs_share, gate, cosine, share))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", (-F.col("start")).alias("s"))).alias("m")).select("doc_id", "item_id", "m.lcs", (-F.col("m.s")).alias("start"))


def _lots(benchmark: DataFrame) -> Iterator[list[list[tuple[int, str]]]]:
    """Blocks of the benchmark, as many together as LOT_BYTES hold of their tables of items by words."""
    lot, held = [], 0
    for block in _blocks(benchmark):
        size = 4 * len(block) * sum(len(t) for _, t in block) // 6  # a word, and so a term at most, for each six characters
        if lot and held + size > LOT_BYTES:
            yield lot
            lot, held = [], 0
        lot.append(block)
        held += size
    if lot:
        yield lot


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or chars + len(r.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    if block:
        yield block


def _best(q: Query, words: np.ndarray, first: np.ndarray, lcs_share: float, gate: float, cosine: float, share: float) -> dict[tuple[int, int], tuple[float, int]]:
    """The best match of each item in each row of a slice: its share of the item's words, and minus its place."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    has, at = _known(q, words)
    square = q.idf[_bucket(words)] ** 2
    mass = [np.concatenate([[0], np.cumsum(np.where(has, square, 0))]), np.concatenate([[0], np.cumsum(square)])]
    seen = set()

    def look(row, item, a, z):
        region, m = words[a:z].tolist(), len(q.items[item])
        if m < SHORT:
            i = stands_in_order(q.items[item], region)
            if i >= 0 and (m > 2 or first[row + 1] - first[row] == m):
                best[row, item] = max(best.get((row, item), (0.0, 0)), (1.0, -int(a + i - first[row])))
            return
        got = lcs(q.items[item], region) / len(q.items[item])
        answer = q.answers[item]
        if got >= lcs_share and (not answer or 2 * len(answer & set(region)) >= len(answer)):
            best[row, item] = max(best.get((row, item), (0.0, 0)), (got, -int(a - first[row])))

    for item, row, a, z in _look_up(q, words, first, has, at, share):
        look(row, item, a, z)
    n = np.diff(first)
    for size in SIZES:
        step = size // 4
        count = np.where(n > 0, np.maximum(n - size, 0) // step + 1 + (np.maximum(n - size, 0) % step > 0), 0)
        doc = np.repeat(np.arange(len(n)), count)
        inner = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
        begin = first[doc] + np.minimum(inner, np.maximum(n[doc] - size, 0))
        end = np.minimum(begin + size, first[doc + 1])
        for item, pos in _search(q, words, begin, end, has, at, mass, gate, cosine, share):
            row = int(np.searchsorted(first, pos, side="right")) - 1
            m = len(q.items[item])
            slack = m // 4  # one look serves all windows that begin within it
            where = (row, item, pos // max(1, slack))
            if where not in seen:
                seen.add(where)
                look(row, item, max(first[row], pos - m - slack), min(first[row + 1], pos + size + m + slack))
    return best


def _matches(src: DataFrame, sent, schema: str, lcs_share: float, gate: float, cosine: float, share: float) -> DataFrame:
    def search(batches):
        for b in batches:
            ids, rows = b.column("_id").to_pylist(), []
            for lo, _, words, first in _words(b.column("_text")):
                if len(words):
                    for q in sent.value:
                        best = _best(q, words, first, lcs_share, gate, cosine, share)
                        rows += [(ids[lo + row], q.ids[item], got, -start) for (row, item), (got, start) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "lcs", "start"])

    return src.mapInArrow(search, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item; rows that repeat a doc_id go together."""
    bad = staged(find(docs, benchmark).select("doc_id").distinct(), "leaks").withColumnRenamed("doc_id", free_name(docs, "leak"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad.columns[0]]), "left_anti")
