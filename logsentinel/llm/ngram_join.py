"""N-gram Jaccard self-join with multiple global token orders.

A document's set is its distinct word shingles. Two documents link when 100 * intersection >= threshold * union.

* Equal sets form a class first (by size and two 64-bit sums of token hashes); the rest works on one of each class.
* Filter. Under a global order of all tokens (a hash of the token) similar sets tend to have the same first token.
  ``ORDERS`` orders are intersected: a candidate shares its prefix token under all of them at once. Such filters with orders
  of their own are united, as many as it takes (``trials``) that a pair at the threshold passes none of them with
  probability under ``MISS``: 20 at 0.9, 37 at 0.8; sets that merely share a passage rarely pass one. A longer prefix under
  a single order would be certain, but then every pair that shares a few words by chance passes (figures in the README).
* Candidates of one filter value are not paired: each is joined to the smallest of them, and the components of that
  graph are the clusters in which links can be.
* Verification. The sets of a cluster are dealt in blocks of bounded size to one task for each two blocks, which counts
  all their intersections exactly through an inverted index of the block. A task returns a spanning forest of
  its links and the number of links of each set, never the pairs.

Defined cases: null or wordless text has an empty set and links to nothing; fewer words than a shingle are one token;
rows that repeat a doc_id are one node, whatever their texts; null doc_ids are one node, the smallest; component_id is the
smallest doc_id reachable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import Lookup, find, prepared
from .storage import free_name, staged
from .tokens import U64, Rolling, mix, signed, slices, word_bounds, word_hashes

ORDERS, MISS = 3, 5e-12
BLOCK_TOKENS = 64_000
NULL_ID = -(1 << 63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice: rows from and to, the tokens of all its rows (not distinct), and where each row's begin."""
    for lo, hi, data, off in slices(col):
        data = _LOWER[data]
        start, end, first = word_bounds(data, off)
        words = word_hashes(data, start, end)
        count = np.diff(first)
        size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(first[:-1], size)
        to = np.minimum(at + n, np.repeat(first[1:], size))
        yield lo, hi, Rolling(words).ranges(at, to), begin


def trials(threshold: int) -> int:
    """How many filters are united."""
    share = (threshold / 100) ** ORDERS
    return 1 if share == 1 else math.ceil(math.log(MISS) / math.log(1 - share))


def _profile(tokens: np.ndarray, begin: np.ndarray, filters: int):
    """For each row: number of distinct tokens, two sums of them, and its filter values (filters of them, flat)."""
    n = len(begin) - 1
    size, sums = np.zeros(n, np.int64), np.zeros((2, n), U64)
    for i in np.flatnonzero(np.diff(begin)):
        t = np.unique(tokens[begin[i] : begin[i + 1]])
        size[i] = len(t)
        sums[0, i], sums[1, i] = t.sum(dtype=U64), mix(t).sum(dtype=U64)
    full = np.flatnonzero(size)
    keys = np.zeros((n, filters), U64)
    seed = mix(np.arange(1, ORDERS * filters + 1, dtype=U64)) | U64(1)
    for k in range(filters):
        for j in range(ORDERS):
            rank = tokens * seed[k * ORDERS + j]
            rank ^= rank >> U64(31)
            rank *= U64(0x9E3779B97F4A7C15)
            if len(full):
                keys[full, k] = mix(keys[full, k] + np.minimum.reduceat(rank, begin[full]) + U64(k + 1))
    return size, sums, keys


def _links(doc: np.ndarray, weight: np.ndarray, size: np.ndarray, tokens: np.ndarray, half: np.ndarray, cross: bool, threshold: int):
    """Exact links between the sets of a block, or (cross) between its two halves: spanning forest and counts."""
    begin = np.concatenate([[0], np.cumsum(size)])
    _, ids = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(len(doc)), size)
    by_token = np.argsort(ids, kind="stable")
    post, edge = owner[by_token], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    parent = np.arange(len(doc))
    links = np.zeros(len(doc), np.int64)
    forest = []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(doc)):
        mine = ids[begin[i] : begin[i + 1]]
        n = edge[mine + 1] - edge[mine]
        if n.sum() == len(mine):
            continue
        at = np.repeat(edge[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(post[at], minlength=len(doc))
        linked = 100 * both >= threshold * (size + size[i] - both)
        linked[: i + 1] = False
        if cross:
            linked &= half != half[i]
        for j in np.flatnonzero(linked):
            links[i] += weight[j]
            links[j] += weight[i]
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((doc[i], doc[j]))
    return forest, links


def join(docs: DataFrame, n: int = 3, threshold: int = 90, broadcast_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked directly) for every row of docs."""
    src = prepared(docs, id_col, text_col).withColumn("_key", F.xxhash64("_id", "_text"))
    filters = trials(threshold)

    def profile(batches):
        for b in batches:
            for lo, hi, tokens, begin in _sets(b.column("_text"), n):
                size, sums, keys = _profile(tokens, begin, filters)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, filters, dtype=np.int32)), signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(lo, hi - lo).fill_null(NULL_ID), b.column("_key").slice(lo, hi - lo), pa.array(size), signed(sums[0]), signed(sums[1]), flat], names=["doc", "key", "size", "s1", "s2", "keys"])

    rows = staged(src.mapInArrow(profile, "doc long, key long, size long, s1 long, s2 long, keys array<long>"), "profiles")
    same = ["size", "s1", "s2"]
    full = rows.where("size > 0")
    classes = staged(full.groupBy(*same).agg(F.min(F.struct("doc", "key")).alias("rep"), F.count(F.lit(1)).alias("members")).select(*same, "rep.doc", "rep.key", "members"), "classes")
    reps = full.join(classes.select(F.col("key").alias("_key")), F.col("key") == F.col("_key")).select(F.col("key").alias("node"), "keys")
    values = reps.select("node", F.posexplode("keys").alias("trial", "token"))
    first = values.groupBy("trial", "token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("trial", "token", "least")
    near = values.join(first, ["trial", "token"]).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    held = components(near).select("node", F.col("root").alias("part"))

    def keys_of(b, _entries, _step):
        return np.arange(b.num_rows), b.column("_key").to_numpy().view(U64)

    def chosen(b, table):
        """The rows of a batch whose key the table has: key, set, and place in the table."""
        keys = b.column("_key").to_numpy()
        has, at = find(table["key"], keys.view(U64))
        keys, at = keys[has], at[has]
        for lo, _, tokens, begin in _sets(b.column("_text").filter(pa.array(has)), n):
            for i in range(len(begin) - 1):
                yield int(keys[lo + i]), np.unique(tokens[begin[i] : begin[i + 1]]), int(at[lo + i])

    member = held.join(classes, held["node"] == classes["key"]).select("node", "part", "size", "members")
    volume = member.groupBy("part").agg(F.sum("size").alias("volume")).withColumnRenamed("part", "_part")
    member = member.join(volume, member["part"] == F.col("_part")).select(F.col("node").alias("key"), F.col("part").alias("root"), F.ceil(F.col("volume") / BLOCK_TOKENS).cast("long").alias("blocks"), "members", "size")
    wanted = Lookup(member, "members", broadcast_rows)
    work = wanted.table.agg(F.sum(F.col("size") * F.col("blocks")).alias("n")).first()["n"] or 0
    width = max(docs.sparkSession.sparkContext.defaultParallelism, work // (4 * BLOCK_TOKENS))

    def fetch(b, table):
        out = {k: [] for k in ("root", "x", "y", "half", "doc", "weight", "size", "tokens")}
        for key, t, k in chosen(b, table):
            blocks = int(table["blocks"][k])
            block = int(mix(np.array([key], np.int64).view(U64))[0] % U64(blocks))
            blob = t.tobytes()
            for other in range(blocks):
                x, y = min(block, other), max(block, other)
                for c, v in zip(out, (int(table["root"][k]), x, y, int(block == y), key, int(table["members"][k]), len(t), blob), strict=True):
                    out[c].append(v)
                if len(out["root"]) >= 1000:
                    yield _batch(out)
                    out = {k: [] for k in out}
        if out["root"]:
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "tokens" else pa.int64()) for c, v in out.items()], names=list(out))

    dealt = wanted.run(src, fetch, keys_of, "root long, x long, y long, half long, doc long, weight long, size long, tokens binary")
    dealt = dealt.repartition(width, "root", "x", "y").sortWithinPartitions("root", "x", "y")

    def verify(batches):
        def blocks():
            key, held = None, []
            for b in batches:
                cols = [b.column(c).to_numpy() for c in ("root", "x", "y")]
                change = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if b.num_rows else []
                for i, to in zip(change, [*change[1:], b.num_rows], strict=True):
                    now = tuple(int(c[i]) for c in cols)
                    if now != key and held:
                        yield key, held
                        held = []
                    key = now
                    held.append(b.slice(i, to - i))
            if held:
                yield key, held

        for (_, x, y), parts in blocks():
            t = pa.Table.from_batches(parts)
            t = t.take(np.unique(t.column("doc").to_numpy(), return_index=True)[1])  # of rows that repeat an id and a text one
            doc, weight, size, half = (t.column(c).to_numpy() for c in ("doc", "weight", "size", "half"))
            tokens = np.frombuffer(b"".join(t.column("tokens").to_pylist()), U64)
            forest, links = _links(doc, weight, size, tokens, half, x != y, threshold)
            a, b = ([f[k] for f in forest] for k in (0, 1))
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([*a, *doc[has]], pa.int64()), pa.array([*b, *doc[has]], pa.int64()), pa.array([0] * len(a) + links[has].tolist(), pa.int64())], names=["a", "b", "links"])

    found = staged(dealt.mapInArrow(verify, "a long, b long, links long"), "links")
    edges = found.where("a <> b").select("a", "b")
    shared = full.groupBy("doc").agg(F.min(F.struct(*same)).alias("one"), F.max(F.struct(*same)).alias("other")).where("one <> other").select("doc")
    if not shared.isEmpty():  # several texts under one id
        by_text = full.join(shared, "doc").join(classes.select(*same, F.col("key").alias("node")), same).select("doc", "node")
        edges = edges.union(by_text.join(by_text.groupBy("doc").agg(F.min("node").alias("a")), "doc").where("a <> node").select("a", F.col("node").alias("b")))
    roots = components(edges)
    links = found.where("a = b").groupBy(F.col("a").alias("_doc")).agg(F.sum("links").alias("_links"))
    linked = classes.join(roots, classes["key"] == roots["node"]).select("key", "root", "doc")
    least = linked.groupBy("root").agg(F.min("doc").alias("_root"))
    linked = linked.join(least, "root").select(F.col("key").alias("_key"), "_root")
    info = classes.join(linked, F.col("key") == F.col("_key"), "left").join(links, F.col("key") == F.col("_doc"), "left")
    info = info.select(*(F.col(c).alias(f"_{c}") for c in same), F.coalesce("_root", "doc").alias("_root"), (F.coalesce("_links", F.lit(0)) + F.col("members") - 1).alias("_n"))
    every = rows.select("doc", *same)
    out = every.join(info, (every["size"] == info["_size"]) & (every["s1"] == info["_s1"]) & (every["s2"] == info["_s2"]), "left")
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(real(F.col("doc")).alias("doc_id"), F.col("size").alias("n_shingles"), real(F.coalesce("_root", "doc")).alias("component_id"), F.coalesce("_n", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows that repeat a doc_id stay or go together.
    Near duplicates share 80 of 100 five-word shingles."""
    found = join(docs, n, threshold).where("component_id is distinct from doc_id").select("doc_id").distinct()
    gone = staged(found, "copies").withColumnRenamed("doc_id", free_name(docs, "gone"))
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
