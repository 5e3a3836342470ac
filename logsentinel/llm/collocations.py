"""Collocations: phrases whose words stand together more often than their parts would by chance.

Counts come from tries of at most ``longest`` words, grown a level at a time. A node is a phrase; its parent is the phrase
without its last word, its suffix link the phrase without its first. A phrase of d + 1 words is two nodes of depth d that
start one word apart, the first its parent and the second its suffix link, so the pair names it whatever the words are.

1. Each shard (task) turns its texts into slices: the different words of some texts of one language and the places at which
   they stand. It counts the words in a trie of its own, which is written sorted.
2. The tries of all shards are merged by ranges of prefixes, and nodes with fewer than ``least`` occurrences go: no longer
   phrase that holds one can be frequent.
3. The slices look up the nodes that stayed and line up neighbours: the pairs of the next level. Most are rare, so each shard
   first sums them by a hash into buckets; a pair of a bucket that stays below ``least`` in the sum over all shards can't be
   frequent. The others are counted in the shard's trie.

From the second level on there are as many shards as cores, so a frequent pair has a row a core, however many files the
texts fill, and the buckets can grow with the occurrences (one for eight, ``MOST_SUMS`` at most): sums of all shards stay in
proportion to the input. Walks from the root give the counts of left parts, chains of suffix links those of right parts.
Texts are read once; later passes read slices, which shrink with each level. Tables of nodes above ``NODES_BYTES`` are
joined, not broadcast.

Rows: a null or empty text has no words; a null lang counts as ``und``. Ids aren't read, and repeated rows count each time.
Empty tables give no rows. A text may be of any length: it is cut between pieces. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, remove, staged, written
from .tokens import U64, mix

#: Bytes of text in a slice (more only where a piece is longer), of texts that wait to be one, and words and pairs of a
#: shard's trie that are held before they are written.
SLICE_BYTES, WAITING_BYTES, TRIE_ROWS, PAIR_ROWS = 1 << 20, 8 << 20, 1 << 18, 1 << 20
#: Tables of nodes of more bytes are joined.
NODES_BYTES = 48 << 20
#: Buckets of pairs (powers of two), at least and at most, and of how many the sums travel together.
SUMS, MOST_SUMS, CHUNK = 1 << 20, 1 << 26, 1 << 16
#: Parts of a word's slices in such a join, and of a language's phrases in the first round of the ranking.
SALTS, SHARES = 16, 256

#: Bytes: 2 ends a piece, 1 parts words; A-Z lower-cased.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_WORD_PASS = "slice long, lang string, words string, seq binary, word string, n long"
_PAIR_PASS = "slice long, parents binary, links binary, counts binary, seq binary, chunk int, part int, sums binary"


def _places(data: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The different words of some text, and which of them stand where; -1 between pieces."""
    kind = _KIND[data]
    solid = kind == 0
    edge = np.diff(solid.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=off[1:])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(_LOWER[data[solid]])).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    new = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return words.dictionary, np.insert(words.indices.to_numpy(), new, -1)


def _slices(waiting: list[bytes]) -> Iterator[np.ndarray]:
    """Texts joined by the end of a piece, cut at ends of pieces."""
    data = np.frombuffer(b"\n".join(waiting), np.uint8)
    at = 0
    while at < len(data):
        to = at + SLICE_BYTES
        if to < len(data):
            ends = np.flatnonzero(_KIND[data[at:to]] == 2)
            if len(ends):
                to = at + int(ends[-1]) + 1
            else:
                while to < len(data) and not len(ends := np.flatnonzero(_KIND[data[to : to + SLICE_BYTES]] == 2)):
                    to += SLICE_BYTES
                to += int(ends[0]) + 1 if len(ends) else 0
        yield data[at:to]
        at = to


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _parts(schema: pa.Schema, size: int = 1 << 16, **columns) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(next(iter(columns.values()))), size):
        yield _rows(schema, **{k: v[at : at + size] for k, v in columns.items()})


class _WordTrie:
    """A shard's first level: words of each language and their counts."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.tables, self.rows = schema, [], 0

    def add(self, lang: str, words: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.tables.append(pa.table({"lang": pa.array([lang]).take(pa.array(np.zeros(len(words), np.int32))), "word": words, "n": n}))
        self.rows += len(words)
        if self.rows > TRIE_ROWS:
            self._merge()
            if self.rows > TRIE_ROWS // 2:
                yield from self.flush()

    def _merge(self) -> None:
        self.tables = [pa.concat_tables(self.tables).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])]
        self.rows = len(self.tables[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            self._merge()
            table = self.tables[0].sort_by([("lang", "ascending"), ("word", "ascending")]).combine_chunks()
            self.tables, self.rows = [], 0
            yield from _parts(self.schema, **{c: table.column(c).combine_chunks() for c in ("lang", "word", "n")})


class _PairTrie:
    """A shard's deeper level: (parent, suffix link) and their counts."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.held, self.rows = schema, [], 0

    def add(self, parent: np.ndarray, link: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((parent, link, n))
        self.rows += len(n)
        if self.rows > PAIR_ROWS:
            self._merge()
            if self.rows > PAIR_ROWS // 2:
                yield from self.flush()

    def _merge(self) -> None:
        parent, link, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        order = np.lexsort((link, parent))
        parent, link, n = parent[order], link[order], n[order]
        first = np.flatnonzero(np.append(True, (parent[1:] != parent[:-1]) | (link[1:] != link[:-1]))) if len(n) else np.zeros(0, np.int64)
        self.held = [(parent[first], link[first], np.add.reduceat(n, first) if len(n) else n)]
        self.rows = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            parent, link, n = self.held[0]
            self.held, self.rows = [], 0
            yield from _parts(self.schema, parent=pa.array(parent), link=pa.array(link), n=pa.array(n))


def _word_pass(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Slices of all texts, and the words of each shard's trie."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL")
    schema = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("words", pa.string()), ("seq", pa.binary()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        trie, waiting, size = _WordTrie(schema), {}, {}

        def emptied(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal uid
            for data in _slices(waiting.pop(lang)):
                words, seq = _places(data)
                if len(words):
                    yield _rows(schema, slice=pa.array([uid]), lang=pa.array([lang]), words=pa.array(["\n".join(words.to_pylist())]), seq=pa.array([seq.astype("<i4").tobytes()]))
                    uid += 1
                    yield from trie.add(lang, words, np.bincount(seq[seq >= 0], minlength=len(words)))
            size.pop(lang)

        for b in batches:
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text"), strict=True):
                data = text.as_buffer().to_pybytes()
                waiting.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data) + 1
                if size[lang] >= SLICE_BYTES:
                    yield from emptied(lang)
            while sum(size.values()) > WAITING_BYTES:
                yield from emptied(max(size, key=size.get))
        for lang in list(waiting):
            yield from emptied(lang)
        yield from trie.flush()

    return slim.mapInArrow(run, _WORD_PASS)


class _Words:
    """Look-up of words: nodes by language."""

    keys, sides = ["lang", "word"], ["lang", "words"]

    def __init__(self, table: pa.Table):
        self.by = {}
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            self.by[lang] = pa.concat_arrays(own.column("word").chunks), own.column("node").to_numpy()

    def find(self, row: dict) -> np.ndarray:
        words = pa.array(row["words"].split("\n"))
        if row["lang"] not in self.by:
            return np.full(len(words), -1)
        table, node = self.by[row["lang"]]
        at = pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy()
        return np.where(at >= 0, node[at], -1)

    @staticmethod
    def needs(slices: DataFrame) -> DataFrame:
        return slices.select("slice", "lang", F.posexplode(F.split("words", "\n")).alias("pos", "word"))

    @staticmethod
    def size(row: dict) -> int:
        return row["words"].count("\n") + 1


class _Pairs:
    """Look-up of pairs of nodes: nodes."""

    keys, sides = ["parent", "link"], ["parents", "links"]

    def __init__(self, table: pa.Table):
        parent, link, node = (table.column(c).to_numpy() for c in ("parent", "link", "node"))
        self.parents, p = np.unique(parent, return_inverse=True)
        self.links, s = np.unique(link, return_inverse=True)
        packed = p * len(self.links) + s
        order = np.argsort(packed)
        self.packed, self.node = packed[order], node[order]

    def find(self, row: dict) -> np.ndarray:
        p, p_in = _index(self.parents, np.frombuffer(row["parents"], "<i8"))
        s, s_in = _index(self.links, np.frombuffer(row["links"], "<i8"))
        at, there = _index(self.packed, p * len(self.links) + s)
        return np.where(p_in & s_in & there, self.node[at] if len(self.node) else -1, -1)

    @staticmethod
    def needs(slices: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    p, s = np.frombuffer(row["parents"], "<i8"), np.frombuffer(row["links"], "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), row["slice"])), pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p), pa.array(s)], names=["slice", "pos", "parent", "link"])

        return slices.select("slice", "parents", "links").mapInArrow(run, "slice long, pos int, parent long, link long")

    @staticmethod
    def size(row: dict) -> int:
        return len(row["parents"]) // 8


def _index(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _kind_of_sums(least: int) -> str:
    """Sums never pass least: a byte mostly."""
    return "<u1" if least < 1 << 8 else "<u2" if least < 1 << 16 else "<u4"


def _buckets(occurrences: int) -> int:
    """One for eight occurrences, within bounds."""
    return min(MOST_SUMS, max(SUMS, 1 << (max(occurrences, 1) // 8).bit_length()))


def _bucket(parent: np.ndarray, link: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(parent.view(U64)) ^ link.view(U64)) & U64(buckets - 1)).astype(np.int64)


def _add(total: np.ndarray, at: np.ndarray, n: np.ndarray, least: int) -> None:
    """Adds to the buckets that a slice has; none passes least."""
    order = np.argsort(at)
    at, n = at[order], n[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    at = at[first]
    total[at] = np.minimum(np.add.reduceat(n, first) + total[at], least)


def _by_core(df: DataFrame) -> DataFrame:
    """As many shards as cores, each reads its part of the slices one by one."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _lists(found: DataFrame) -> DataFrame:
    """The nodes of each slice as a row: (slice, _pos, _node). Rows are streamed in the order of the slices, so a task holds
    one slice's, where lists that Spark collects would be held for many slices at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def packed() -> pa.RecordBatch:
            pos, node = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([pos.tobytes()]), pa.array([node.tobytes()])], names=["slice", "_pos", "_node"])

        for b in batches:
            own, pos, node = (b.column(c).to_numpy() for c in ("slice", "pos", "node"))
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True) if len(own) else ():
                if held and own[lo] != key:
                    yield packed()
                    held = []
                key = int(own[lo])
                held.append((pos[lo:hi], node[lo:hi]))
        if held:
            yield packed()

    return found.select("slice", "pos", "node").repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice long, _pos binary, _node binary")


def _pair_pass(slices: DataFrame, nodes: DataFrame, kind: type[_Words] | type[_Pairs], limit: int, least: int) -> tuple[DataFrame, int]:
    """Neighbours in all slices whose nodes stayed, as new slices, and the shard's sums of them by bucket, none above least;
    and how many buckets there are."""
    spark = slices.sparkSession
    schema = pa.schema([("slice", pa.int64()), ("parents", pa.binary()), ("links", pa.binary()), ("counts", pa.binary()), ("seq", pa.binary()), ("chunk", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
    bytes_, seen = nodes.agg(F.count(F.lit(1)) * 24 + (F.coalesce(F.sum(F.octet_length("word")), F.lit(0)) if kind is _Words else F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent, buckets = None, _buckets(seen)
    slim = slices.select("slice", *kind.sides, "seq")
    if bytes_ <= limit:  # the look-up is made once, on the driver: its makings would be held by every worker
        sent = spark.sparkContext.broadcast(kind(nodes.select(*kind.keys, "node").toArrow()))
    else:  # a word that every slice has is dealt to SALTS tasks
        salt = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
        own = nodes.select(*kind.keys, "node", salt.alias("_salt"))
        found = kind.needs(slices).withColumn("_salt", F.pmod("slice", F.lit(SALTS)).cast("int")).join(own, [*kind.keys, "_salt"])
        slim = slim.join(_lists(found), "slice", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, look = None, TaskContext.get().partitionId() % SALTS, sent.value if sent else None
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in ("slice", *kind.sides)}
                if look:
                    node = look.find(row)
                else:
                    node = np.full(kind.size(row), -1)
                    if b.column("_pos")[i].is_valid:
                        node[np.frombuffer(b.column("_pos")[i].as_buffer(), "<i4")] = np.frombuffer(b.column("_node")[i].as_buffer(), "<i8")
                stays = node >= 0
                local = np.where(stays, np.cumsum(stays) - 1, -1)
                node = node[stays]
                seq = np.frombuffer(b.column("seq")[i].as_buffer(), "<i4")
                seq = np.where(seq >= 0, local[seq], -1)
                both = (seq[:-1] >= 0) & (seq[1:] >= 0)
                if not both.any():
                    continue
                pairs, places, n = np.unique(seq[:-1][both] * len(node) + seq[1:][both], return_inverse=True, return_counts=True)
                parent, link = node[pairs // len(node)], node[pairs % len(node)]
                total = np.zeros(buckets, _kind_of_sums(least)) if total is None else total
                _add(total, _bucket(parent, link, buckets), n, least)
                ahead = np.full(len(both), -1, "<i4")
                ahead[both] = places
                ahead = ahead[both | np.append(False, both[:-1])]  # one mark between runs is enough
                made = {"parents": parent.astype("<i8"), "links": link.astype("<i8"), "counts": n.astype("<i4"), "seq": ahead}
                yield _rows(schema, slice=b.column("slice")[i : i + 1], **{k: pa.array([v.tobytes()]) for k, v in made.items()})
        if total is not None:
            for k in range(0, buckets, CHUNK):
                if (own := total[k : k + CHUNK]).any():
                    yield _rows(schema, chunk=pa.array([k // CHUNK], pa.int32()), part=pa.array([part], pa.int32()), sums=pa.array([own.tobytes()]))

    return _by_core(slim).mapInArrow(run, _PAIR_PASS), buckets


def _heavy(sums: DataFrame, least: int, buckets: int = SUMS) -> np.ndarray:
    """Which buckets reach least in the sum over all shards: a bit each. Sums meet in two rounds, each streamed in the order
    of the chunks."""
    width = sums.sparkSession.sparkContext.defaultParallelism * 2

    def add(rows: DataFrame, *by: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, None
            for b in batches:
                for chunk, part, blob in zip(b.column("chunk").to_pylist(), b.column("part").to_pylist(), b.column("sums"), strict=True):
                    if (chunk, part) != key:
                        if key:
                            yield _summed(key, total, least)
                        key, total = (chunk, part), np.zeros(CHUNK, np.uint32)
                    total += np.frombuffer(blob.as_buffer(), _kind_of_sums(least))
                    np.minimum(total, least, out=total)
            if key:
                yield _summed(key, total, least)

        return rows.repartition(width, *by).sortWithinPartitions(*by).mapInArrow(run, "chunk int, part int, sums binary")

    once = add(sums.select("chunk", "part", "sums"), "chunk", "part")
    out = np.zeros(buckets, bool)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach = [np.packbits(np.frombuffer(x.as_buffer(), _kind_of_sums(least)) >= least).tobytes() for x in b.column("sums")]
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(reach, pa.binary())], names=["chunk", "bits"])

    for r in add(once.withColumn("part", F.lit(0)), "chunk").mapInArrow(bits, "chunk int, bits binary").toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.unpackbits(np.frombuffer(r.bits, np.uint8))
    return out


def _summed(key: tuple[int, int], total: np.ndarray, least: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.astype(_kind_of_sums(least)).tobytes()])], names=["chunk", "part", "sums"])


def _trie_pass(slices: DataFrame, heavy: np.ndarray) -> DataFrame:
    """The pairs of each shard's trie that may be frequent."""
    sent = slices.sparkSession.sparkContext.broadcast(np.packbits(heavy))
    schema = pa.schema([("parent", pa.int64()), ("link", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, may = _PairTrie(schema), sent.value
        for b in batches:
            for i in range(len(b)):
                parent, link, n = (np.frombuffer(b.column(c)[i].as_buffer(), k) for c, k in (("parents", "<i8"), ("links", "<i8"), ("counts", "<i4")))
                at = _bucket(parent, link, len(may) * 8)
                pick = (may[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                yield from trie.add(parent[pick], link[pick], n[pick].astype(np.int64))
        yield from trie.flush()

    return _by_core(slices.select("parents", "links", "counts")).mapInArrow(run, "parent long, link long, n long")


def _merged(trie: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """The shards' sorted tries merged by ranges of prefixes: nodes with at least so many occurrences, numbered."""
    whole = trie.repartitionByRange(*keys).sortWithinPartitions(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))
    kept = whole.where(F.col("n") >= least).sortWithinPartitions(*keys)
    return staged(kept.withColumn("node", F.monotonically_increasing_id()), name)  # the number is that of the written row


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", nodes_bytes: int = NODES_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to longest words, all phrases with at least so many occurrences: (node, lang, phrase, n, lefts, rights), lefts
    the counts of its first 1, 2, ... words and rights those of its last, and parent and link for more than one word; and
    all occurrences of words by lang, as (lang, all)."""
    spark = docs.sparkSession
    path = written(passed := _word_pass(docs, lang_col, text_col), "words", large_rows=True)
    done = spark.read.schema(passed.schema).parquet(path)
    words = done.where("word IS NOT NULL")
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("all")), "totals")
    nodes, kind = _merged(words.select("lang", "word", "n"), ["lang", "word"], least, "level1"), _Words
    known = staged(nodes.select("node", "lang", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("lefts"), F.array("n").alias("rights")), "known1")
    out = [known]
    for depth in range(2, longest + 1):
        passed, buckets = _pair_pass(done.where("seq IS NOT NULL"), nodes, kind, nodes_bytes, least)
        old, path = path, written(passed, f"pairs{depth}", large_rows=True)
        remove(spark, old)  # nothing reads the slices before these again
        done = spark.read.schema(passed.schema).parquet(path)
        heavy = _heavy(done.where("sums IS NOT NULL"), least, buckets)
        tries = written(passed := _trie_pass(done.where("seq IS NOT NULL"), heavy), f"tries{depth}")
        nodes, kind = _merged(spark.read.schema(passed.schema).parquet(tries), ["parent", "link"], least, f"level{depth}"), _Pairs
        remove(spark, tries)
        parent = known.select(F.col("node").alias("parent"), "lang", F.col("phrase").alias("_before"), F.col("lefts").alias("_lefts"))
        link = known.select(F.col("node").alias("link"), "last", F.col("rights").alias("_rights"))
        joined = nodes.join(parent, "parent").join(link, "link")
        known = staged(joined.select(
            "node", "lang", "n", F.concat_ws(" ", "_before", "last").alias("phrase"), "last", F.concat("_lefts", F.array("n")).alias("lefts"), F.concat("_rights", F.array("n")).alias("rights"), "parent", "link",
        ), f"known{depth}")
        out.append(known)
    remove(spark, path)
    return out, totals


def _weakest_cut(depth: int) -> str:
    """The cut with the lowest score, then the shortest left part: (score, k, l, r). Decimals hold products of 38 digits."""
    cut = "named_struct('score', (1000BD * CAST(n AS DECIMAL(19,0)) * CAST(all AS DECIMAL(19,0))) div (CAST(lefts[{0}] AS DECIMAL(19,0)) * CAST(rights[{1}] AS DECIMAL(19,0))), 'k', {2}, 'l', lefts[{0}], 'r', rights[{1}])"
    return f"array_min(array({', '.join(cut.format(k - 1, depth - k - 1, k) for k in range(1, depth))}))"


def mine(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, lang_col: str = "lang", text_col: str = "text", nodes_bytes: int = NODES_BYTES) -> DataFrame:
    """Each lang's first ``most`` phrases of 2 to longest words: (lang, rank, phrase, a, l, r, n, score)."""
    found, totals = phrases(docs, least, longest, lang_col, text_col, nodes_bytes)
    parts = []
    for depth, own in enumerate(found[1:], 2):
        if depth < longest:  # a longer phrase that always goes with this one is one word longer, or holds one that is
            longer = found[depth]
            inside = longer.select(F.col("parent").alias("node"), "n").union(longer.select(F.col("link").alias("node"), "n")).distinct()
            own = own.join(inside, ["node", "n"], "left_anti")
        scored = own.join(totals, "lang").withColumn("_cut", F.expr(_weakest_cut(depth)))
        parts.append(scored.select("lang", "phrase", F.col("n").alias("a"), "_cut.l", "_cut.r", F.col("all").alias("n"), F.col("_cut.score").cast("long").alias("score")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = share.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_place") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: All phrases of all lengths counted plainly.
ORACLE = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
line AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM line),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM place, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a FROM gram WHERE m > 1 AND f >= 100),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y FROM cand, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
part AS (SELECT cut.*, p.f AS l, q.f AS r, total.n, ((1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f))::BIGINT AS score FROM cut JOIN gram p ON p.lang = cut.lang AND p.phrase = x JOIN gram q ON q.lang = cut.lang AND q.phrase = y JOIN total ON total.lang = cut.lang),
low AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = low.lang AND c.m > low.m AND c.a >= low.a AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""
