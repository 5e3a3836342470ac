"""Hashes of words and ranges: against Python's integers, and on the sequences that collide modulo a power of two."""

import numpy as np
import pytest

from logsentinel.llm import tokens as t


def morse(n):
    return np.array([bin(i).count("1") & 1 for i in range(n)])


def test_modular_arithmetic():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, t._P, 100_000, dtype=np.uint64) for _ in range(2))
    a[:4], b[:4] = [0, t._P - 1, t._P - 1, 1], [5, t._P - 1, 1, t._P - 1]
    assert t._times(a, b).tolist() == [x * y % t._P for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    total, want = 0, [0]
    for x in a[:5000].tolist():
        total = (total + x) % t._P
        want.append(total)
    assert t._sums(a[:5000]).tolist() == want
    assert t._powers(t._BASE, 300).tolist() == [pow(t._BASE, i, t._P) for i in range(300)]


@pytest.mark.parametrize("kind", [t.Rolling, t.RollingBytes])
def test_ranges(kind):
    r = np.random.default_rng(2)
    data = np.tile(r.integers(0, 256, 50), 8).astype(np.uint8 if kind is t.RollingBytes else np.uint64)
    roll = kind(data)
    start = r.integers(0, 300, 4000)
    end = start + r.integers(0, 100, 4000)
    by = {}
    for h, s, e in zip(roll.ranges(start, end).tolist(), start, end, strict=True):
        by.setdefault(h, set()).add(data[s:e].tobytes())
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({data[s:e].tobytes() for s, e in zip(start, end, strict=True)})
    grams = roll.grams(7)
    assert len(grams) == 394 and len(set(grams.tolist())) == 50 and roll.grams(500).tolist() == []
    assert kind(data[:0]).grams(1).tolist() == []


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_sequences_made_to_collide(n):
    m = morse(n)
    for a, b in ((97, 98), (120, 122)):
        both = np.concatenate([np.where(m, a, b), np.where(m, b, a)]).astype(np.uint8)
        at = np.array([0, n])
        assert len(set(t.RollingBytes(both).ranges(at, at + n).tolist())) == 2
        assert len(set(t.Rolling(both.astype(np.uint64)).ranges(at, at + n).tolist())) == 2
        assert len(set(t.word_hashes(both, at, at + n).tolist())) == 2


def test_words():
    text = ("a ab abc abcdefgh abcdefghi a\x00 a\x00\x00 " + "x" * 64 + " " + "x" * 65 + " " + "x" * 66 + " ab abc " + "x" * 65).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, _ = t.word_bounds(data, np.array([0, len(data)]))
    by = {}
    for h, s, e in zip(t.word_hashes(data, start, end).tolist(), start, end, strict=True):
        by.setdefault(text[s:e], set()).add(h)
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by) == 10


def test_documents_made_to_collide(spark):
    """Words of 1,024 and 4,096 letters that modulo 2 ** 64 hash alike: nothing is removed and nothing linked."""
    from logsentinel.llm import ngram_join, substring_dedup, suffix_dedup

    for n in (1024, 4096):
        x, y = ("".join("ab"[k] for k in c) for c in (morse(n), 1 - morse(n)))
        few = " ".join(f"w{i}" for i in range(19))
        docs = spark.createDataFrame([(1, x), (2, y), (3, f"p {x} q r"), (4, f"p {y} q r"), (5, f"{few} {x}"), (6, f"{few} {y}")], "doc_id long, text string")
        got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
        assert [(got[i].component_id, got[i].n_links) for i in range(1, 7)] == [(i, 0) for i in range(1, 7)]  # the last two share 17 of 19
        assert all(r.n_removed == 0 for r in substring_dedup.dedup(docs).collect())
        data = {i: s.encode() for i, s in docs.collect()}
        seen = {}
        for i, b in data.items():
            for k in range(len(b) - 399):
                seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
        for r in suffix_dedup.dedup(docs).collect():
            b = data[r.doc_id]
            gone = {j for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1 for j in range(k, k + 400)}
            assert r.n_removed == len(gone)
