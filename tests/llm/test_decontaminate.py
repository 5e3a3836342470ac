import random

import numpy as np
from pyspark.sql import functions as F

from logsentinel.llm import decontaminate as d


def lcs_table(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_lcs():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert d.lcs(a, b) == lcs_table(a, b)


def test_answer_of():
    assert d.answer_of("What is it? A cat.") == " A cat."
    assert d.answer_of("One two. Three four.") == " Three four"


def corpus(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "in"] * 60 + ["".join(r.choices("aeioustnr", k=r.randint(3, 8))) for _ in range(2500)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, ". ".join(text(r.randint(6, 20)) for _ in range(r.randint(2, 3))).capitalize() + ".") for i in range(30)]
    docs, want = [], set()
    for i in range(300):
        body = text(r.randint(5, 400))
        if i % 6 == 0:
            k = r.randrange(len(items))
            words = items[k][1].split()
            if i % 12 == 0:  # a paraphrase: words replaced, inserted, dropped
                for _ in range(len(words) // 9):
                    words[r.randrange(len(words))] = r.choice(vocab)
                words.insert(r.randrange(len(words)), r.choice(vocab))
                del words[r.randrange(len(words))]
            body += " " + " ".join(words).upper() + " " + text(r.randint(0, 200))
            want.add((i, k))
        docs.append((i, body))
    return docs, items, want


def test_finds_copies_and_paraphrases(spark):
    docs, items, want = corpus(4)
    df = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(5)
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find(df, bench).collect()}
    # every pair that the last checks accept at any place, by brute force over all places of all documents
    brute = set()
    for k, t in items:
        x, answer = d._hash_text(t), set(d._hash_text(d.answer_of(t)))
        m = len(x)
        for i, body in docs:
            words = d._hash_text(body)
            for a in range(0, max(1, len(words) - m // 2), max(1, m // 8)):
                region = words[a : a + m + m // 4]
                if len(set(x) & set(region)) >= 0.5 * len(set(x)) and lcs_table(x, region) >= 0.6 * m and 2 * len(answer & set(region)) >= len(answer):
                    brute.add((i, k))
    assert want <= brute and got == brute
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want} | {1000, 1001, None}


def test_short_items_inside_longer_texts(spark):
    """Exact copies of items of 3 to 13 words, common words among them, between other words of a document."""
    r = random.Random(8)
    vocab = ["the", "of", "and", "in"] * 60 + ["".join(r.choices("aeioustnr", k=r.randint(3, 8))) for _ in range(2500)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(10 * n + i, text(n)) for n in range(3, 14) for i in range(10)]
    docs = [(k, f"{text(60)} {t} {text(60)}") for k, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.lcs for x in d.find(df, bench).collect()}
    assert [k for k, _ in items if got.get((k, k)) != 1.0] == []


def test_short_items_are_not_found_by_chance(spark):
    """All words of a short item must stand in order and near each other; one of a word or two only as a whole text."""
    assert d.stands_in_order([1, 2, 3], [9, 1, 2, 9, 3, 1, 2, 3]) == 5 and d.stands_in_order([1, 2, 3], [1, 2, 9, 3, 2, 1]) == -1
    assert d.stands_in_order([1, 2, 3, 4], [1, 2, 9, 3, 4]) == 0 and d.stands_in_order([1], []) == -1
    items = [(1, "the"), (2, "the cat"), (3, "the cat sat"), (4, "the cat sat on a mat"), (5, "zq")]
    docs = [(1, "the"), (2, "The cat."), (3, "all the while the cat sat and sat"), (4, "sat cat the on mat a the"), (5, "the cat sat on one a mat"), (6, "cat the sat"), (7, "a zq b")]
    docs += [(100 + i, f"the dog and the bird number {i} of the yard") for i in range(300)]
    got = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.lcs) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (5, 3, 1.0), (5, 4, 1.0)]


def test_blocks_and_empty(spark, monkeypatch):
    docs, items, want = corpus(6)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d, "BLOCK_ITEMS", 16)
    assert {(r.doc_id, r.item_id) for r in d.find(df, bench).collect()} == want
    assert d.find(df.limit(0), bench).count() == 0 and d.find(df, bench.limit(0)).count() == 0


def test_lots_and_reruns(spark, monkeypatch):
    """Several blocks in one pass, or a pass each, and other partitions give the same rows; two runs the very same numbers."""
    docs, items, want = corpus(9)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    src = d.prepared(df)
    idf, _ = d.frequencies(src)
    queries = [d.query_of(x, idf) for x in (items[:10], items[10:])]
    monkeypatch.setattr(d, "FAN", 2)
    one, two = d.singular_vectors(src, queries), d.singular_vectors(src, queries)
    assert all((a == b).all() for a, b in zip(one, two, strict=True))
    for a, q in zip(one, queries, strict=True):
        assert a.shape[0] == len(q.terms) and np.allclose(a.T @ a, np.eye(a.shape[1]), atol=1e-4)
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    for lot in (d.LOT_BYTES, 1):
        monkeypatch.setattr(d, "LOT_BYTES", lot)
        assert {(r.doc_id, r.item_id) for r in d.find(df, bench).collect()} == want


def test_long_text_and_ties(spark):
    """A text of 200,000 words, an item at its very end, items of equal text, rows that repeat an id."""
    docs, items, _ = corpus(2)
    filler = "x".join(docs[1][1].split()[:3]) + " "
    df = spark.createDataFrame([(1, filler * 200_000 + items[3][1]), (2, "no"), (2, items[3][1]), (2, items[3][1])], "doc_id long, text string")
    bench = spark.createDataFrame([items[3], (77, items[3][1])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.find(df, bench).collect()) == [(1, 3), (1, 77), (2, 3), (2, 77)]
    assert d.keep_clean(df, bench).count() == 0
