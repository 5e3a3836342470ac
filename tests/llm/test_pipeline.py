"""The pipeline against a brute-force version of its stages on a small corpus."""

import pathlib
import random
import re

from logsentinel.llm import quality
from logsentinel.llm.storage import shared_dir

from .test_ngram_join import brute, shingles

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def make(tmp_path, spark):
    r = random.Random(9)
    vocab = ["the", "of", "and"] * 40 + ["".join(r.choices("aeioustnr", k=r.randint(3, 8))) for _ in range(1500)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(k, text(25)) for k in range(12)]
    docs, labels = [], []
    for i in range(400):
        body, good = text(r.randint(30, 120)), r.random() < 0.8
        if not good:
            body = " ".join(w.upper() + "!!" for w in body.split())
        elif i % 10 == 0:
            body += " " + items[i % 12][1]
        elif i % 10 == 1:
            body += f" mail u{i}@mail{i % 3}.example.com now"
        docs.append((i, body, "en", f"s{i % 4}", len(body)))
        labels.append((i, int(good), 0))
    for i in range(400, 460):
        w = docs[r.randrange(400)][1].split()
        w[r.randrange(len(w))] += "x" if i % 2 else ""
        docs.append((i, " ".join(w), "en", "s0", len(" ".join(w))))
    docs.append((500, None, "en", None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = make(tmp_path, spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII surrogates", "source mixing"]
    scores = {x.doc_id: x.predicted for x in quality.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    kept = {d: t for d, t, *_ in docs if scores[d]}
    assert all("!!" not in (t or "") for t in kept.values()) and len(kept) > 300
    root = brute(list(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if root[d][1] == d}
    grams = [shingles(t) for _, t in items]
    kept = {d: t for d, t in kept.items() if not any(len(g & shingles(t)) >= 0.6 * len(g) for g in grams)}
    got, frame = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{tmp_path}/{name.split()[0]}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
    got = {x.doc_id: x.text for x in frame.collect()}
    assert set(got) == set(kept)
    mail = re.compile(r"\S+@\S+")
    for d, t in got.items():
        assert mail.sub("@", t or "") == mail.sub("@", kept[d] or "")
        assert not mail.search(kept[d] or "") or mail.search(t)[0] != mail.search(kept[d])[0]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.size for x in rows} == {d: len((t or "").split()) for d, t in kept.items()}
    total = sum(x.size for x in rows)
    whole = {d: (t or "").split() for d, t in got.items()}
    assert all((x.text or "").split() == (whole[x.doc_id] * 2)[: x.taken] for x in rows)
    assert 0 <= 1.5 * total - sum(x.taken for x in rows) <= 5


def test_edges(spark, tmp_path):
    """Empty tables, repeated rows, null columns, a very long text and columns with clashing names; side tables are gone."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, taken string, root long, _row string"
    long = "word " * 100_000 + "mail me@here.example.org"
    rows = [(1, "the cat sat on the mat and so on", "en", "a", 30, "x", "y", 1, "z")] * 2 + [(2, long, "en", None, len(long), None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, "x", "y", 1, "z")]
    for name, data in (("full", rows), ("empty", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        before = set(pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("staged/*"))
        got = corpus_pipeline.run(spark, at).collect()
        left = set(pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("staged/*")) - before
        assert len(got) == len(data) and len(left) < 10 and sum("PII" in p.name for p in left) == 1 and not any("quality" in p.name or "profiles" in p.name for p in left)
        if data:
            assert {r.doc_id: r["_text"] for r in got} == {1: "x", 2: None, None: None, 3: "x"}
            assert all(r.taken <= 2 * r.size and len((r.text or "").split()) == r.taken for r in got)
            assert "me@here" not in next(r.text for r in got if r.doc_id == 2)
