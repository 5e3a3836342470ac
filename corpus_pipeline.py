"""Corpus cleaning in five stages; each reads what the one before kept and is written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsentinel.llm import decontaminate, mixing, ngram_join, pii, quality
from logsentinel.llm.storage import remove, scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, directly or through others, the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or paraphrased, go."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the text; n_chars follows it."""
    return pii.anonymise(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document's text as often and as far as the mix takes it."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII surrogates", pii_surrogates),
    ("source mixing", source_mixing),
]

#: Trained and retrieval stages have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus. A stage's side tables go when its result is written, its input when the next one's is; the
    result reads the last stage's input and side tables, which stay."""
    docs, path = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = stage(spark, docs, sf_dir)
            keep.append(written(out, name.replace(" ", "-")))
        if path:
            remove(spark, path)
        path = keep[0]
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
