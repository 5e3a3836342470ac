"""The operators' queries on whole tables, with their production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontaminate, html_extract, media, mixing, ngram_join, oracles, pii, quality, resampling, substring_dedup, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_entities")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality label of the document that a page's url names (its path is /lang/doc_id): page_id, good."""
    doc = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]{2}/([0-9]+)', 1) AS BIGINT)")
    votes = labels.groupBy("doc_id").agg(F.max("quality").alias("good"))
    return pages.select("page_id", doc.alias("doc_id")).join(votes, "doc_id").groupBy("page_id").agg(F.max("good").alias("good"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extract(_table(spark, sf_dir, "pages"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op8_of(docs: DataFrame) -> DataFrame:
    """Each document as a page that shows its payload between two paragraphs as a figure captioned with its id, parsed and
    resolved again: position and caption tell whether references stay aligned. (No html of ``pages`` holds media.)"""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    html = F.concat(F.lit("<p>A document.</p><figure><img src='media:"), media.digest(F.col("text")), F.lit("'><figcaption>"), name, F.lit("</figcaption></figure><p>Its payload is above.</p>"))
    sequences = media.interleave(docs.select("doc_id", html.alias("html")), "doc_id", "html")
    got = media.resolve(sequences, media.store(docs, with_media=False))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_of(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    got = url_filter.judge(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), seed="2024")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and "_" in k and callable(f) and k != "op8_of"}


ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op7_ngram_join": oracles.NGRAM_JOIN,
    "op8_media_columns": oracles.MEDIA,
    "op10_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op5_mixing": mixing.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
