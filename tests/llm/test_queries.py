"""Registered queries on the smallest tables: those with SQL against it, all for names, columns and row counts."""

import os

import pytest

from logsentinel.llm.queries import ORACLES, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")

COLUMNS = {
    1: ["doc_id", "n_words", "n_removed", "kept_sha256"], 2: ["doc_id", "item_id"], 3: ["doc_id", "held_out", "score", "predicted"], 4: ["doc_id", "text"], 5: ["doc_id", "size", "source_size", "target", "taken"],
    6: ["page_id", "url", "text", "n_chars"], 7: ["doc_id", "n_shingles", "component_id"], 8: ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    9: ["page_id", "host", "path", "rule", "verdict"], 10: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    11: ["lang", "rank", "phrase", "a", "l", "r", "n", "score"], 12: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], 13: ["doc_id", "n_features", "weight", "score", "rank"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    from tests.test_queries import compare

    assert compare(spark, queries()[name], ORACLES[name]) > 0


def test_one_query_for_each_operator(spark):
    by = {int(n[2:].split("_")[0]): n for n in queries()}
    assert sorted(by) == list(range(1, 14)) and len(queries()) == 13
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for n, name in by.items():
        df = queries()[name](spark, SF)
        assert set(COLUMNS[n]) <= set(df.columns), name
        if n not in (2, 6, 9, 11):
            assert df.count() == docs, name
