"""Each engine query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from logsentinel import carriers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def compare(spark, query, sql, sf=SF):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    flat = lambda rows: sorted(str([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(names)]) for r in rows)
    assert flat([r.asDict() for r in df.collect()]) == flat(want)
    return len(want)


def test_every_query_has_sql():
    assert set(carriers.QUERIES) == set(carriers.ORACLES)


@pytest.mark.parametrize("name", sorted(carriers.QUERIES))
def test_query(spark, name):
    compare(spark, carriers.QUERIES[name], carriers.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
