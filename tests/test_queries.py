"""Every query with SQL of its own is held against it, as the driver does, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quern.plans.catalogue import ORACLE, QUERIES

DIR = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    assert len(got) > 0
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = [dict(zip(cols, r)) for r in cur.fetchall()]
        assert sorted(repr([norm(r[c]) for c in sorted(cols)]) for r in got) == sorted(repr([norm(r[c]) for c in sorted(cols)]) for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
