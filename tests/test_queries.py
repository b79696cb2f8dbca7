"""Every query of the toolkit that has SQL gives the rows that DuckDB gives for it."""

import datetime

import duckdb
import pytest

from millrace import plans

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
