"""The queries of this subpackage that have SQL give the rows that DuckDB gives for it."""

import duckdb
import pytest

from millrace.llm import registry

SF = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    assert got == sorted(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())
