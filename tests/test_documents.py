"""Documents and jobs on rows that repeat, on long conversations and on nulls, against the same SQL."""

import duckdb
import pytest

from millrace import plans
from millrace.operators import aggregates as A
from millrace.sources import io

DOCUMENTS = ["i13_flatten_json", "i14_flatten_json_blocks", "i16_validate_json", "i13_flatten_document", "i14_flatten_blocks", "i15_pick_branches", "i16_validate_document", "a6_answers_by_file"]


@pytest.fixture(scope="module")
def folder(spark):
    """One conversation of 2345 turns, one of 12 (10 is after 9), one with each turn twice, with another text or the same,
    one with nulls, one whose answers begin with blanks."""
    rows = [(6, t, ("user", "assistant", "system")[t % 3], f"text {t} of many") for t in range(2345)]
    rows += [(13, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(12)]
    rows += [(7, t, "user", x) for t in range(3) for x in (f"one {t}", f"two {t}")] + [(8, 1, "assistant", "same")] * 3
    rows += [(9, 0, "user", None), (9, 1, "assistant", ""), (9, 2, "user", "  x\ty  ")]
    rows += [(k, t, "user", f" \t{k} {t}\n") for k in (10, 11, 12, 14, 15) for t in range(2)]
    path = io.scratch(spark)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", DOCUMENTS)
def test_documents(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    df = plans.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    cur = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert got


def test_a_document_holds_a_section(spark, folder):
    from millrace.plans.documents import SECTION, placed

    sizes = placed(spark, folder).groupBy("conv_id", "section").count().collect()
    assert max(r["count"] for r in sizes) == SECTION
    assert len([r for r in sizes if r.conv_id == 6]) == 3


def test_last_two_changed(spark):
    """A single row is no change; nulls are values; the key may be null; a tie in the first column goes by the second."""
    rows = [("a", 1, 1, "x", 1), ("a", 2, 1, "x", 2), ("a", 2, 2, "y", 2), ("one", 1, 1, "x", 1), ("same", 1, 1, None, 1), ("same", 2, 1, None, 1), ("same", 0, 1, "z", 9), (None, 1, 1, None, 1), (None, 2, 1, "v", 1)]
    df = spark.createDataFrame(rows, "k string, t int, u int, a string, b int")
    out = A.last_two_changed(df, "k", ["t", "u"], ["a", "b"])
    assert sorted((r.k or "", r.changed_a, r.changed_b) for r in out.collect()) == [("", True, False), ("a", True, False)]
    many = spark.range(20000).selectExpr("CAST(id % 1 AS STRING) AS k", "CAST(id AS INT) AS t", "1 AS u", "CAST(id AS STRING) AS a", "1 AS b")
    out = A.last_two_changed(many.repartition(8), "k", ["t", "u"], ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [(r.k, r.changed_a, r.changed_b) for r in out.collect()] == [("0", True, False)]


def test_rules_go_over_a_whole_conversation(spark):
    """Answers and questions more than a section apart."""
    path = io.scratch(spark)
    rows = [(1, t, "user" if t in (0, 2300) else "assistant" if t == 1500 else "system", "x" * (201 if t == 2300 else 1)) for t in range(2345)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    assert [tuple(r) for r in plans.queries()["i16_validate_document"](spark, path).collect()] == [(1, "short questions")]
