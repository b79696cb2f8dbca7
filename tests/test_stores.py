"""Databases, counts by level, medians, links, checked writes, reviews, page fields, documents: edge rows."""

import datetime
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import aggregates as A
from millrace.operators import documents as D
from millrace.operators import jobs as J
from millrace.operators import pages as P
from millrace.operators import review as V
from millrace.sources import database, io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def new_file(spark):
    path = io.scratch(spark).removeprefix("file://") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def test_database_round_trip(spark):
    path = new_file(spark)
    data = [(1, "a", 1.5, True, b"x"), (None, None, None, None, None), (9, "it's", -0.25, False, b""), (-3, "", 1e300, None, b"\0")]
    df = spark.createDataFrame(data, "k long, t string, d double, b boolean, y binary")
    database.write_database(df.repartition(3), path, "odd name")
    got = database.read_database(spark, path, "odd name", "k long, t string, d double, b boolean, y binary", "k", 3)
    assert rows(got.withColumn("y", F.hex("y"))) == rows(df.withColumn("y", F.hex("y")))
    database.write_database(df.limit(1), path, "odd name")
    assert database.read_database(spark, path, "odd name", "k long").count() == 5
    database.write_database(df.limit(1), path, "odd name", "overwrite")
    assert database.read_database(spark, path, "odd name", "t string", "k").count() == 1
    with sqlite3.connect(path) as db:
        assert [r[0] for r in db.execute("SELECT name FROM sqlite_master")] == ["odd name"]  # no staging table is left
    assert spark.read.format("sqlite_table").option("path", path).option("table", "odd name").load().dtypes == [("k", "bigint"), ("t", "string"), ("d", "double"), ("b", "bigint"), ("y", "binary")]


def test_database_filters_are_pushed(spark):
    path = new_file(spark)
    df = spark.range(1000).select("id", F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), F.when(F.col("id") % 3 != 0, F.col("id") / 2).alias("half"))
    database.write_database(df, path, "t")
    got = database.read_database(spark, path, "t", "id long, name string, half double", "id", 4)
    some = "id >= 10 AND id < 500 AND name IN ('n1', 'n2') AND half IS NOT NULL AND half > 20.5 AND length(name) + id % 2 = 2"
    filtered = got.filter(some)
    plan = spark._jvm.PythonSQLUtils.explainString(filtered._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "GreaterThanOrEqual(id,10)" in pushed and "LessThan(id,500)" in pushed and "In(name" in pushed and "half" not in pushed
    assert "ReadSchema: struct<id:bigint,name:string,half:double>" in plan
    assert rows(filtered) == rows(df.filter(some)) and got.rdd.getNumPartitions() == 4
    read = database._Reader({"path": path, "table": "t", "key": "id", "partitions": "4"}, got.schema)
    from pyspark.sql.datasource import GreaterThan

    left = list(read.pushFilters([GreaterThan(("id",), 989), GreaterThan(("half",), 1.0)]))
    assert len(left) == 1 and sum(len(list(read.read(p))) for p in read.partitions()) == 10  # SQLite gives no others


def test_a_task_that_fails_writes_nothing(spark):
    path = new_file(spark)
    database.write_database(spark.range(3), path, "t")
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("gone"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="gone"):
        database.write_database(bad, path, "t")
    with sqlite3.connect(path) as db:
        # a task that was still running when the job was given up may leave its own staging table
        assert {r[0] for r in db.execute("SELECT name FROM sqlite_master") if not r[0].startswith("staged_")} == {"t"}
        assert db.execute("SELECT id FROM t ORDER BY id").fetchall() == [(0,), (1,), (2,)]
    with pytest.raises(ValueError):
        database.write_database(spark.range(1).select(F.array("id").alias("a")), path, "t")
    with pytest.raises(ValueError):
        database.local("hdfs://x/y")


def test_distinct_by_levels(spark):
    data = [("a", "x", v) for v in (1, 1, 40_000, -5, None)] + [("a", "y", 1), ("b", None, 32_768), (None, None, 32_769), (None, "x", None)]
    df = spark.createDataFrame(data, "g string, h string, v int")
    got = {(r.level, r.name): r.n for r in A.distinct_by_levels(df, {"all": [], "one": ["g"], "two": ["g", "h"]}, "v").collect()}
    assert got == {("all", ""): 5, ("one", "a"): 3, ("one", "b"): 1, ("one", ""): 1, ("two", "a/x"): 3, ("two", "a/y"): 1, ("two", "b/"): 1, ("two", "/"): 1}
    assert A.distinct_by_levels(df.limit(0), {"all": []}, "v").count() == 0


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_exact_median(spark, most):
    data = [("hot", float(i * 37 % 501)) for i in range(501)] + [("even", 1.0), ("even", 4.0), ("same", 2.0), (None, 5.0), ("none", None)] + [("tied", 7.0)] * 40 + [("tied", 9.0)] * 40
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.n, r.median) for r in A.exact_median(df, ["k"], "v", most).collect()}
    assert got == {"hot": (501, 250.0), "even": (2, 2.5), "same": (1, 2.0), None: (1, 5.0), "tied": (80, 8.0)}
    assert A.exact_median(df, [], "v", most).select("n").first().n == 585


def test_frontier_ends_and_goes_around(spark):
    page = lambda i, *to: (f"https://s/p{i}", "".join(f'<a href="/p{t}">x</a>' for t in to))
    df = spark.createDataFrame([page(1, 2, 3), page(2, 4, 1), page(3, 4), page(4, 2), page(9, 1), ("https://s/p3", None)], "url string, html string")
    seeds = spark.createDataFrame([("https://s/p1",)], "url string")
    got = {r.url: (r.level, r.parent) for r in P.frontier(df, "url", "html", seeds, "^https://s/", "https://s").collect()}
    assert got == {"https://s/p1/": (0, None), "https://s/p2/": (1, "https://s/p1/"), "https://s/p3/": (1, "https://s/p1/"), "https://s/p4/": (2, "https://s/p2/")}
    assert P.frontier(df, "url", "html", seeds.limit(0), "x", "https://s").count() == 0
    with pytest.raises(RuntimeError):
        P.frontier(df, "url", "html", seeds, "^https://s/", "https://s", most_rounds=2)


def test_checked_write_computes_the_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(1, "a"), (1, None), (None, "z")], "k int, v string").withColumn("k", counted("k"))
    dim = spark.createDataFrame([(2,)], "k int")
    out = J.checked_write(df, io.scratch(spark), "t", not_null=["k", "v"], closed={"v": ["a"]}, rules={"small": F.col("k") < 1}, unique=[["k"]], foreign={"k": dim})
    assert rows(out) == [("t", "k known", 2), ("t", "k not null", 1), ("t", "k unique", 1), ("t", "small", 3), ("t", "v in list", 1), ("t", "v not null", 1)]
    assert seen.value == 3


def test_translate_keeps_rows(spark):
    """Repeated keys and rows, null keys and texts, empty lines and a dictionary with repeated sources."""
    df = spark.createDataFrame([(1, "Hello\n\nyou"), (1, "Hello\n\nyou"), (1, "hello "), (2, None), (None, "you"), (3, "")], "id int, t string")
    words = spark.createDataFrame([("hello", "cześć"), ("HELLO ", "ahoj"), ("you", "ty"), ("none", None), (None, "x")], "source string, target string")
    assert rows(J.translate(df, "id", "t", words)) == sorted([(1, "ahoj\n\nty"), (1, "ahoj\n\nty"), (1, "ahoj"), (2, None), (None, "ty"), (3, "")], key=repr)
    assert rows(J.translate(df, "id", "t", words.limit(0)))[0][0] == 1 and J.translate(df.limit(0), "id", "t", words).count() == 0


def test_enrich_of_repeated_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a", "old", 5), (2, None, "old", 6), (3, "c", "old", 7), (None, "a", "old", 8)], "i int, k string, v string, n int")
    new = spark.createDataFrame([(1, "a", "first", 1, 1), (1, "a", None, 2, 2), (1, "b", "other key", 3, 9), (2, None, "null key", 4, 1), (4, "d", "unknown", 5, 1)], "i int, k string, v string, n int, at int")
    assert rows(J.enrich(target, new.repartition(3), ["i", "k"], ["v", "n"], ["at"])) == sorted([(1, "a", None, 2), (2, None, "old", 6), (3, "c", "old", 7), (None, "a", "old", 8)], key=repr)
    assert rows(J.repeated_keys(new, ["i", "k"])) == [(1, "a", 2)]


def test_reject_report(spark):
    df = spark.createDataFrame([("x", i) for i in (5, 3, 3, 9, 1, 7, 8)] + [("y", None), (None, 4)], "reason string, v int")
    assert rows(J.reject_report(df, "v", 3)) == [("x", 7, [1, 3, 5]), ("y", 1, [])]


def test_sheet_suggestions_and_errors(spark):
    lines = spark.createDataFrame([(1, "TEXT", None, "1", None, "one"), (1, "TEXT", None, "1", None, "one"), (1, "ODD", "s", None, "2", None)], "item int, segment string, sub string, block string, line string, text string")
    titles = spark.createDataFrame([(1, "Title", None)], "item int, a string, b string")
    archive = spark.createDataFrame([(1, "TEXT", " ", 1.0, "1", "late", 2), (1, "TEXT", "", 1.0, "1", "b", 1), (1, "TEXT", "", 1.0, "x", "a", 1), (1, "TEXT", "", 2.0, "1", "elsewhere", 0), (1, "ODD", "s", None, "2.0", None, 0)], "item int, segment string, sub string, block double, line string, text string, rank int")
    names = {"who": spark.createDataFrame([(1, "Z"), (1, "Y")], "item int, name string")}
    sheet = V.build_sheet(lines, titles, {"a": "original", "b": "approved"}, ["TITLE", "TEXT"], names, archive, [F.col("rank")])
    got = rows(sheet.select("segment", "status", "text", "who", "segment_order"))
    assert got == sorted([("TEXT", "original", "one", "Y", 2)] * 2 + [("TEXT", "approved", "", "Y", 2), ("TEXT", "suggestion", "a", "Y", 2), ("ODD", "original", None, "Y", 3), ("ODD", "approved", "", "Y", 3), ("ODD", "suggestion", "", "Y", 3), ("TITLE", "original", "Title", "Y", 1), ("TITLE", "approved", None, "Y", 1)], key=repr)
    good, bad = V.load_approved(sheet.withColumn("text", F.when((F.col("segment") == "ODD") & (F.col("status") == "approved"), "x").otherwise(F.col("text"))), spark.createDataFrame([("y ", 3), ("Y", 4)], "name string, id int"), "who")
    assert good.count() == 0
    assert {r.segment: r.errors for r in bad.collect()} == {"TEXT": ["repeated original", "blank", "ambiguous name"], "ODD": ["original without text", "ambiguous name"], "TITLE": ["blank", "ambiguous name"]}


def test_page_fields_of_broken_pages(spark):
    pages = ["<dl><dt>A<dd>1<dd>2</dl><li>B: x: y<li>no pair<table><tr><th>C</th><td>3</td><td>4</td></tr><tr><td>no label</td></tr></table>", "", None, "<title>t<h1>u", "<p>D:" + " v" * 5000, "<th>E</th><td>1 234,5 %</td>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: [tuple(p) for p in r.pairs] for r in P.page_fields(df, "id", "html").collect()}
    assert got == {0: [("A", "1"), ("A", "2"), ("B", "x: y"), ("C", "3"), ("C", "4")], 1: [], 2: [], 3: [], 4: [("D", " ".join(["v"] * 5000))], 5: [("E", "1 234,5 %")]}
    typed = P.typed_fields(P.page_fields(df, "id", "html"), "id", {"e": ("e", "double"), "a": ("A", "int"), "when": ("A", "date")})
    assert {r.id: (r.e, r.a, r.when) for r in typed.collect()} == {0: (None, 1, None), **{i: (None, None, None) for i in (1, 2, 3, 4)}, 5: (1234.5, None, None)}
    assert datetime.date(2024, 3, 1) == P.typed_fields(spark.createDataFrame([(1, [("d", "01.03.2024")])], "id int, pairs array<struct<label: string, value: string>>"), "id", {"d": ("D", "date")}).first().d


def test_documents_of_any_shape(spark):
    texts = ['{"p":{"u":{"1":" a ","x":5,"3":null,"4":"","5":{"q":1},"6":2.5,"7":true}},"g":{"Main":{"2":"m"},"Odd":{"1":"n"},"Sub":"str"},"b":[{"id":7,"kind":"k","speaker":"user","lines":{"1":"hi"}},5,{"speaker":null,"lines":{"2":"yo"}},{"id":1,"lines":[1]}]}', '{"p":', None, "[1]", '{"p":5,"b":{},"g":{"Main":null}}', ""]
    d = D.parse(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t")
    lines = D.flatten(d, "id", "doc", {"U": ["p", "u"]}, {"G": (["g"], {"Main": "MAIN", "Sub": "SUB"})})
    assert rows(lines) == sorted([(0, "U", None, 1, "a"), (0, "U", None, 1, "5"), (0, "U", None, 5, '{"q":1}'), (0, "U", None, 6, "2.5"), (0, "U", None, 7, "true"), (0, "G", "MAIN", 2, "m")], key=repr)
    names = spark.createDataFrame([("user", 1), ("user", 3), ("other", 0)], "name string, nid int")
    assert rows(D.flatten_blocks(d, "id", "doc", ["b"], names, "nid", "other")) == sorted([(0, 7, "k", 1, 1, "hi"), (0, 2, None, 0, 2, "yo")], key=repr)
    checked = D.validate(d, D.need_object(keys=["p", "b"]), D.need_object("p", keys=["u", "z"]), D.need_object("g", keys=["Main"]), D.need_array("b", keys=["id", "kind"], closed={"kind": ["z"]}))
    none = ["root (object expected)", "root.p (object expected)", "root.g (object expected)", "root.b (list expected)"]
    assert {r.id: r.problems for r in checked.collect()} == {
        0: ["root.p.z", "root.b[0].kind (not in the list)", "root.b[1] (object expected)", "root.b[2].id", "root.b[2].kind", "root.b[3].kind"],
        1: none, 2: none, 3: none, 4: ["root.p (object expected)", "root.b (list expected)"], 5: none,
    }


def test_pages_are_parsed_once_and_by_many_tasks(spark):
    from millrace import plans

    df = plans.queries()["i29_page_fields"](spark, "/root/testdata/sf0.1")
    assert str(df._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    rows = io.spread(spark.range(0, 95, 1, 1), 10)
    assert rows.rdd.getNumPartitions() == 10 and sorted(r.id for r in rows.collect()) == list(range(95))


def test_exact_median_orders_few_rows(spark, monkeypatch):
    """Only values near the middle are put in order; a group whose quantiles are off is counted as a whole."""
    ordered = []
    monkeypatch.setattr(A, "segmented", lambda df, *rest, inner=A.segmented: ordered.append(df.count()) or inner(df, *rest))
    df = spark.range(0, 200_001, 1, 8).selectExpr("IF(id % 4 = 0, 'a', 'b') AS k", "CAST(id * 7919 % 200003 AS DOUBLE) AS v")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.median for r in A.exact_median(df, ["k"], "v", 10_000).collect()} == want
    assert sum(ordered) < 2000
    monkeypatch.setattr(A.F, "percentile_approx", lambda c, *_: F.array(F.min(c), F.min(c)))
    assert {r.k: r.median for r in A.exact_median(df, ["k"], "v", 10_000).collect()} == want


def test_frontier_pages_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    from millrace import plans

    spark.range(0, 50_000, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(P, "frontier", lambda pages, url, *_: pages.select(url, F.lit(0).alias("level"), F.lit("").alias("parent")))
    df = plans.queries()["i30_frontier"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.distinct().count() == 50_000


def test_canonical_urls_work_each_step_out_once(spark):
    odd = ["a", "/a?b", " //a/b.html#c", "https://s", "https://s/", "https://s/x.y/z", "", "?", None, "HTTP://S/a", "a\nb", "\ta "]
    df = spark.createDataFrame([(odd,), ([],), (None,)], "x array<string>")
    for base in ("", "https://s/"):
        got = df.select(S.canonical_urls("x", base).alias("x"))
        assert [r.x for r in got.collect()] == [[r.x for r in spark.createDataFrame([(v,) for v in odd], "x string").select(S.canonical_url("x", base).alias("x")).collect()], [], None]
        assert str(got._jdf.queryExecution().optimizedPlan()).count("regexp_replace(") == (2 if base else 1)


def test_frontier_links_that_become_one(spark):
    page = lambda u, *to: (u, "".join(f'<a href="{t}">x</a>' for t in to))
    data = [page("https://s/a?v=1", "b?p=1", "/b/", "https://s/b?q", "/a", "https://t/x"), page("https://s/a/", "c"), page("/b", "d", "a?x", "c/"), page(None, "lost"), page("https://s/c")]
    df = spark.createDataFrame(data, "url string, html string")
    seeds = spark.createDataFrame([("/a#top",), ("https://s/a",)], "url string")
    got = rows(P.frontier(df, "url", "html", seeds, "^https://s/", "https://s").select("url", "level", "parent"))
    assert got == [("https://s/a/", 0, None), ("https://s/b/", 1, "https://s/a/"), ("https://s/c/", 1, "https://s/a/"), ("https://s/d/", 2, "https://s/b/")]
