"""Edge cases on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import aggregates as A
from millrace.operators import jobs as J
from millrace.operators import relational as R
from millrace.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_streak_starts_after_a_gap(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 10, 11, 12, 12)] + [(2, 1), (2, 3)], "k int, i int")
    assert rows(A.streaks(df, ["k"], "i", 3)) == [(1, 10, 12, 3)]


def test_weeks_go_on_over_new_year(spark):
    df = spark.createDataFrame([("2023-12-25",), ("2024-01-01",), ("2024-01-08",)], "d string").select(S.week_index(F.to_date("d")).alias("w"))
    w = sorted(r.w for r in df.collect())
    assert w == [w[0], w[0] + 1, w[0] + 2]


def test_ties_and_nth(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 3), ("b", None)], "k string, v int")
    assert len(A.top_n(df, ["k"], [F.desc("v")], 1, "dense").collect()) == 3
    assert rows(A.nth_distinct(df, "v", 2)) == [(3,)]
    assert rows(A.nth_distinct(df, "v", 5)) == [(None,)]


def test_null_keys_and_repeated_dictionary(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    b = spark.createDataFrame([(None, 7), ("x", 8)], "k string, v int")
    assert rows(R.left_null_safe(a, b, ["k"]).select("id", "v")) == [(1, 7), (2, 8)]
    d = spark.createDataFrame([("x", "p"), ("x", "o")], "k string, name string")
    assert [(r.id, r.name) for r in R.lookup(a, "k", d, "name", "?").orderBy("id").collect()] == [(1, "?"), (2, "o")]


def test_overlap_of_equal_and_disjoint_bags(spark):
    """Labels compare sizes; trailing blanks don't count as characters; null lines are rows that nothing shares."""
    a = spark.createDataFrame([(1, "é x"), (1, "é x"), (2, "q"), (3, "ab  "), (3, None), (5, "only now")], "k int, line string")
    b = spark.createDataFrame([(1, "é x"), (1, "é x"), (2, "longer"), (2, "r"), (3, "ab  "), (3, None), (4, "z")], "k int, line string")
    out = J.overlap_score(a, b, ["k"], "line").collect()
    got = {r.k: (float(r.score), float(r.char_share), float(r.line_share), r.n_rows_now, r.n_rows_archive, r.n_rows_shared, r.n_chars_now, r.n_chars_archive, r.n_chars_shared, r.line_direction, r.char_direction) for r in out}
    assert got == {
        1: (1.0, 1.0, 1.0, 2, 2, 2, 6, 6, 6, "equal", "equal"), 2: (0.0, 0.0, 0.0, 1, 2, 0, 1, 7, 0, "fewer now", "fewer now"),
        3: (0.85, 1.0, 0.5, 2, 2, 1, 2, 2, 2, "equal", "equal"), 5: (0.0, 0.0, 0.0, 1, 0, 0, 8, 0, 0, "more now", "more now"),
    }


def test_group_statistics_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, v int")
    assert sorted((str(r.k), r.v, r.n, r.most) for r in A.with_group_stats(df, ["k"], {"n": F.count("*"), "most": F.max("v")}).collect()) == [("None", 1, 2, 3), ("None", 3, 2, 3), ("a", 5, 1, 5)]
    assert [(r.k, r.v) for r in A.above_own_average(df, "k", ["v"]).collect()] == []


def test_run_member(spark):
    flags = [True, True, None, True, True, True, False, False, False, True]
    df = spark.createDataFrame(list(enumerate(flags)), "i int, f boolean").withColumn("k", F.lit(1))
    assert [r.member for r in A.run_member(df, ["k"], ["i"], F.col("f"), 3).orderBy("i").collect()] == [False] * 3 + [True] * 3 + [False] * 4


def test_rows_at_positions(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"), F.lit("x").alias("position_name")).repartition(7)
    assert sorted((r.v, r.position) for r in R.rows_at_positions(df, ["v"], [1, 500, -1, -1000, 5000]).collect()) == [(0, 1), (499, 500), (999, 1000)]
    assert R.rows_at_positions(df.limit(0), ["v"], [1]).count() == 0


def test_scalars_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("-",), (" 12-80 [x] (y)z  w",), ("lvl 123",), ("A",)], "t string")
    rows = df.select(S.clean_name("t").alias("n"), S.min_level("t").alias("m"), S.is_text("t").alias("s"), S.has_keyword("t", []).alias("k"), S.rolling_key("t").alias("r"), F.array_join(S.split_list("t"), "|").alias("l"), S.map_get(F.create_map(F.lit("a"), F.lit(1)), "b", 7).alias("g")).collect()
    assert [(r.n, r.m, r.s) for r in rows] == [("", 0, False), ("", 0, False), ("-", 0, False), ("12-80 z w", 12, True), ("lvl 123", 12, True), ("A", 0, True)]
    assert not any(r.k for r in rows if r.k is not None) and all(r.g == 7 for r in rows)
    assert [r.r for r in rows[:2]] == [None, None] and rows[5].r == f"{(5381 * 33 + 97) & 0xFFFFFFFF:08x}{97:08x}"
    assert spark.createDataFrame([("a0, 0b ,,1",)], "t string").select(S.split_list("t").alias("l")).first().l == ["a0", "0b", "1"]


def test_calendar_that_is_too_long(spark):
    with pytest.raises(ValueError, match="calendar"):
        J.missing_cells(spark.range(1).toDF("e"), spark.range(5).toDF("d"), spark.range(1).selectExpr("id AS e", "id AS d"), most_dates=4)


def test_insert_ignore_twice(spark):
    out = io.scratch(spark)
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    io.append(df.limit(0), out)
    io.insert_ignore(spark, out, df, ["k"])
    io.insert_ignore(spark, out, df, ["k"])
    assert spark.read.parquet(out).count() == 2


def test_explode_shares(spark):
    df = spark.createDataFrame([(1, "A b 12,3%, C 4%"), (2, "none"), (3, None)], "k int, t string")
    assert rows(J.explode_shares(df, ["k"], "t")) == [(1, "A b", 12.3), (1, "C", 4.0)]


def test_filters_need_one():
    with pytest.raises(ValueError):
        R.build_filters(a=None)


def test_interval_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-02")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    out = R.active_on(df, "a", "b")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.open for r in out.orderBy("day").collect()] == [1, 0]


def test_money_and_counter(spark):
    df = spark.createDataFrame([("1 234,50 zł", "wolves 3/8"), ("n/a", "none")], "m string, t string").select(S.parse_money("m").alias("m"), S.split_counter("t").alias("c"))
    a, b = df.collect()
    assert (a.m, a.c.text, a.c.done, a.c.total, b.m, b.c.total) == (1234.5, "wolves", 3, 8, None, None)


def test_item_score_reads_all_sources(spark):
    """The query against brute force over all documents: lines of even sources, and what odd ones have of them."""
    from collections import Counter, defaultdict
    from decimal import ROUND_HALF_UP, Decimal

    from millrace import plans

    sf = "/root/testdata/sf0.001"
    bags = defaultdict(lambda: (Counter(), Counter()))
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect():
        bags[r.lang, r.doc_id % 5][int(r.source[3:]) % 2].update(r.text.split("\n"))
    r4 = lambda x: x.quantize(Decimal("0.0001"), ROUND_HALF_UP)
    total = defaultdict(lambda: [0, 0])
    for (lang, _), (now, old) in bags.items():
        chars, both = sum(len(x) * n for x, n in now.items()), now & old
        if now:
            share = r4(Decimal(sum(len(x) * n for x, n in both.items())) / chars) if chars else Decimal(0)
            score = r4(Decimal("0.7") * share + Decimal("0.3") * r4(Decimal(both.total()) / now.total()))
            total[lang][0] += score * chars
            total[lang][1] += chars
    got = {r.lang: r.score for r in plans.queries()["i11_item_score"](spark, sf).collect()}
    assert set(got) == set(total) and all(abs(got[k] - float(s / n)) <= 0.0001 for k, (s, n) in total.items())


def test_values_that_equal_the_average(spark):
    """0.05 is 0.0499 and the margin, 0.1 the average of ten of them, whatever the order of the rows; other groups are plain."""
    tie = [("a", x / 100) for x in [5] * 99 + [4]] + [("b", 0.1)] * 10
    more = [("c", 1e300), ("c", 1e299), ("d", float("inf")), ("d", 1.0), ("e", None), ("e", 2.0), ("f", 1e-20), ("f", 3e-20), ("n", float("nan")), ("n", 1.0)]
    df = spark.createDataFrame(tie[::-1] + more, "k string, v double")
    assert rows(A.above_own_average(df, "k", ["v"]).select("k", "v")) == sorted([("a", 0.05)] * 99 + [("c", 1e300), ("f", 3e-20)])
    tied = spark.createDataFrame([("a", 0.05)] * 99 + [("a", 0.04), ("g", 0.07), ("g", 0.0698)], "k string, v double")
    joined = R.vs_group_mean_join(tied, "k", ["v"])
    assert joined.filter(A.above("v", "avg_v", "0.0001")).count() == 0


def test_shares_that_are_halves(spark):
    """23 of 80 is 28.75 %, as a double a share just below."""
    df = spark.createDataFrame([(23, 80), (57, 80), (1, 3), (7, 7), (0, 9), (1, 2000)], "n long, t long")
    assert [r.x for r in df.select(J.percent_text(F.col("n"), F.col("t")).alias("x")).collect()] == ["28,8%", "71,3%", "33,3%", "100,0%", "0,0%", "0,1%"]


def test_shares_of_a_table_with_halves(spark):
    from millrace import plans

    path = io.scratch(spark)
    flags = [(1, f) for f in "R" * 23 + "N" * 57] + [(2, f) for f in "R" * 115 + "N" * 285] + [(10, "R")]
    spark.createDataFrame(flags, "l_suppkey long, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    got = rows(plans.queries()["i33_explode_shares"](spark, path))
    assert got == [(1, "N", 71.3), (1, "R", 28.8), (2, "N", 71.3), (2, "R", 28.8)]


def test_payloads_of_large_pages(spark):
    """A worker has some hundred pages at a time, not an Arrow batch of all; a filter on the text doesn't decode twice."""
    calls = spark.sparkContext.accumulator(0)
    pages = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 10 != 0, F.repeat(F.sha2(F.col("id").cast("string"), 256), 300)).alias("html"))
    back = io.decode_payload(io.encode_payload(pages, "html"), "payload")
    assert back.filter("decoded = html").count() == 2700 and back.filter("decoded IS NULL AND html IS NULL AND payload IS NULL").count() == 300

    def one(x):
        calls.add(1)
        return "seen"

    seen = io._payload(pages, "html", "x", one).filter("x IS NOT NULL")
    assert "Arrow" not in seen._jdf.queryExecution().executedPlan().toString()
    assert len(seen.collect()) == 3000 == calls.value


def test_archive_of_many_rows_in_many_tasks(spark):
    """Tasks grow in number, not in rows; repeated and null keys and an empty table."""
    df = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), "id")
    keys = df.filter("id % 7 = 0").select("k").union(df.filter("id = 14").select("k"))
    moved = J.archive_and_purge({"big": df, "none": df.limit(0)}, keys, "k", 100)
    gone, stay = moved["big"]
    assert sorted(r.id for r in gone.collect()) == [i for i in range(1000) if i % 7 == 0 and i % 10]
    assert sorted(r.id for r in stay.collect()) == [i for i in range(1000) if i % 7 or i % 10 == 0]
    assert ", 10)" in gone._jdf.queryExecution().executedPlan().toString()
    assert [x.count() for x in moved["none"]] == [0, 0]
