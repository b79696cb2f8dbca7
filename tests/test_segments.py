"""Scans of hot keys: the same rows as plain windows, and no task with more than a few segments' worth of rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import report as B
from millrace.operators import segments as G

MOST = 60


@pytest.fixture(scope="module")
def hot(spark):
    """One key has 90 % of the rows; some keys have a row each, null is a key, some orders are null or tied."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 18 + ["b", None]), None if i % 97 == 0 else i // 2, i, float(rng.randrange(100))) for i in range(2400)]
    rows += [(f"k{i}", 1, 5000 + i, 1.0) for i in range(5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(5).cache()


def plain_window():
    return Window.partitionBy("k").orderBy("t", "id")


FRAMES = [(-2, 0), (0, 2), (-3, 4), (-70, 90), (-5, -2), (3, 4)]


def same(a, b):
    key = lambda r: repr(tuple(r))
    assert sorted(a.collect(), key=key) == sorted(b.select(a.columns).collect(), key=key)


def test_segments(hot):
    s = G.segmented(hot, ["k"], ["t", "id"], MOST)
    per = {(r.k, r[G.SEG]): (r["count"], r.least, r.most) for r in s.rows.groupBy("k", G.SEG).agg(F.count("*").alias("count"), F.min(F.struct("t", "id")).alias("least"), F.max(F.struct("t", "id")).alias("most")).collect()}
    own = [per[k] for k in sorted((k for k in per if k[0] == "hot"), key=lambda k: k[1])]
    assert len(own) > 15 and max(n for n, _, _ in own) <= 4 * MOST
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert all(order(a[2]) < order(b[1]) for a, b in zip(own, own[1:], strict=False))
    assert per["k0", 0][0] == 1 and not G.segmented(hot, ["k"], ["t", "id"]).split


@pytest.mark.parametrize("rows", FRAMES)
def test_frames(hot, rows):
    exprs = {"s": F.sum("v"), "m": F.max("id"), "n": F.count("*")}
    same(A.with_windows(hot, ["k"], ["t", "id"], exprs, rows, MOST), hot.withColumns({n: e.over(plain_window().rowsBetween(*rows)) for n, e in exprs.items()}))


def test_scans(hot):
    n = F.row_number().over(plain_window())
    numbers = G.numbered(G.segmented(hot, ["k"], ["t", "id"], MOST), extra={"total": F.col("id")}).drop(G.SEG)
    same(numbers, hot.withColumns({"n_": n, "total": F.sum("id").over(plain_window().rowsBetween(Window.unboundedPreceding, 0))}))
    for few in (F.col("v") == 3, F.col("id") == 7, F.lit(False)):
        same(A.nearest_marker(hot, ["k"], ["t", "id"], few, MOST), A.nearest_marker(hot, ["k"], ["t", "id"], few))
    same(A.run_member(hot, ["k"], ["t", "id"], F.col("v") > 30, 4, MOST), A.run_member(hot, ["k"], ["t", "id"], F.col("v") > 30, 4))
    same(A.run_member(hot, ["k"], ["t", "id"], F.lit(True), 4, MOST), A.run_member(hot, ["k"], ["t", "id"], F.lit(True), 4))
    same(A.next_delta(hot, ["k"], ["t", "id"], F.col("v"), MOST), hot.withColumn("next_delta", F.lead("v").over(plain_window()) - F.col("v")))
    x = hot.filter("v <> 40").select("k", "id", "v")
    same(A.runs_over(x, ["k"], "id", F.col("v") > 20, 3, MOST), A.runs_over(x, ["k"], "id", F.col("v") > 20, 3))
    same(A.streaks(x, ["k"], "id", 5, MOST), A.streaks(x, ["k"], "id", 5))
    same(B.returns(hot, "k", "id", "v", [1, 3], MOST), B.returns(hot, "k", "id", "v", [1, 3]))


def test_run_member_by_lag(hot):
    """The plain form too: runs by where the flag changes."""
    w = plain_window()
    runs = hot.withColumn("on", F.coalesce(F.col("v") > 30, F.lit(False))).withColumn("new", F.when(F.col("on").eqNullSafe(F.lag("on").over(w)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = runs.withColumn("member", F.col("on") & (F.count("*").over(Window.partitionBy("k", "run")) >= 4)).drop("on", "new", "run")
    same(A.run_member(hot, ["k"], ["t", "id"], F.col("v") > 30, 4, MOST), plain)


def test_no_task_reads_a_hot_key(spark, hot):
    """Rows of each task of the window's stage."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df in (A.rolling(hot, ["k"], ["t", "id"], "v", 3, MOST), A.nearest_marker(hot, ["k"], ["t", "id"], F.col("v") == 3, MOST)):
            tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(tasks) == 2405 and max(tasks) < 2405 / 4
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_empty(spark):
    e = spark.createDataFrame([], "k string, t int, v double")
    assert A.rolling(e, ["k"], ["t"], "v", 3).count() == 0 and A.nearest_marker(e, ["k"], ["t"], F.col("v") == 1).count() == 0
