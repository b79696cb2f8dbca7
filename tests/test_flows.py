"""Streams with state and queues, batched calls."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import calls as C
from millrace.sources import io
from millrace.streaming import collect as K

SCHEMA = "k string, t long, v string"


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are read in the order of their times


def test_first_seen_with_context(spark):
    """A key repeated in one batch, in two, after a restart, and after its state is gone; null and empty keys are none."""
    path, out, mark = (io.scratch(spark) for _ in range(3))
    known = spark.createDataFrame([("old",)], "k string")

    def drain(ttl="1 hour"):
        K.drain(K.collect_first(K.read_stream(spark, path, SCHEMA), known, "k", ["t", "v"], ttl), K.once(K.insert_into(out, ["k"])), mark)
        return sorted((r.k, r.t, r.v) for r in spark.read.schema(SCHEMA).parquet(out).collect())

    put(spark, path, [("a", 5, "late"), ("a", 3, None), ("a", 3, "x"), ("old", 1, "no"), (None, 1, "no"), ("", 1, "no"), ("b", None, "only")])
    put(spark, path, [("a", 1, "an earlier time, a later batch"), ("c", 2, 'quo"ted\nline')])
    first = drain()
    assert first == [("a", 3, None), ("b", None, "only"), ("c", 2, 'quo"ted\nline')] or first == [("a", 3, "x"), ("b", None, "only"), ("c", 2, 'quo"ted\nline')]
    put(spark, path, [("a", 0, "after the restart"), ("d", 9, "new")])
    assert drain() == sorted([*first, ("d", 9, "new")])


def test_state_ends_and_the_sink_remembers(spark):
    path, out, mark = (io.scratch(spark) for _ in range(3))
    known, sent = spark.createDataFrame([], "k string"), []

    def sink(batch, n):
        sent.extend(r.k for r in batch.collect())
        K.insert_into(out, ["k"])(batch, n)

    for rows in ([("a", 1, "one")], [("a", 2, "two")]):
        put(spark, path, rows)
        K.drain(K.collect_first(K.read_stream(spark, path, SCHEMA), known, "k", ["t"], "1 second"), K.once(sink), mark)
        time.sleep(1.2)
    assert sent == ["a", "a"]  # the state was gone
    assert [(r.k, r.v) for r in spark.read.schema(SCHEMA).parquet(out).collect()] == [("a", "one")]


def files(path):
    return [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_queue_is_empty_when_all_is_done(spark):
    path, out, failed, mark = (io.scratch(spark) for _ in range(4))
    for k in range(3):
        put(spark, path, [(f"{k}{x}", x, None) for x in range(4)])
    put(spark, path, [("00", 0, None), (None, 7, None)])
    tried = lambda df: df.withColumn("error", F.when((F.col("t") == 3) | ((F.col("t") == 2) & (F.col("tries") < 3)), "bad"))
    K.work_queue(spark, path, SCHEMA, tried, out, failed, ["k"], mark, tries=3)
    assert files(path) == []
    done, bad = spark.read.parquet(out).select("k", "t").collect(), spark.read.parquet(failed).select("k", "tries", "error").collect()
    assert sorted((str(r.k), r.t) for r in done) == sorted([*[(f"{k}{x}", x) for k in range(3) for x in range(3)], ("None", 7)])
    assert sorted(tuple(r) for r in bad) == [(f"{k}3", 3, "bad") for k in range(3)]
    assert K.work_queue(spark, path, SCHEMA, tried, out, failed, ["k"], mark) == 0


def test_a_batch_that_breaks_off_loses_nothing(spark):
    path, out, failed, mark = (io.scratch(spark) for _ in range(4))
    for k in range(3):
        put(spark, path, [(f"{k}{x}", x, None) for x in range(3)])
    broken = []

    def work(batch):
        if len(broken) < 2 and (batch.filter("k = '10'").count() or broken):
            broken.append(1)
            raise RuntimeError("the machine is gone")
        return batch.withColumn("error", F.lit(None).cast("string"))

    for _turn in range(2):
        with pytest.raises(Exception, match="the machine is gone"):
            K.work_queue(spark, path, SCHEMA, work, out, failed, ["k"], mark)
        assert len(files(path)) >= 2
    K.work_queue(spark, path, SCHEMA, work, out, failed, ["k"], mark)
    assert files(path) == [] and spark.read.parquet(out).count() == 9 and spark.read.parquet(out).distinct().count() == 9


def test_batched_calls_count_and_order(spark, tmp_path):
    """ceil(rows / size) calls a task, over the edges of Arrow batches, no more at once than there are threads; answers in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        log = str(tmp_path)

        def fn(rows, state={}):  # noqa: B006
            lock = state.setdefault("lock", threading.Lock())  # a lock can't be sent, so it is made in the worker
            with lock:
                state["now"] = state.get("now", 0) + 1
                assert state["now"] <= 3
            time.sleep(0.002 * (rows[0]["id"] % 3))
            open(f"{log}/{rows[0]['id']}", "w").close()
            with lock:
                state["now"] -= 1
            return [-r["id"] for r in rows]

        df = spark.range(0, 103, 1, 2)
        out = C.batched_calls(df, fn, 10, workers=3, tries=1, kind="long").collect()
        assert [(r.id, r.answer, r.error, r.calls) for r in out] == [(i, -i, None, 1) for i in range(103)]
        assert len(os.listdir(log)) == 12  # 51 and 52 rows
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_failing_calls_are_repeated_and_reported(spark):
    def fn(rows, seen={}):  # noqa: B006
        key = rows[0]["id"]
        seen[key] = seen.get(key, 0) + 1
        if key == 4 and seen[key] < 3:
            raise OSError("busy")
        if key == 8:
            raise KeyError("never")
        if key == 12:
            return ["one answer"]
        return ["x"] * len(rows) if key != 16 else [object()] * len(rows)

    out = C.batched_calls(spark.range(0, 20, 1, 1), fn, 4, tries=3, wait=0.0).collect()
    got = {r.id: (r.answer, r.error, r.calls) for r in out}
    assert got[0] == ("x", None, 1) and got[5] == ("x", None, 3)
    assert got[9] == (None, "KeyError: 'never'", 3) and got[13] == (None, "1 answers for 4 rows", 3)
    assert got[17][0] is None and got[17][1].startswith("Arrow")
    with pytest.raises(ValueError):
        C.batched_calls(spark.range(1).withColumn("Answer", F.lit(1)), fn, 4)
    assert C.batched_calls(spark.range(0), fn, 4).count() == 0


def test_answers_of_single_rows_go_on_in_large_batches(spark):
    """One call for each row, in order; answers of a wrong type and failures stay with their row."""
    def fn(rows):
        k = rows[0]["k"]
        if k % 100 == 7:
            raise ValueError(k)
        return [k if k % 100 == 9 else str(k)]

    class Batches:
        def __init__(self, df):
            self.df, self.columns, self.schema = df, df.columns, df.schema

        def mapInArrow(self, run, _schema):
            return [b.num_rows for b in run(iter(self.df.toArrow().to_batches()))]

    rows = spark.range(0, 2500, 1, 1).withColumnRenamed("id", "k")
    assert C.batched_calls(Batches(rows), fn, 1, tries=2, wait=0.0) == [1000, 1000, 500]
    out = C.batched_calls(rows, fn, 1, tries=2, wait=0.0).collect()
    assert [r.k for r in out] == list(range(2500))
    assert all(r.answer == (None if r.k % 100 in (7, 9) else str(r.k)) and r.calls == (2 if r.k % 100 == 7 else 1) and (r.error is not None) == (r.answer is None) for r in out)
