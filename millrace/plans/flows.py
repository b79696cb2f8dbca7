"""Streams with state and queues, routed and cached rows, batched calls (inventory I34, K1 to K3, L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import jobs as J
from ..sources import io
from ..sources.io import read_table as T
from ..streaming import collect as K

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col
FILES = 1000


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _events(s, d):
    return T(s, d, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query("k1_collect_first", "SELECT user_id, event_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)) AS at FROM events WHERE user_id >= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(s, d):
    # the events arrive in four parts by time, each after a restart
    e, path, out, mark = _events(s, d), io.scratch(s), io.scratch(s), io.scratch(s)
    known = e.filter("user_id < 20").select("user_id")
    first, last = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    part = F.floor(4 * (F.unix_seconds("ts") - F.lit(first)) / F.lit((last or 0) - (first or 0) + 1))
    for k in range(4):
        e.filter(part == k).write.mode("append").parquet(path)
        # each part is one batch, however many files it has
        stream = K.collect_first(K.read_stream(s, path, e.schema, 2**31 - 1), known, "user_id", ["ts", "event_id"])
        K.drain(stream, K.once(K.insert_into(out, ["user_id"])), mark)
    return s.read.parquet(out).select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at"))


@query("k3_work_queue", """SELECT event_id, user_id, event_type || '!' AS result, NULL AS tries FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT event_id, user_id, NULL, 3 FROM events WHERE event_id % 50 = 0""")
def _(s, d):
    # some rows fail always, some at first
    e, path, out, failed = _events(s, d).select("event_id", "user_id", "event_type"), io.scratch(s), io.scratch(s), io.scratch(s)
    e.withColumn("tries", F.lit(0)).write.parquet(path)

    def work(batch):
        bad = (c("event_id") % 50 == 0) | ((c("user_id") % 7 == 0) & (c("tries") < 2))
        return batch.withColumn("error", F.when(bad, "no answer"))

    K.work_queue(s, path, "event_id long, user_id long, event_type string", work, out, failed, ["event_id"], io.scratch(s), files_per_trigger=FILES)
    done = s.read.parquet(out).select("event_id", "user_id", F.concat("event_type", F.lit("!")).alias("result"), F.lit(None).cast("int").alias("tries"))
    return done.union(s.read.parquet(failed).select("event_id", "user_id", F.lit(None).cast("string"), "tries"))


@query("l3_batched_calls", "SELECT p_partkey, CASE WHEN p_size <> 13 THEN upper(p_name) END AS answer, CASE WHEN p_size = 13 THEN 'ValueError: size 13' END AS error, CASE WHEN p_size = 13 THEN 2 ELSE 1 END AS calls FROM part")
def _(s, d):
    def fn(rows):
        if any(r["p_size"] == 13 for r in rows):
            raise ValueError("size 13")
        return [r["p_name"].upper() for r in rows]

    # a call for one size each, as a call fails with all its rows
    parts = io.spread(T(s, d, "part").select("p_partkey", "p_name", "p_size"))
    return C.batched_calls(parts, fn, 1, workers=8, tries=2, wait=0.0).select("p_partkey", "answer", "error", "calls")


@query("k2_routed_rows", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def _(s, d):
    path, e = io.scratch(s), _events(s, d)
    e.write.parquet(path)
    targets = {"click": io.scratch(s), "purchase": io.scratch(s)}
    K.route_stream(K.read_stream(s, path, e.schema, FILES), "event_type", targets, ["event_id"], io.scratch(s))
    read = lambda t: s.read.schema(e.schema).parquet(targets[t]).filter(c("event_type") == t)
    return read("click").union(read("purchase")).select("event_id", "user_id", "event_type")


@query("i34_cached_rows", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'fetch' ELSE 'cached' END AS way, CASE WHEN page_id % 4 <> 0 THEN sha256(html) END AS digest FROM pages")
def _(s, d):
    # payloads are broken in four ways: no base 64, cut short, no compressed data, missing
    p = io.encode_payload(T(s, d, "pages").select("page_id", "html"), "html").drop("html")
    cut = F.substring("payload", 1, 40)
    broken = F.when(c("page_id") % 16 == 0, F.lit("no base 64!")).when(c("page_id") % 16 == 4, cut).when(c("page_id") % 16 == 8, F.lit("aGVsbG8="))
    ok, again = J.split_cached(p.withColumn("payload", F.when(c("page_id") % 4 == 0, broken).otherwise(c("payload"))), "payload")
    return ok.select("page_id", F.lit("cached").alias("way"), F.sha2("decoded", 256).alias("digest")).union(again.select("page_id", F.lit("fetch"), F.lit(None).cast("string")))
