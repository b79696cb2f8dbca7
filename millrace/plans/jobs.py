"""Data jobs, reports, sources and streams on the given tables (inventory A, I, J, K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import jobs as J
from ..operators import pages as P
from ..operators import relational as R
from ..operators import report as B
from ..sources import io
from ..sources.io import read_table as T
from ..streaming import collect as K
from .documents import PLACED, ordered, placed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


c = F.col
r2 = lambda x: F.round(x, 2)


# sources and sinks: the rows go out and come back
@query("a1_read_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(s, d):
    out = io.scratch(s)
    T(s, d, "nation").write.csv(out, header=True)
    return io.read_csv(s, out, "n_nationkey int, n_name string, n_regionkey int")


@query("a2_read_csv_labeled", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def _(s, d):
    out = io.scratch(s)
    T(s, d, "customer").select("c_custkey", "c_mktsegment").write.partitionBy("c_mktsegment").csv(out, header=True)
    return io.read_csv_labeled(s, out, "c_custkey long", "segment")


@query("a3_read_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    out = io.scratch(s)
    T(s, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(out)
    return io.read_partitioned(s, out, out).filter("o_orderstatus = 'F'")


@query("a4_dsv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d):
    out = io.scratch(s)
    io.write_dsv(T(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), out)
    return io.read_dsv(s, out, "s_suppkey long, s_name string, s_acctbal double")


@query("a5_union_tagged", "SELECT event_id, event_type, upper(event_type) AS title FROM events")
def _(s, d):
    out, e = io.scratch(s), T(s, d, "events")
    e.select("event_id", "event_type").write.partitionBy("event_type").csv(out, header=True)
    return io.union_tagged(s, out, "event_id long", e.select("event_type", F.upper("event_type").alias("title")).distinct(), "event_type")


@query("a6_numbered_answers", "SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INTEGER) AS number, trim(replace(text, chr(10), ' ')) AS answer FROM conversations")
def _(s, d):
    # all conversations in a fixed number of folders, each line with its conversation
    out, t = io.scratch(s), T(s, d, "conversations")
    line = F.concat((c("turn") + 1).cast("string"), F.lit(". "), c("conv_id").cast("string"), F.lit("\t"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))))
    t.select(line.alias("value"), F.pmod(F.xxhash64("conv_id"), F.lit(32)).alias("folder")).write.partitionBy("folder").text(out)
    return io.read_numbered_answers(s, out).select(F.substring_index("answer", "\t", 1).alias("file"), "number", F.expr("substring(answer, instr(answer, '\t') + 1)").alias("answer"))


@query("a14_dim_from_mapping", "SELECT r_name, code, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('AFRICA', 'AF'), ('AMERICA', 'AM'), ('ASIA', 'AS'), ('EUROPE', 'EU')) m(name, code) ON r_name = name GROUP BY 1, 2")
def _(s, d):
    dim = io.dim_from_mapping(s, {k: {"code": k[:2]} for k in ("AFRICA", "AMERICA", "ASIA", "EUROPE")}, "r_name")
    j = T(s, d, "nation").join(T(s, d, "region"), c("n_regionkey") == c("r_regionkey")).join(dim, "r_name")
    return j.groupBy("r_name", "code").agg(F.count("*").alias("nations"))


@query("a7_read_columns", "SELECT p_partkey, p_name, p_size FROM part")
def _(s, d):
    return io.read_columns(s, f"{d}/part.parquet", ["p_partkey", "p_name", "p_size"])


@query("a10_insert_ignore", "SELECT o_orderkey, o_custkey FROM orders")
def _(s, d):
    out, o = io.scratch(s), T(s, d, "orders").select("o_orderkey", "o_custkey")
    io.append(o.filter("o_orderkey % 2 = 0"), out)
    for _turn in range(2):
        io.insert_ignore(s, out, o, ["o_orderkey"])
    return s.read.parquet(out)


@query("a11_ensure_keys", "WITH b AS (SELECT DISTINCT p_brand FROM part), o AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS key FROM b QUALIFY key <= 10), n AS (SELECT p_brand, 10 + row_number() OVER (ORDER BY p_brand) AS key FROM b WHERE p_brand NOT IN (SELECT p_brand FROM o)) SELECT * FROM o UNION ALL SELECT * FROM n")
def _(s, d):
    names = T(s, d, "part").select("p_brand")
    first = names.distinct().orderBy("p_brand").limit(10)
    dim = io.ensure_keys(s.createDataFrame([], "key long, p_brand string"), first, "p_brand", "key")
    return io.ensure_keys(dim, names, "p_brand", "key")


@query("a12_write_sharded", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    out = io.scratch(s)
    io.write_sharded(T(s, d, "supplier").select("s_suppkey", "s_name"), out, 30)
    return io.read_csv(s, out, "s_suppkey long, s_name string")


@query("a13_decode_payload", "SELECT page_id, sha256(html) AS digest FROM pages")
def _(s, d):
    p = io.decode_payload(io.encode_payload(T(s, d, "pages").select("page_id", "html"), "html"), "payload")
    return p.select("page_id", F.sha2("decoded", 256).alias("digest"))


# jobs
@query("i1_snapshot_diff", "WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT day FROM g ORDER BY 1 DESC LIMIT 2) SELECT event_type, coalesce(CAST(sum(n) FILTER (day = (SELECT max(day) FROM t)) AS BIGINT), 0) AS newest, coalesce(CAST(sum(n) FILTER (day = (SELECT min(day) FROM t)) AS BIGINT), 0) AS previous, newest - previous AS change FROM g WHERE day IN (SELECT day FROM t) GROUP BY 1 HAVING newest <> previous")
def _(s, d):
    g = T(s, d, "events").groupBy("event_type", c("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return J.snapshot_diff(g, "event_type", "day", "n")


@query("i2_changed_keys", "WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), v AS (SELECT doc_id % 100 AS k, doc_id AS ts, h, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id DESC) AS r FROM d) SELECT k FROM v WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT h) = 2")
def _(s, d):
    v = T(s, d, "documents").select((c("doc_id") % 100).alias("k"), c("doc_id").alias("ts"), F.md5("text").alias("h"))
    return J.changed_keys(v, "k", "ts", ["h"])


@query("i3_archive_and_purge", "SELECT 'orders' AS name, o_orderkey AS k, NULL AS line, o_orderkey % 7 = 0 AS archived FROM orders UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, l_orderkey % 7 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) FROM lineitem")
def _(s, d):
    tables = {"orders": T(s, d, "orders").select(c("o_orderkey").alias("k"), F.lit(None).cast("int").alias("line")), "lineitem": T(s, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").cast("int").alias("line"))}
    keys = tables["orders"].filter("k % 7 = 0").select("k")
    return R.stack(*[x.select(F.lit(n).alias("name"), "k", "line", F.lit(gone).alias("archived")) for n, pair in J.archive_and_purge(tables, keys, "k").items() for x, gone in zip(pair, (True, False), strict=True)])


@query("i4_archive_rows", "SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, NULL AS quantity, 'refresh' AS reason, TIMESTAMP '2024-01-01' AS archived_at FROM orders UNION ALL SELECT 'lineitem', CAST(l_orderkey AS VARCHAR), NULL, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 'refresh', TIMESTAMP '2024-01-01' FROM lineitem")
def _(s, d):
    lines = T(s, d, "lineitem").select("l_orderkey", c("l_quantity").cast("int").alias("quantity"))
    return J.archive_rows({"orders": (T(s, d, "orders"), {"id": "o_orderkey", "status": "o_orderstatus"}), "lineitem": (lines, {"id": "l_orderkey", "quantity": "quantity"})}, ["id", "status", "quantity"], "refresh", "2024-01-01")


@query("i5_upsert_dictionary", "WITH o AS (SELECT lower(trim(p_brand)) AS k, min(p_type) AS v FROM part WHERE p_size < 25 GROUP BY 1), n AS (SELECT lower(trim(p_brand)) AS k, min(p_type) AS v FROM part WHERE p_size >= 25 GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.v WHEN n.k IS NOT NULL AND o.v <> n.v THEN n.v ELSE o.v END AS v, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NOT NULL AND o.v <> n.v THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.k = n.k")
def _(s, d):
    p = T(s, d, "part").select(F.lower("p_brand").alias("k"), c("p_type").alias("v"), "p_size")
    old, new = (x.groupBy("k").agg(F.min("v").alias("v")) for x in (p.filter("p_size < 25"), p.filter("p_size >= 25")))
    return J.upsert_dictionary(old, new, "k", "v")


@query("i6_load_bridge", "WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), r AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN 'unknown l_partkey' WHEN l_suppkey % 7 = 0 THEN 'unknown l_suppkey' WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'already there' END AS reason, l_partkey FROM p) SELECT reason, count(*) AS n, array_to_string((list_sort(list_distinct(list(l_partkey))))[:5], ',') AS examples FROM r WHERE reason IS NOT NULL GROUP BY 1")
def _(s, d):
    li = T(s, d, "lineitem").select("l_partkey", "l_suppkey")
    out = J.load_bridge(li, "l_partkey", li.filter("l_partkey % 5 <> 0"), "l_suppkey", li.filter("l_suppkey % 7 <> 0"), li.filter("(l_partkey + l_suppkey) % 3 = 0"))
    return J.reject_report(out, "l_partkey").withColumn("examples", F.array_join("examples", ","))


@query("i7_unify_label", "SELECT c_custkey, c_name, canonical FROM (SELECT *, first_value(c_name) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS canonical FROM customer) WHERE c_name <> canonical")
def _(s, d):
    return J.unify_label(T(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), "c_mktsegment", ["c_custkey"], "c_name").select("c_custkey", "c_name", "canonical")


@query("i8_flag_duplicate_ids", "WITH h AS (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY host ORDER BY length(url), url) = 1 AS short FROM h WINDOW w AS (PARTITION BY host)) SELECT page_id, host, CASE WHEN n = 2 THEN short WHEN n > 2 THEN NOT short ELSE false END AS flagged FROM n")
def _(s, d):
    p = T(s, d, "pages").select("page_id", "url", P.page_host("url").alias("host"))
    return J.flag_duplicate_ids(p, "host", "url").select("page_id", "host", "flagged")


@query("i9_purge_incomplete", "WITH h AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2 AND count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('O', 'P')) = 2) SELECT 'item' AS kind, c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM h) THEN 'new' ELSE 'done' END AS status FROM customer UNION ALL SELECT 'detail', o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM h)")
def _(s, d):
    o = T(s, d, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    items, details = J.purge_incomplete(T(s, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderstatus", ["O", "P"])
    return R.stack(items.select(F.lit("item").alias("kind"), c("c_custkey").alias("k"), "status"), details.select(F.lit("detail").alias("kind"), c("o_orderkey").alias("k"), c("o_orderstatus").alias("status")))


_LINES = "l AS (SELECT lang, doc_id % 5 AS part, TRY_CAST(substr(source, 4) AS INTEGER) % 2 AS half, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _overlap_sql(keys: str) -> str:
    """Shares as whole ten-thousandths, rounded half up."""
    return f"""WITH {_LINES},
u AS (SELECT {keys}, line, length(rtrim(line)) AS size, count(*) FILTER (half = 0) AS n, count(*) FILTER (half = 1) AS m FROM l GROUP BY {keys}, line),
z AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n_rows_now, CAST(sum(n * size) AS BIGINT) AS n_chars_now, CAST(sum(m) AS BIGINT) AS n_rows_archive, CAST(sum(m * size) AS BIGINT) AS n_chars_archive, CAST(sum(least(n, m)) AS BIGINT) AS n_rows_shared, CAST(sum(least(n, m) * size) AS BIGINT) AS n_chars_shared FROM u GROUP BY {keys} HAVING sum(n) > 0),
p AS (SELECT *, coalesce((n_chars_shared * 20000 + n_chars_now) // (2 * nullif(n_chars_now, 0)), 0) AS cs, (n_rows_shared * 20000 + n_rows_now) // (2 * n_rows_now) AS ls FROM z),
scored AS (SELECT * EXCLUDE (cs, ls), CAST(cs / 10000 AS DECIMAL(10, 4)) AS char_share, CAST(ls / 10000 AS DECIMAL(10, 4)) AS line_share, CAST(((7 * cs + 3 * ls + 5) // 10) / 10000 AS DECIMAL(10, 4)) AS score,
  CASE WHEN n_chars_now = n_chars_archive THEN 'equal' WHEN n_chars_now > n_chars_archive THEN 'more now' ELSE 'fewer now' END AS char_direction, CASE WHEN n_rows_now = n_rows_archive THEN 'equal' WHEN n_rows_now > n_rows_archive THEN 'more now' ELSE 'fewer now' END AS line_direction FROM p)"""


def _halves(s, d):
    """Lines of all documents: those of even sources, and those of odd ones."""
    half = F.expr("try_cast(substring(source, 4) AS int) % 2")
    lines = T(s, d, "documents").select("lang", (c("doc_id") % 5).alias("part"), half.alias("half"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("half = 0"), lines.filter("half = 1")


@query("i10_overlap_score", _overlap_sql("lang, part") + " SELECT * FROM scored")
def _(s, d):
    return J.overlap_score(*_halves(s, d), ["lang", "part"], "line")


@query("d16_bag_overlap", f"WITH {_LINES}, u AS (SELECT lang, line, count(*) FILTER (half = 0) AS n, count(*) FILTER (half = 1) AS m FROM l GROUP BY 1, 2) SELECT lang, CAST(sum(least(n, m)) AS BIGINT) AS rows, CAST(sum(least(n, m) * length(rtrim(line))) AS BIGINT) AS chars FROM u WHERE n > 0 AND m > 0 GROUP BY 1")
def _(s, d):
    return A.bag_overlap(*_halves(s, d), ["lang"], "line")


@query("i11_item_score", _overlap_sql("lang, part") + " SELECT lang, round(CAST(sum(score * n_chars_now) AS DOUBLE) / nullif(sum(n_chars_now), 0), 4) AS score FROM scored GROUP BY 1")
def _(s, d):
    return J.item_score(J.overlap_score(*_halves(s, d), ["lang", "part"], "line"), "lang")


@query("i12_route", "SELECT doc_id, CASE WHEN quality IS NULL OR quality <= 0.7 THEN 'automatic' ELSE 'manual' END AS way FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    auto, manual = J.route(T(s, d, "documents").select("doc_id").join(T(s, d, "labels"), "doc_id", "left"), "quality", 0.7)
    return R.stack(R.tag(auto, "way", "automatic"), R.tag(manual, "way", "manual")).select("doc_id", "way")


def _nested(s, d):
    """Conversations as documents: a map place -> text for each role; long ones are several documents (`section`)."""
    part = lambda role: F.map_from_entries(ordered(c("role") == role, F.struct(c("place").cast("string").alias("k"), c("text").alias("v"))))
    return placed(s, d).groupBy("conv_id", "section").agg(F.struct(part("user").alias("user"), part("assistant").alias("assistant")).alias("doc"))


@query("i13_flatten_document", f"WITH {PLACED} SELECT conv_id, role AS part, CAST(place AS INTEGER) AS line, text FROM p WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def _(s, d):
    return J.flatten_document(_nested(s, d), "conv_id", "doc", ["user", "assistant"])


@query("i14_flatten_blocks", f"WITH {PLACED} SELECT conv_id, CAST(place AS INTEGER) AS block, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS speaker_id, 1 AS line, text FROM p WHERE trim(text) <> ''")
def _(s, d):
    block = F.struct(c("place").cast("int").alias("id"), c("role").alias("speaker"), F.create_map(F.lit("1"), "text").alias("lines"))
    b = placed(s, d).groupBy("conv_id", "section").agg(F.collect_list(block).alias("blocks"))
    names = s.createDataFrame([("user", 1), ("assistant", 2), ("other", 0)], "name string, speaker_id int")
    return J.flatten_blocks(b, "conv_id", "blocks", names, "speaker_id", "other")


@query("i15_pick_branches", f"WITH {PLACED} SELECT conv_id, CAST(place AS VARCHAR) AS key, text FROM p WHERE role = 'user'")
def _(s, d):
    picked = J.pick_branches(_nested(s, d), "doc", ["user"]).select("conv_id", "doc.*")
    return S.map_rows(picked, "user").select("conv_id", "key", c("value").alias("text"))


@query("i16_validate_document", "SELECT conv_id, concat_ws(',', CASE WHEN count(*) FILTER (role = 'assistant') < 1 THEN 'has an answer' END, CASE WHEN count(*) FILTER (role = 'user') < 2 THEN 'two questions' END, CASE WHEN coalesce(max(length(text)) FILTER (role = 'user'), 0) > 200 THEN 'short questions' END) AS problems FROM conversations GROUP BY 1")
def _(s, d):
    # a conversation's rules are about all its sections together
    longest = F.array_max(F.transform(F.map_values("doc.user"), lambda x: F.length(x)))
    seen = _nested(s, d).select("conv_id", F.size(F.map_keys("doc.assistant")).alias("answers"), F.size(F.map_keys("doc.user")).alias("questions"), longest.alias("longest"))
    whole = seen.groupBy("conv_id").agg(F.sum("answers").alias("answers"), F.sum("questions").alias("questions"), F.max("longest").alias("longest"))
    rules = {"has an answer": c("answers") >= 1, "two questions": c("questions") >= 2, "short questions": F.coalesce("longest", F.lit(0)) <= 200}
    return J.validate_document(whole, rules).select("conv_id", F.array_join("problems", ",").alias("problems"))


@query("i17_review_sheet", "SELECT o_orderkey, status, CASE status WHEN 'original' THEN o_orderpriority ELSE '' END AS text, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey, (VALUES ('original'), ('approved')) v(status)")
def _(s, d):
    lines = T(s, d, "orders").select("o_orderkey", "o_custkey", c("o_orderpriority").alias("text"))
    return J.review_sheet(lines, ["o_orderkey"], "text", T(s, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_name").alias("name")), "o_custkey")


@query("i18_review_suggestions", "SELECT o_orderkey, o_orderstatus AS text FROM orders WHERE o_orderkey % 3 = 0")
def _(s, d):
    o = T(s, d, "orders")
    sheet = J.review_sheet(o.select("o_orderkey", "o_custkey", c("o_orderpriority").alias("text")), ["o_orderkey"], "text", T(s, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_name").alias("name")), "o_custkey", o.filter("o_orderkey % 3 = 0").select("o_orderkey", c("o_orderstatus").alias("text")))
    return sheet.filter("status = 'suggestion'").select("o_orderkey", "text")


@query("i19_approve", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE upper(o_orderpriority) END AS approved, sha256(o_orderpriority) AS original_key, CASE WHEN o_orderkey % 4 = 0 THEN 'no approved' WHEN o_orderkey % 5 = 0 THEN 'blank' END AS error FROM orders UNION ALL SELECT -o_orderkey - 1, 'left over', NULL, 'no original' FROM orders WHERE o_orderkey % 100 = 0")
def _(s, d):
    o = T(s, d, "orders")
    a = o.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.lit("approved").alias("status"), F.when(c("o_orderkey") % 5 == 0, "").otherwise(F.upper("o_orderpriority")).alias("text"))
    over = o.filter("o_orderkey % 100 = 0").select((-c("o_orderkey") - 1).alias("o_orderkey"), F.lit("approved").alias("status"), F.lit("left over").alias("text"))
    return J.approve(R.stack(o.select("o_orderkey", F.lit("original").alias("status"), c("o_orderpriority").alias("text")), a, over), ["o_orderkey"])


@query("i20_enrich", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN nullif(upper(p_type), 'X') ELSE p_type END AS p_type FROM part")
def _(s, d):
    p = T(s, d, "part").select("p_partkey", "p_type")
    return J.enrich(p, p.filter("p_partkey % 3 = 0").select("p_partkey", F.upper("p_type").alias("p_type")), "p_partkey", ["p_type"])


@query("i21_split_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'update' ELSE 'insert' END AS action FROM supplier")
def _(s, d):
    x = T(s, d, "supplier").select("s_suppkey")
    ins, upd = J.split_upsert(x.filter("s_suppkey % 2 = 0"), x, "s_suppkey")
    return R.stack(R.tag(ins, "action", "insert"), R.tag(upd, "action", "update"))


@query("i22_fill_missing", "SELECT c_custkey, c_nationkey FROM customer")
def _(s, d):
    x = T(s, d, "customer").select("c_custkey", "c_nationkey")
    return J.fill_missing(x.withColumn("c_nationkey", F.when(c("c_custkey") % 3 != 0, c("c_nationkey"))), x, "c_custkey", ["c_nationkey"])


@query("i23_fold_to_majority", "WITH j AS (SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT c_mktsegment, o_orderstatus AS top FROM (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM j GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderstatus) = 1) SELECT o_orderkey FROM j JOIN m USING (c_mktsegment) WHERE o_orderstatus <> top")
def _(s, d):
    j = T(s, d, "orders").join(T(s, d, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_mktsegment", "o_orderstatus")
    return J.fold_to_majority(j, "c_mktsegment", "o_orderstatus", c("o_orderstatus"))[1].select("o_orderkey")


@query("i24_line_counts", "SELECT role, who, count(*) AS n FROM (SELECT 'l_partkey' AS role, l_partkey AS who FROM lineitem UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem) GROUP BY 1, 2 HAVING count(*) >= 25")
def _(s, d):
    return J.line_counts(T(s, d, "lineitem"), ["l_partkey", "l_suppkey"], 25)


@query("i25_items_without", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(s, d):
    return J.items_without(T(s, d, "orders").select("o_orderkey"), T(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey")), on="o_orderkey")


@query("i26_stamp_changes", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 10 = 1 THEN TIMESTAMP '2024-01-01' END AS updated_at FROM supplier")
def _(s, d):
    x = T(s, d, "supplier").select("s_suppkey", "s_name")
    new = x.withColumn("s_name", F.when(c("s_suppkey") % 4 == 0, F.lower("s_name")).otherwise(c("s_name")))
    return J.stamp_changes(x.filter("s_suppkey % 10 <> 1"), new, "s_suppkey", ["s_name"], "2024-01-01").select("s_suppkey", "updated_at")


@query("i27_price_usage", "SELECT role, CAST(round(sum(((length(text) - length(text) // 4) * 2.5 + (length(text) // 4) * 0.25 + 7 * 10.0) / 1000000), 6) AS DOUBLE) AS cost FROM conversations GROUP BY 1")
def _(s, d):
    u = T(s, d, "conversations").select("role", F.lit("m").alias("model"), F.length("text").alias("input_tokens"), F.floor(F.length("text") / 4).alias("cached_tokens"), F.lit(7).alias("output_tokens"))
    prices = s.createDataFrame([("m", "2.5", "10")], "model string, input_price string, output_price string")
    return J.price_usage(u, prices).groupBy("role").agg(F.round(F.sum("cost"), 6).cast("double").alias("cost"))


@query("i28_check", "SELECT 'lineitem' AS table_name, 'l_orderkey, l_linenumber unique' AS expectation, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'lineitem', 'shipped after order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def _(s, d):
    j = T(s, d, "lineitem").join(T(s, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    a = J.check(T(s, d, "lineitem"), "lineitem", unique=["l_orderkey", "l_linenumber"], not_null=["l_partkey"], closed={"l_returnflag": ["A", "N", "R"]}, foreign={"l_partkey": T(s, d, "part").select("p_partkey")})
    return a.union(J.check(j, "lineitem", rules={"shipped after order": c("l_shipdate") >= c("o_orderdate")}))


@query("i29_extract_fields", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages")
def _(s, d):
    return P.extract_fields(T(s, d, "pages"), "page_id", "html").select("page_id", "lang", "n_links", "n_paragraphs")


_CANONICAL = r"CASE WHEN regexp_matches(x, '/$|/[^/]*\.[^/.]*$') AND NOT regexp_matches(x, '^[a-z]+://[^/]*$') THEN x ELSE x || '/' END"


@query("i30_new_links", f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS href FROM pages),
a AS (SELECT page_id, regexp_replace(trim(href), '[?#].*$', '') AS y FROM h),
b AS (SELECT page_id, CASE WHEN regexp_matches(y, '^[a-z]+://') THEN y ELSE 'https://site.example.org/' || regexp_replace(y, '^/+', '') END AS x FROM a),
u AS (SELECT page_id, {_CANONICAL} AS url FROM b)
SELECT DISTINCT url FROM u WHERE contains(url, 'example') AND url NOT IN (SELECT url FROM u WHERE page_id % 2 = 0)""")
def _(s, d):
    p = T(s, d, "pages")
    seen = P.links(p.filter("page_id % 2 = 0"), "html", "https://site.example.org")
    return P.new_links(p, "html", seen, "example", "https://site.example.org")


@query("i31_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def _(s, d):
    o = T(s, d, "orders").select("o_orderkey")
    return J.pending(o, o.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("i32_missing_cells", "SELECT user_id, day FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events")
def _(s, d):
    e = T(s, d, "events").select("user_id", c("ts").cast("date").alias("day"))
    return J.missing_cells(e.select("user_id").distinct(), e.select("day").distinct(), e.distinct())


@query("i33_explode_shares", "WITH g AS (SELECT l_suppkey, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, name, round(100.0 * n / sum(n) OVER (PARTITION BY l_suppkey), 1) AS pct FROM g WHERE l_suppkey % 10 <> 0")
def _(s, d):
    g = T(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    x = A.with_group_stats(g, ["l_suppkey"], {"whole": F.sum("n")})
    item = F.concat("l_returnflag", F.lit(" "), J.percent_text(c("n"), c("whole")))
    lists = x.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("shares"))
    lists = lists.withColumn("shares", F.when(c("l_suppkey") % 10 == 0, "none").otherwise(c("shares")))
    return J.explode_shares(lists, ["l_suppkey"], "shares")


@query("i34_split_cached", "SELECT page_id % 4 <> 0 AS ok, count(*) AS n FROM pages GROUP BY 1")
def _(s, d):
    p = io.encode_payload(T(s, d, "pages").select("page_id", "html"), "html").drop("html")
    ok, again = J.split_cached(p.withColumn("payload", F.when(c("page_id") % 4 == 0, "broken!").otherwise(c("payload"))), "payload")
    return ok.select(F.lit(True).alias("ok")).union(again.select(F.lit(False))).groupBy("ok").agg(F.count("*").alias("n"))


@query("i35_progress", "WITH j AS (SELECT r_name, n_name, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT level, name, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM (SELECT 'r_name' AS level, r_name AS name, o_orderstatus FROM j UNION ALL SELECT 'n_name', n_name, o_orderstatus FROM j UNION ALL SELECT 'c_mktsegment', c_mktsegment, o_orderstatus FROM j) GROUP BY 1, 2")
def _(s, d):
    j = R.join_dims(T(s, d, "orders"), [(T(s, d, "customer"), c("o_custkey") == c("c_custkey")), (T(s, d, "nation"), c("c_nationkey") == c("n_nationkey")), (T(s, d, "region"), c("n_regionkey") == c("r_regionkey"))])
    return J.progress(j, ["r_name", "n_name", "c_mktsegment"], c("o_orderstatus") == "F")


# twice, as a match takes the sign after the word, which may be the sign before the next one
_WORD = r"'(^|[^\p{L}\p{N}])(?i:the)($|[^\p{L}\p{N}])', '\1{word}\2', 'g'"


@query("i36_templatize", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, {_WORD}), {_WORD})) AS digest FROM documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", F.md5(J.templatize("text", {"the": "{word}"})).alias("digest"))


@query("i37_translate", "WITH p AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS part FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), d AS (SELECT DISTINCT lower(trim(part)) AS s FROM p WHERE doc_id % 10 = 0) SELECT doc_id, sha256(string_agg(CASE WHEN s IS NOT NULL THEN '#' || s ELSE part END, chr(10) ORDER BY i)) AS digest FROM p LEFT JOIN d ON lower(trim(part)) = s GROUP BY 1")
def _(s, d):
    docs = T(s, d, "documents").select("doc_id", "text")
    words = docs.filter("doc_id % 10 = 0").select(F.explode(F.split("text", "\n")).alias("source")).withColumn("target", F.concat(F.lit("#"), F.lower(F.trim("source"))))
    return J.translate(docs, "doc_id", "text", words).select("doc_id", F.sha2("translated", 256).alias("digest"))


@query("i38_translate_core", "SELECT o_orderkey, '[' || o_orderstatus || '] ' || upper(o_orderpriority) || ' ' || CAST(o_orderkey % 5 AS VARCHAR) || '/5' AS translated FROM orders")
def _(s, d):
    o = T(s, d, "orders")
    words = o.select(c("o_orderpriority").alias("source"), F.upper("o_orderpriority").alias("target")).distinct()
    return J.translate_core(o.select("o_orderkey", F.concat(F.lit("["), "o_orderstatus", F.lit("] "), "o_orderpriority", F.lit(" "), (c("o_orderkey") % 5).cast("string"), F.lit("/5")).alias("t")), "o_orderkey", "t", words)


@query("d12_full_text", "SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY 1")
def _(s, d):
    return J.full_text(T(s, d, "conversations"), ["conv_id"], "turn", ["role", "text"])


# reports
@query("j1_ytd", "WITH g AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT day, round(t, 2) AS total, round(sum(t) OVER (PARTITION BY year(day) ORDER BY day), 2) AS ytd FROM g")
def _(s, d):
    return B.ytd(T(s, d, "orders"), "o_orderdate", "o_totalprice").select("day", r2("total").alias("total"), r2("ytd").alias("ytd"))


@query("j2_vs_budget", "WITH a AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, CASE WHEN n >= 3000 THEN printf('surplus %.2f', n - 3000) ELSE printf('deficit %.2f', 3000 - n) END AS note FROM a")
def _(s, d):
    a = T(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("actual"))
    return B.vs_budget(a, a.select("o_orderpriority", F.lit(3000.0).alias("budget")), "o_orderpriority").select("o_orderpriority", "note")


@query("j3_above_mean_label", "SELECT c_custkey, CASE WHEN c_acctbal >= (SELECT avg(c_acctbal) FROM customer) THEN 'above' ELSE 'below' END AS label FROM customer")
def _(s, d):
    return B.above_mean_label(T(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "label")


@query("j4_measure", "SELECT l_returnflag, round(sum(l_extendedprice), 0) AS gross, round(sum(l_extendedprice * (1 - l_discount)), 0) AS net, round(sum(l_quantity), 0) AS quantity FROM lineitem GROUP BY 1")
def _(s, d):
    return A.summarise(T(s, d, "lineitem"), ["l_returnflag"], {m: F.round(B.measure(m), 0) for m in ("gross", "net", "quantity")})


@query("j5_trend", "WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS total FROM orders GROUP BY 1) SELECT month, total, round(100.0 * (total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month), 2) AS change_pct, round((SELECT avg(total) FROM g), 6) AS mean FROM g")
def _(s, d):
    return B.trend(T(s, d, "orders").withColumn("one", F.lit(1)), "o_orderdate", "one").select("month", "total", "change_pct", F.round("mean", 6).alias("mean"))


@query("j7_returns", "SELECT event_id, round((100 + value) / first_value(100 + value) OVER w - 1, 6) AS since_first, round((100 + value) / lag(100 + value, 2) OVER w - 1, 6) AS return_2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(s, d):
    x = B.returns(T(s, d, "events").withColumn("price", 100 + c("value")), "user_id", "event_id", "price", [2])
    return x.select("event_id", F.round("since_first", 6).alias("since_first"), F.round("return_2", 6).alias("return_2"))


@query("j8_by_dim", "WITH t AS (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 3) SELECT n_name, p_brand, round(sum(l_quantity), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_brand IN (SELECT p_brand FROM t) GROUP BY 1, 2")
def _(s, d):
    j = R.join_dims(T(s, d, "lineitem"), [(T(s, d, "part"), c("l_partkey") == c("p_partkey")), (T(s, d, "supplier"), c("l_suppkey") == c("s_suppkey")), (T(s, d, "nation"), c("s_nationkey") == c("n_nationkey"))])
    return B.by_dim(j, "n_name", "p_brand", "l_quantity", 3).select("n_name", "p_brand", r2("value").alias("value"))


# streams, drained and read as tables; a batch takes so many files at most
FILES = 1000


def _staged(s, d):
    out, e = io.scratch(s), T(s, d, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    e.write.parquet(out)
    return out, e.schema


@query("k1_collect_unseen", "SELECT DISTINCT user_id FROM events WHERE user_id >= 20")
def _(s, d):
    path, schema = _staged(s, d)
    known = T(s, d, "events").filter("user_id < 20").select("user_id")
    out = io.scratch(s)
    K.drain(K.collect_unseen(K.read_stream(s, path, schema, FILES), known, "user_id", "ts", "40 days"), K.insert_into(out, ["user_id"]), io.scratch(s))
    return s.read.parquet(out).select("user_id")


@query("k2_route_stream", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def _(s, d):
    path, schema = _staged(s, d)
    targets = {"click": io.scratch(s), "purchase": io.scratch(s)}
    K.route_stream(K.read_stream(s, path, schema, FILES), "event_type", targets, ["event_id"], io.scratch(s))
    return R.stack(*[s.read.parquet(t) for t in targets.values()]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("k3_drain_queue", "SELECT event_id, user_id FROM events")
def _(s, d):
    path, schema = _staged(s, d)
    out, mark = io.scratch(s), io.scratch(s)
    for _turn in range(2):
        K.drain_queue(s, path, schema, out, ["event_id"], mark)
    return s.read.parquet(out).select("event_id", "user_id")


@query("l3_batched_apply", "SELECT s_suppkey, upper(s_name) AS answer FROM supplier")
def _(s, d):
    return P.batched_apply(T(s, d, "supplier").select("s_suppkey", "s_name"), lambda rows: [r["s_name"].upper() for r in rows], 50).drop("s_name")
