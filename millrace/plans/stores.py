"""Databases, distinct counts by level, exact medians, links to their end, checked writes, reviews and page fields
(inventory A6, A8, D2, E17, I3, I17 to I20, I28 to I30)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import jobs as J
from ..operators import pages as P
from ..operators import relational as R
from ..operators import review as V
from ..sources import database, io
from ..sources.io import read_table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("a8_database", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 AND o_orderstatus IN ('F', 'P')")
def _(s, d):
    path = database.local(io.scratch(s)) + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    database.write_database(T(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, "orders")
    return database.read_database(s, path, "orders", "o_orderkey long, o_orderstatus string", "o_orderkey").filter("o_orderkey > 1000 AND o_orderstatus IN ('F', 'P')")


_JOINED = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("d2_distinct_by_levels", f"""SELECT 'all' AS level, '' AS name, count(DISTINCT o_custkey) AS n {_JOINED} UNION ALL SELECT 'region', r_name, count(DISTINCT o_custkey) {_JOINED} GROUP BY r_name
UNION ALL SELECT 'nation', r_name || '/' || n_name, count(DISTINCT o_custkey) {_JOINED} GROUP BY r_name, n_name UNION ALL SELECT 'segment', r_name || '/' || n_name || '/' || c_mktsegment, count(DISTINCT o_custkey) {_JOINED} GROUP BY r_name, n_name, c_mktsegment""")
def _(s, d):
    j = R.join_dims(T(s, d, "orders"), [(T(s, d, "customer"), c("o_custkey") == c("c_custkey")), (T(s, d, "nation"), c("c_nationkey") == c("n_nationkey")), (T(s, d, "region"), c("n_regionkey") == c("r_regionkey"))])
    levels = {"all": [], "region": ["r_name"], "nation": ["r_name", "n_name"], "segment": ["r_name", "n_name", "c_mktsegment"]}
    return A.distinct_by_levels(j, levels, "o_custkey")


@query("e17_exact_median", "SELECT 'all' AS flag, count(*) AS n, median(l_extendedprice) AS median FROM lineitem UNION ALL SELECT l_returnflag, count(*), median(l_extendedprice) FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    # segments of 20000 rows, so that groups are split on small tables too
    x = T(s, d, "lineitem").select(c("l_returnflag").alias("flag"), "l_extendedprice")
    whole = A.exact_median(x, [], "l_extendedprice", 20_000).select(F.lit("all").alias("flag"), "n", "median")
    return whole.union(A.exact_median(x, ["flag"], "l_extendedprice", 20_000))


# pages of customers that link to two others each, to one of another site and to none of a third
_GRAPH = """n AS (SELECT count(*) AS n FROM customer), e AS (SELECT c_custkey AS a, unnest([(c_custkey * 3 + 1) % n, (c_custkey + c_nationkey * 7) % n]) AS b FROM customer, n),
x AS (SELECT DISTINCT 'https://site.example.org/c/' || a || '/' AS parent, 'https://site.example.org/c/' || b || '/' AS url FROM e WHERE a <> b)"""


@query("i30_frontier", f"""WITH RECURSIVE {_GRAPH}, f AS (SELECT 'https://site.example.org/c/1/' AS url, 0 AS level UNION SELECT x.url, f.level + 1 FROM f JOIN x ON x.parent = f.url WHERE f.level < 60),
l AS (SELECT url, min(level) AS level FROM f GROUP BY url) SELECT l.url, l.level, min(p.url) AS parent FROM l LEFT JOIN x ON x.url = l.url LEFT JOIN l p ON p.url = x.parent AND p.level = l.level - 1 GROUP BY l.url, l.level""")
def _(s, d):
    k = T(s, d, "customer").select("c_custkey", "c_nationkey")
    n = k.agg(F.count("*").alias("n"))
    k = io.spread(k).crossJoin(F.broadcast(n))  # one row
    link = lambda x: F.concat(F.lit('<a href="/c/'), x.cast("string"), F.lit('?from=here">more</a> '))
    html = F.concat(F.lit("<p>"), link((c("c_custkey") * 3 + 1) % c("n")), link((c("c_custkey") + c("c_nationkey") * 7) % c("n")), F.lit('<a href="https://other.example.net/x">away</a></p>'))
    pages = k.select(F.concat(F.lit("https://site.example.org/c/"), c("c_custkey").cast("string"), F.lit("/")).alias("url"), html.alias("html"))
    seeds = s.createDataFrame([("https://site.example.org/c/1",)], "url string")
    return P.frontier(pages, "url", "html", seeds, r"^https://site\.example\.org/", "https://site.example.org").select("url", "level", "parent")


@query("i28_checked_write", """SELECT 'lineitem' AS table_name, * FROM (SELECT 'l_comment not null' AS expectation, count(*) AS n FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT 'l_shipmode in list', count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'some quantity', count(*) FROM lineitem WHERE l_quantity <= 5 UNION ALL SELECT 'l_orderkey unique', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'l_orderkey, l_linenumber unique', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'l_partkey known', count(*) FROM lineitem WHERE l_partkey % 50 = 0) WHERE n > 0""")
def _(s, d):
    x = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", c("l_returnflag").alias("l_shipmode"), F.when(c("l_linenumber") != 7, "x").alias("l_comment"))
    dim = T(s, d, "part").filter("p_partkey % 50 <> 0").select("p_partkey")
    return J.checked_write(x, io.scratch(s), "lineitem", not_null=["l_comment", "l_orderkey"], closed={"l_shipmode": ["A", "N"]}, rules={"some quantity": c("l_quantity") > 5}, unique=[["l_orderkey"], ["l_orderkey", "l_linenumber"]], foreign={"l_partkey": dim})


@query("i3_requeue", """WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0), t AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem)
SELECT 'queue' AS what, k, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-01' END AS queued_at, 1 AS n FROM g
UNION ALL SELECT CASE WHEN k % 7 = 0 THEN 'archived' ELSE 'kept' END, k, NULL, count(*) FROM t GROUP BY 1, 2""")
def _(s, d):
    o = T(s, d, "orders").select(c("o_orderkey").alias("k"))
    keys = o.filter("k % 7 = 0").union(s.createDataFrame([(-7,)], "k long"))  # and one that no table has
    queue = o.filter("k % 14 = 0").select("k", F.lit("2023-01-01").cast("timestamp").alias("queued_at"))
    moved, after = J.requeue({"orders": o, "lineitem": T(s, d, "lineitem").select(c("l_orderkey").alias("k"))}, queue, keys, "k", "2024-01-01")
    side = lambda i, what: R.stack(*[m[i] for m in moved.values()]).groupBy("k").agg(F.count("*").cast("int").alias("n")).select(F.lit(what).alias("what"), "k", F.lit(None).cast("timestamp").alias("queued_at"), "n")
    return after.select(F.lit("queue").alias("what"), "k", "queued_at", F.lit(1).alias("n")).union(side(0, "archived")).union(side(1, "kept"))


@query("a6_answers_by_file", """SELECT 'answers ' || lpad(CAST(conv_id % 32 AS VARCHAR), 2, '0') AS file, CAST(turn + 1 AS INTEGER) AS number, sha256(ltrim(trim(replace(coalesce(text, ''), chr(10), ' ')), ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS answer, count(*) AS n FROM conversations GROUP BY 1, 2, 3""")
def _(s, d):
    # the file's name is all that says which answers these are
    out, t = io.scratch(s), T(s, d, "conversations")
    text = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    name = F.concat(F.lit("answers "), F.lpad((c("conv_id") % 32).cast("string"), 2, "0"))
    t.select(F.concat((c("turn") + 1).cast("string"), F.lit(". "), text).alias("value"), name.alias("file")).write.partitionBy("file").text(out)
    read = io.read_numbered_answers(s, out).withColumn("file", F.url_decode(F.regexp_replace("file", "^file=", "")))
    return read.groupBy("file", "number", F.sha2("answer", 256).alias("answer")).agg(F.count("*").alias("n"))


# sheets: titles of customers, lines of orders, an archive with two suggestions for some places
def _sheet(s, d):
    o, cu = T(s, d, "orders"), T(s, d, "customer")
    lines = o.select(c("o_custkey").alias("item"), F.when(c("o_orderstatus") == "F", "GOAL").when(c("o_orderstatus") == "O", "TEXT").otherwise("OTHER").alias("segment"), F.when(c("o_orderkey") % 2 == 0, "main").alias("sub"), c("o_orderkey").cast("string").alias("block"), F.lit(None).cast("string").alias("line"), c("o_orderpriority").alias("text"))
    titles = cu.select(c("c_custkey").alias("item"), c("c_name").alias("title_a"), F.upper("c_name").alias("title_b"))
    names = {"place": cu.join(T(s, d, "nation"), c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("item"), c("n_name").alias("name"))}
    old = o.filter("o_orderkey % 3 = 0").select(c("o_custkey").alias("item"), F.when(c("o_orderstatus") == "F", "GOAL").when(c("o_orderstatus") == "O", "TEXT").otherwise("OTHER").alias("segment"), F.when(c("o_orderkey") % 2 == 0, " main ").otherwise("").alias("sub"), F.concat(c("o_orderkey").cast("string"), F.lit(".0")).alias("block"), F.lit("1").alias("line"), "o_orderpriority")
    archive = old.withColumns({"rank": F.lit(2), "text": F.lit("second")}).union(old.withColumns({"rank": F.lit(1), "text": F.concat(F.lit("old "), "o_orderpriority")})).drop("o_orderpriority")
    return V.build_sheet(lines, titles, {"title_a": "original", "title_b": "approved"}, ["TITLE", "GOAL", "TEXT"], names, archive, [c("rank")])


_SHEET = """l AS (SELECT o_custkey AS item, CASE o_orderstatus WHEN 'F' THEN 'GOAL' WHEN 'O' THEN 'TEXT' ELSE 'OTHER' END AS segment, CASE WHEN o_orderkey % 2 = 0 THEN 'main' END AS sub, CAST(o_orderkey AS VARCHAR) AS block, CAST(NULL AS VARCHAR) AS line, o_orderpriority AS text, o_orderkey FROM orders),
r AS (SELECT item, segment, sub, block, line, 'original' AS status, text FROM l UNION ALL SELECT item, segment, sub, block, line, 'approved', '' FROM l
  UNION ALL SELECT item, segment, sub, block, line, 'suggestion', CASE WHEN o_orderkey % 3 = 0 THEN 'old ' || text ELSE '' END FROM l
  UNION ALL SELECT c_custkey, 'TITLE', '', '1', '1', 'original', c_name FROM customer UNION ALL SELECT c_custkey, 'TITLE', '', '1', '1', 'approved', upper(c_name) FROM customer)"""


@query("i17_review_full", f"""WITH {_SHEET} SELECT r.*, n_name AS place, CASE segment WHEN 'TITLE' THEN 1 WHEN 'GOAL' THEN 2 WHEN 'TEXT' THEN 3 ELSE 4 END AS segment_order FROM r LEFT JOIN customer ON c_custkey = item LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(s, d):
    return _sheet(s, d)


@query("i19_load_approved", f"""WITH {_SHEET}, p AS (SELECT item, segment, coalesce(sub, '') AS sub, CAST(block AS INTEGER) AS block, text, CAST(block AS INTEGER) % 5 = 0 AND segment <> 'TITLE' AS lost, CAST(block AS INTEGER) % 7 = 0 AND segment <> 'TITLE' AS twice,
  CAST(block AS INTEGER) % 11 = 0 AND segment <> 'TITLE' AS blank, c_nationkey AS nation, n_name FROM r JOIN customer ON c_custkey = item JOIN nation ON n_nationkey = c_nationkey WHERE status = 'original'),
e AS (SELECT *, concat_ws(';', CASE WHEN lost THEN 'no original' END, CASE WHEN twice THEN 'repeated approved' END, CASE WHEN blank THEN 'blank' END, CASE WHEN nation = 3 THEN 'unknown name' END, CASE WHEN nation = 4 THEN 'ambiguous name' END) AS errors FROM p)
SELECT item, segment, sub, block, 1 AS line, CASE WHEN errors = '' THEN CASE WHEN segment = 'TITLE' THEN upper(text) ELSE '=' || text END END AS approved, CASE WHEN errors = '' THEN sha256(text) END AS original_hash, CASE WHEN errors = '' THEN nation END AS name_id,
  CASE WHEN errors = '' THEN '3_APPROVED' END AS status, errors FROM e""")
def _(s, d):
    # the sheet comes back: texts filled in, some originals lost, some rows twice, some left blank
    sheet = _sheet(s, d)
    number = c("block").cast("int")
    title, original, approved = c("segment") == "TITLE", c("status") == "original", c("status") == "approved"
    first = sheet.filter(original).select("item", "segment", "block", c("text").alias("was"))
    back = sheet.join(first, ["item", "segment", "block"]).filter(title | ~original | (number % 5 != 0))
    text = F.when(title | ~approved, c("text")).when(number % 11 == 0, "  ").otherwise(F.concat(F.lit("="), "was"))
    back = back.withColumns({"text": text, "place": F.concat(F.lit(" "), F.lower("place"))}).drop("was")
    back = back.union(back.filter(~title & approved & (number % 7 == 0)))
    nations = T(s, d, "nation").filter("n_nationkey <> 3").select(c("n_name").alias("name"), c("n_nationkey").cast("long").alias("id"))
    nations = nations.union(nations.filter("id = 4").withColumn("id", F.lit(400).cast("long")))
    rows, errors = V.load_approved(back, nations, "place")
    cols = ["item", "segment", "sub", "block", "line"]
    wrong = errors.select(*cols, *[F.lit(None).cast(k).alias(n) for n, k in (("approved", "string"), ("original_hash", "string"), ("name_id", "long"), ("status", "string"))], F.array_join("errors", ";").alias("errors"))
    return rows.select(*cols, "approved", "original_hash", "name_id", "status", F.lit("").alias("errors")).union(wrong)


@query("i20_enrich_two_keys", """SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) END ELSE p_type END AS p_type, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 6 <> 0 THEN 2 END AS repeated FROM part""")
def _(s, d):
    p = T(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    new = p.filter("p_partkey % 3 = 0").select("p_partkey", "p_brand", F.when(c("p_partkey") % 2 == 0, F.upper("p_type")).alias("p_type"), (c("p_size") + 1).alias("p_size"), F.lit(2).alias("at"))
    new = new.union(new.filter("p_partkey % 6 <> 0").select("p_partkey", "p_brand", F.lit("older").alias("p_type"), F.lit(0).alias("p_size"), F.lit(1).alias("at")))
    new = new.union(new.select("p_partkey", F.lit("another brand"), "p_type", "p_size", "at"))
    repeated = J.repeated_keys(new, ["p_partkey", "p_brand"]).select("p_partkey", "p_brand", c("n").cast("int").alias("repeated"))
    return J.enrich(p, new, ["p_partkey", "p_brand"], ["p_type", "p_size"], ["at"]).join(repeated, ["p_partkey", "p_brand"], "left")


@query("i29_page_fields", """SELECT p_partkey, p_name AS title, 'en' AS lang, p_brand AS heading, 1 AS n_links, 2 AS n_paragraphs, p_size AS size, CAST(p_size AS DOUBLE) + 0.5 AS share, CASE WHEN p_partkey % 4 <> 0 THEN DATE '2024-03-01' END AS since, 'x & ' || p_type AS kind, CAST(NULL AS VARCHAR) AS missing FROM part""")
def _(s, d):
    p = io.spread(T(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    size = c("p_size").cast("string")
    html = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><title> '), "p_name", F.lit("</title><script>var a = '<h1>no</h1>';</script></head><body><h1>"), "p_brand", F.lit("</h1><p>Some text<p>Share: "), size, F.lit(',5 %<dl><dt>Size<dd>'), size, F.lit("<dt>Kind</dt><dd>x &amp; "), "p_type", F.lit("</dd></dl><table><tr><th>Since<td>"), F.when(c("p_partkey") % 4 == 0, "unknown").otherwise("1.3.2024"), F.lit('</table><a href="/x">go</a>'))
    fields = P.page_fields(p.select("p_partkey", html.alias("html")), "p_partkey", "html")
    return P.typed_fields(fields, "p_partkey", {"size": ("size", "int"), "share": ("Share", "double"), "since": ("since", "date"), "kind": ("kind", "string"), "missing": ("nothing", "string")}, ("title", "lang", "heading", "n_links", "n_paragraphs"))
