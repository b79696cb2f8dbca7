"""Filters, joins, sorting and set operations on the given tables (inventory B, C, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import relational as R
from ..sources.io import read_table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


c = F.col
day = lambda x: c(x).cast("date")


@query("b1_rename", "SELECT l_orderkey AS order_id, l_partkey AS part_id, l_quantity AS quantity FROM lineitem")
def _(s, d):
    return R.rename(T(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), {"l_orderkey": "order_id", "l_partkey": "part_id", "l_quantity": "quantity"})


@query("b2_tag", "SELECT s_suppkey, 'supplier' AS kind FROM supplier")
def _(s, d):
    return R.tag(T(s, d, "supplier").select("s_suppkey"), "kind", "supplier")


@query("b3_filter_on_expr", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE round(l_extendedprice * (1 - l_discount), 6) >= 60000")
def _(s, d):
    return R.filter_on_expr(T(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), "net", F.round(c("l_extendedprice") * (1 - c("l_discount")), 6), 60000).select("l_orderkey", "net")


@query("b4_le_or_null", "SELECT event_id, value FROM events WHERE value IS NULL OR value <= 20")
def _(s, d):
    return T(s, d, "events").filter(R.le_or_null("value", 20)).select("event_id", "value")


@query("b5_in_list", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'click')")
def _(s, d):
    return T(s, d, "events").filter(R.in_list("event_type", ["purchase", "click"])).select("event_id", "event_type")


@query("b6_in_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AS closed FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def _(s, d):
    o = T(s, d, "orders").filter(R.in_range("o_orderdate", F.lit("1996-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp"), closed=False))
    return o.select("o_orderkey", day("o_orderdate").alias("day"), R.in_range("o_orderdate", F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")).alias("closed"))


@query("b7_starts_with", "SELECT n_nationkey, n_name FROM nation WHERE starts_with(lower(n_name), 'nation_1')")
def _(s, d):
    return T(s, d, "nation").filter(R.starts_with("n_name", "nation_1", ignore_case=True)).select("n_nationkey", "n_name")


@query("b8_having_match", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
def _(s, d):
    o = T(s, d, "orders").filter(F.year("o_orderdate") == 1995).select(c("o_custkey").alias("c_custkey"))
    return R.having_match(T(s, d, "customer").select("c_custkey"), o, "c_custkey")


@query("b9_without_match", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(s, d):
    o = T(s, d, "orders")
    a = o.filter(F.year("o_orderdate") == 1995).select(c("o_custkey").alias("c_custkey"))
    b = o.filter("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return R.without_match(T(s, d, "customer").select("c_custkey"), a, b, on="c_custkey")


@query("b10_in_subquery", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 3)")
def _(s, d):
    p = T(s, d, "part")
    top = R.head(p.groupBy("p_brand").count(), [F.desc("count"), F.asc("p_brand")], 3).select("p_brand")
    return R.in_subquery(p.select("p_partkey", "p_brand"), top, "p_brand")


@query("b12_with_scalar", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer")
def _(s, d):
    cu = T(s, d, "customer")
    return cu.crossJoin(F.broadcast(cu.agg(F.avg("c_acctbal").alias("m")))).select("c_custkey", F.round(c("c_acctbal") - c("m"), 4).alias("above"))


@query("b13_bucket", "SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    o = T(s, d, "orders").select(R.bucket([(c("o_totalprice") < 100000, "small"), (c("o_totalprice") < 300000, "medium")], "large").alias("size"))
    return o.groupBy("size").agg(F.count("*").alias("n"))


@query("b14_swap_pairs", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey - 1 WHEN n_nationkey = (SELECT max(n_nationkey) FROM nation) THEN n_nationkey ELSE n_nationkey + 1 END AS n_nationkey, n_name FROM nation")
def _(s, d):
    return R.swap_pairs(T(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("b15_build_filters", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3")
def _(s, d):
    return T(s, d, "customer").filter(R.build_filters(c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=3, c_name=None)).select("c_custkey")


@query("b16_drop_sentinel", "SELECT p_partkey, p_size FROM part WHERE p_size <> 1")
def _(s, d):
    return R.drop_sentinel(T(s, d, "part").select("p_partkey", "p_size"), "p_size", 1)


@query("b17_unique", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return R.unique(T(s, d, "events"), ["user_id", "event_type"])


@query("b18_agg_with_derived", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS largest, round(sum(o_totalprice) - max(o_totalprice), 2) AS rest FROM orders GROUP BY 1")
def _(s, d):
    g = A.summarise(T(s, d, "orders"), ["o_custkey"], {"t": F.sum("o_totalprice"), "m": F.max("o_totalprice")})
    return g.select("o_custkey", F.round("t", 2).alias("total"), F.round("m", 2).alias("largest"), F.round(c("t") - c("m"), 2).alias("rest"))


@query("b19_restrict_to_ids", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey BETWEEN 1 AND 100")
def _(s, d):
    return R.restrict_to_ids(T(s, d, "lineitem").select("l_orderkey", "l_partkey"), list(range(1, 101)), "l_partkey")


@query("b20_coerce_numeric", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS n FROM events WHERE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) IS NOT NULL")
def _(s, d):
    return R.coerce_numeric(T(s, d, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("n")), "n")


@query("b21_first_non_blank", "SELECT doc_id, coalesce(nullif(trim(source), ''), nullif(trim(lang), '')) AS name FROM documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", S.first_non_blank("source", "lang").alias("name"))


@query("b22_distinct_levels", "SELECT DISTINCT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    j = R.join_dims(T(s, d, "customer"), [(T(s, d, "nation"), c("c_nationkey") == c("n_nationkey")), (T(s, d, "region"), c("n_regionkey") == c("r_regionkey"))])
    return R.unique(j, ["r_name", "n_name", "c_mktsegment"])


@query("c1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    return R.inner(T(s, d, "orders"), T(s, d, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("c2_inner_keys", "SELECT a.l_partkey, a.l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') a JOIN lineitem b USING (l_partkey, l_suppkey) GROUP BY 1, 2")
def _(s, d):
    li = T(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return R.inner(R.unique(li.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]), li, ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("c3_left_with_zero", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
def _(s, d):
    o = T(s, d, "orders").filter("o_totalprice > 300000").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.left_with_zero(T(s, d, "customer").select("c_custkey"), o, "c_custkey", ["n", "total"])


@query("c4_left_filtered", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def _(s, d):
    o = T(s, d, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return R.left_filtered(T(s, d, "customer").select("c_custkey"), o, "c_custkey", c("o_orderstatus") == "P").select("c_custkey", "o_orderkey")


@query("c5_join_roles", "SELECT cn.n_name AS customer_n_name, sn.n_name AS supplier_n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def _(s, d):
    j = R.join_dims(T(s, d, "lineitem").select("l_orderkey", "l_suppkey"), [(T(s, d, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")), (T(s, d, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")), (T(s, d, "supplier").select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))])
    per = j.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    return R.join_roles(per, T(s, d, "nation"), "n_nationkey", {"customer": "c_nationkey", "supplier": "s_nationkey"}, ["n_name"]).select("customer_n_name", "supplier_n_name", "n")


@query("c6_min_children", "SELECT n_regionkey, count(*) AS children FROM nation GROUP BY 1 HAVING count(*) >= 5")
def _(s, d):
    return R.min_children(T(s, d, "nation"), "n_regionkey", 5)


@query("c7_retained", "WITH w AS (SELECT DISTINCT user_id, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(date_trunc('week', ts) AS DATE)) + 3) / 7) AS INTEGER) AS week FROM events) SELECT a.week, count(*) AS retained FROM w a JOIN w b ON a.user_id = b.user_id AND a.week = b.week + 1 GROUP BY 1")
def _(s, d):
    return R.retained(T(s, d, "events").select("user_id", S.week_index("ts").alias("week")), "user_id", "week")


@query("c8_active_on", "WITH r AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate), e AS (SELECT a AS day, 1 AS step FROM r UNION ALL SELECT b + 1, -1 FROM r), g AS (SELECT CAST(day AS DATE) AS day, sum(step) AS step FROM e GROUP BY 1) SELECT day, CAST(sum(step) OVER (ORDER BY day) AS BIGINT) AS open FROM g")
def _(s, d):
    j = T(s, d, "lineitem").select("l_orderkey", day("l_shipdate").alias("b")).join(T(s, d, "orders").select(c("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("a")), "l_orderkey")
    return R.active_on(j, "a", "b")


@query("c9_join_computed", "SELECT a.l_orderkey, a.l_linenumber, round(sum(b.l_quantity), 2) AS next_quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2")
def _(s, d):
    li = T(s, d, "lineitem")
    right = li.groupBy("l_orderkey", c("l_linenumber").alias("target")).agg(F.round(F.sum("l_quantity"), 2).alias("next_quantity"))
    return R.join_computed(R.unique(li, ["l_orderkey", "l_linenumber"]), right, ["l_orderkey"], "target", c("l_linenumber") + 1).drop("target")


@query("c10_using", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    return R.inner(T(s, d, "orders").select(c("o_orderkey").alias("k"), "o_orderstatus"), T(s, d, "lineitem").select(c("l_orderkey").alias("k")), "k").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("c11_join_dims", "SELECT r_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(s, d):
    j = R.join_dims(T(s, d, "orders").select("o_custkey"), [(T(s, d, "customer"), c("o_custkey") == c("c_custkey")), (T(s, d, "nation"), c("c_nationkey") == c("n_nationkey")), (T(s, d, "region"), c("n_regionkey") == c("r_regionkey"))])
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("c12_has_all", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def _(s, d):
    o = T(s, d, "orders")
    return R.has_all(o, "o_custkey", "o_orderstatus", o.select("o_orderstatus").distinct())


@query("c13_unpivot_keys", "SELECT role, key, count(*) AS n FROM (SELECT 'l_partkey' AS role, l_partkey AS key FROM lineitem UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem) GROUP BY 1, 2")
def _(s, d):
    return R.unpivot_keys(T(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_partkey", "l_suppkey"]).groupBy("role", "key").agg(F.count("*").alias("n"))


@query("c14_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def _(s, d):
    n = T(s, d, "nation").filter("n_nationkey < 20").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return R.lookup(T(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n, "n_name", "unknown").select("c_custkey", "n_name")


@query("c15_left_null_safe", "WITH a AS (SELECT p_partkey, nullif(p_size, 1) AS size FROM part), b AS (SELECT nullif(p_size, 1) AS size, count(*) AS n FROM part WHERE p_size < 20 GROUP BY 1) SELECT p_partkey, a.size, n FROM a LEFT JOIN b ON a.size IS NOT DISTINCT FROM b.size")
def _(s, d):
    p = T(s, d, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("size"), "p_size")
    return R.left_null_safe(p.drop("p_size"), p.filter("p_size < 20").groupBy("size").agg(F.count("*").alias("n")), ["size"])


@query("c16_latest_version", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(s, d):
    return R.latest_version(T(s, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query("c17_vs_group_mean_join", "SELECT l_suppkey, count(*) AS n FROM lineitem JOIN (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS e FROM lineitem GROUP BY 1) USING (l_suppkey) WHERE l_quantity > q AND l_discount > e + 0.0001 GROUP BY 1")
def _(s, d):
    j = R.vs_group_mean_join(T(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount"), "l_suppkey", ["l_quantity", "l_discount"])
    return j.filter(A.above("l_quantity", "avg_l_quantity") & A.above("l_discount", "avg_l_discount", "0.0001")).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("c18_keep_in_all", "SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND user_id IN (SELECT user_id FROM events WHERE value > 100)")
def _(s, d):
    e = T(s, d, "events")
    return R.keep_in_all(R.unique(e, ["user_id"]), [e.filter("event_type = 'purchase'").select("user_id"), e.filter("value > 100").select("user_id")], "user_id")


@query("f1_sort", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def _(s, d):
    return R.sort(T(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), [F.asc("c_nationkey"), F.desc("c_acctbal"), F.asc("c_custkey")])


@query("f2_head", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return R.head(T(s, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), [F.desc("total"), F.asc("o_custkey")], 10)


@query("f3_keep_top_groups", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
def _(s, d):
    return R.keep_top_groups(T(s, d, "part").select("p_partkey", "p_brand"), "p_brand", F.count("*"), 5)


@query("f4_order_by_list", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place FROM orders")
def _(s, d):
    return T(s, d, "orders").select("o_orderkey", R.order_by_list("o_orderstatus", ["P", "O"]).cast("int").alias("place"))


@query("f5_first_seen", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    return A.top_n(T(s, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 1).select("user_id", "event_id")


@query("f6_cap_per_key", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 2")
def _(s, d):
    return A.top_n(T(s, d, "documents").select("doc_id", "source"), ["source"], [F.asc("doc_id")], 2).select("doc_id", "source")


@query("f7_retain_snapshots", "WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events) SELECT event_id, day FROM e WHERE day IN (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 2)")
def _(s, d):
    return R.retain_snapshots(T(s, d, "events").select("event_id", day("ts").alias("day")), "day", 2).select("event_id", "day")


@query("g1_stack", "SELECT kind, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT 'price' AS kind, l_extendedprice AS amount FROM lineitem UNION ALL SELECT 'discount', -l_extendedprice * l_discount FROM lineitem) GROUP BY 1")
def _(s, d):
    li = T(s, d, "lineitem")
    both = R.stack(R.tag(li.select(c("l_extendedprice").alias("amount")), "kind", "price"), R.tag(li.select((-c("l_extendedprice") * c("l_discount")).alias("amount")), "kind", "discount"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("g2_union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def _(s, d):
    li = T(s, d, "lineitem")
    return R.union_distinct(li.select(c("l_partkey").alias("k")), li.select(c("l_suppkey")))


@query("g3_stack_loose", "SELECT o_orderkey AS k, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS quantity FROM orders UNION ALL SELECT l_orderkey, NULL, l_quantity FROM lineitem")
def _(s, d):
    return R.stack_loose(T(s, d, "orders").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("status")), T(s, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_quantity").alias("quantity")))


@query("g4_minus", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996")
def _(s, d):
    li = T(s, d, "lineitem").filter(F.year("l_shipdate") == 1996).select(c("l_partkey").alias("p_partkey"))
    return R.minus(T(s, d, "part"), li, ["p_partkey"])


@query("g5_common", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(s, d):
    return R.common(T(s, d, "customer").select(c("c_nationkey").alias("k")), T(s, d, "supplier").select("s_nationkey"))


@query("g6_any_of", "SELECT event_id FROM events WHERE value > 150 OR event_type = 'purchase' OR user_id < 5")
def _(s, d):
    return R.any_of(T(s, d, "events"), [c("value") > 150, c("event_type") == "purchase", c("user_id") < 5]).select("event_id")
