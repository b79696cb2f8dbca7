"""Aggregates and window functions on the given tables (inventory D, E)."""

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
r2 = lambda x: F.round(x, 2)


@query("d1_summarise", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def _(s, d):
    p = "o_totalprice"
    return A.summarise(T(s, d, "orders"), ["o_orderpriority"], {"n": F.count("*"), "total": r2(F.sum(p)), "mean": F.round(F.avg(p), 4), "least": F.min(p), "most": F.max(p)})


@query("d2_count_distinct_by", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(s, d):
    return A.summarise(T(s, d, "events"), ["event_type"], {"users": F.count_distinct("user_id")})


@query("d3_totals", "SELECT count(*) AS n, round(sum(o_totalprice), 1) AS total, CAST(max(o_orderdate) AS DATE) AS last FROM orders")
def _(s, d):
    return A.totals(T(s, d, "orders"), {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 1), "last": F.max("o_orderdate").cast("date")})


@query("d4_conditional_aggs", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(o_orderkey) FILTER (o_orderstatus = 'F') AS n_f, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n_o FROM orders GROUP BY 1")
def _(s, d):
    o = T(s, d, "orders").withColumn("period", F.date_trunc("month", "o_orderdate").cast("date"))
    return A.conditional_aggs(o, ["period"], {"n_f": (c("o_orderstatus") == "F", "count", "o_orderkey"), "n_o": (c("o_orderstatus") == "O", "count", "o_orderkey")})


@query("d5_points", "SELECT o_custkey, CAST(sum(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 1 ELSE 0 END) AS BIGINT) AS points FROM orders GROUP BY 1")
def _(s, d):
    return A.summarise(T(s, d, "orders"), ["o_custkey"], {"points": A.points("o_orderstatus", {"F": 3, "P": 1})})


@query("d6_ratio", "SELECT l_suppkey, round(CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / nullif(count(*) FILTER (l_returnflag = 'N'), 0), 6) AS ratio FROM lineitem GROUP BY 1")
def _(s, d):
    return A.summarise(T(s, d, "lineitem"), ["l_suppkey"], {"ratio": F.round(A.ratio(F.count_if(c("l_returnflag") == "R").cast("double"), F.count_if(c("l_returnflag") == "N")), 6)})


@query("d7_share_of", "WITH g AS (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT day, round(100 * a / nullif(a + b, 0), 2) AS pct_a, round(100 * b / nullif(a + b, 0), 2) AS pct_b FROM g")
def _(s, d):
    return A.share_of(T(s, d, "events").withColumn("day", c("ts").cast("date")), ["day"], "value", c("event_type") == "click", c("event_type") == "view")


@query("d8_rate", "SELECT round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM orders")
def _(s, d):
    return T(s, d, "orders").agg(F.round(A.rate(c("o_orderstatus") == "F"), 6).alias("rate"))


@query("d9_groups_at_least", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def _(s, d):
    return A.groups_at_least(T(s, d, "orders"), ["o_custkey"], 12)


@query("d10_by_period", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return A.summarise_by_period(T(s, d, "orders"), "o_orderdate", "month", {"n": F.count("*")})


@query("d11_concat_list", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1")
def _(s, d):
    return A.concat_list(T(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query("d13_duplicate_report", "SELECT text, count(*) AS n, min(doc_id) AS first_id, CAST(count(*) AS VARCHAR) || ' rows share this key, first ' || CAST(min(doc_id) AS VARCHAR) AS message FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return A.duplicate_report(T(s, d, "documents").select("text", "doc_id"), ["text"], "doc_id")


@query("d14_latest_vs_prior", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, round(max(value) FILTER (k = 1), 4) AS latest, round(coalesce(avg(value) FILTER (k > 1), max(value) FILTER (k = 1)), 9) AS prior FROM r GROUP BY 1")
def _(s, d):
    out = A.latest_vs_prior(T(s, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", F.round("latest", 4).alias("latest"), F.round("prior", 9).alias("prior"))


@query("d15_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 6) AS mean FROM lineitem GROUP BY 1")
def _(s, d):
    return A.summarise(T(s, d, "lineitem"), ["l_suppkey"], {"mean": F.round(A.weighted_mean(c("l_discount"), c("l_extendedprice")), 6)})


@query("d16_bag_overlap", "WITH l AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT lang, line, count(*) AS n FROM l WHERE source = 'src0' GROUP BY 1, 2), b AS (SELECT lang, line, count(*) AS m FROM l WHERE source = 'src1' GROUP BY 1, 2) SELECT lang, CAST(sum(least(n, m)) AS BIGINT) AS rows, CAST(sum(least(n, m) * length(line)) AS BIGINT) AS chars FROM a JOIN b USING (lang, line) GROUP BY 1")
def _(s, d):
    lines = T(s, d, "documents").filter("source IN ('src0', 'src1')").select("lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    return A.bag_overlap(lines.filter("source = 'src0'"), lines.filter("source = 'src1'"), ["lang"], "line")


@query("d17_set_equals", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2 AND count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('F', 'O')) = 2")
def _(s, d):
    return A.set_equals(T(s, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O"])


@query("d18_mean_of_totals", "SELECT round(avg(t), 2) AS mean_total FROM (SELECT c_nationkey, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)")
def _(s, d):
    j = T(s, d, "orders").join(T(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    return A.mean_of_totals(j, "c_nationkey", "o_totalprice").select(r2("mean_total").alias("mean_total"))


@query("d20_pivot_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS diff FROM orders GROUP BY 1")
def _(s, d):
    p = A.pivot_agg(T(s, d, "orders").withColumn("year", F.year("o_orderdate")), ["year"], "o_orderstatus", ["F", "O"], F.count("o_orderkey")).fillna(0)
    return p.select("year", c("F").alias("f"), c("O").alias("o"), (c("F") - c("O")).alias("diff"))


@query("d21_pivot_min", "SELECT p_brand, min(p_retailprice) FILTER (p_size = 1) AS s1, min(p_retailprice) FILTER (p_size = 2) AS s2 FROM part GROUP BY 1")
def _(s, d):
    return A.pivot_agg(T(s, d, "part"), ["p_brand"], "p_size", [1, 2], F.min("p_retailprice")).withColumnsRenamed({"1": "s1", "2": "s2"})


@query("d22_pivot_max", "SELECT o_custkey, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS f, max(o_orderpriority) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(s, d):
    return A.pivot_agg(T(s, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "P"], F.max("o_orderpriority")).select("o_custkey", c("F").alias("f"), c("P").alias("p"))


@query("d24_split_means", "SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS mean_r, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS mean_n FROM lineitem GROUP BY 1")
def _(s, d):
    out = A.split_means(T(s, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["R", "N"], "l_quantity")
    return out.select("l_suppkey", F.round("mean_R", 6).alias("mean_r"), F.round("mean_N", 6).alias("mean_n"))


@query("d25_period_metrics", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1 HAVING count(*) >= 150")
def _(s, d):
    return A.summarise_by_period(T(s, d, "orders"), "o_orderdate", "month", {"n": F.count("*"), "mean": r2(F.avg("o_totalprice"))}).filter("n >= 150")


@query("e1_best_part_per_month", "WITH g AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2) SELECT month, l_partkey, q FROM g QUALIFY row_number() OVER (PARTITION BY month ORDER BY q DESC, l_partkey) = 1")
def _(s, d):
    g = T(s, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month"), "l_partkey").agg(r2(F.sum("l_quantity")).alias("q"))
    return A.top_n(g, ["month"], [F.desc("q"), F.asc("l_partkey")], 1).drop("rank")


@query("e2_top3_price_per_brand", "SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS rank FROM part) WHERE rank <= 3")
def _(s, d):
    return A.top_n(T(s, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice")], 3, "dense")


@query("e2_top3_balance_per_nation", "SELECT n_name, c_custkey, c_acctbal, rank FROM (SELECT n_name, c_custkey, c_acctbal, CAST(dense_rank() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC) AS INTEGER) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 3")
def _(s, d):
    j = T(s, d, "customer").join(T(s, d, "nation"), c("c_nationkey") == c("n_nationkey")).select("n_name", "c_custkey", "c_acctbal")
    return A.top_n(j, ["n_name"], [F.desc("c_acctbal")], 3, "dense")


@query("e3_nth", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 3")
def _(s, d):
    return A.nth(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 3).drop("o_orderdate")


@query("e4_nth_distinct", "SELECT (SELECT DISTINCT p_retailprice FROM part ORDER BY 1 DESC LIMIT 1 OFFSET 1) AS p_retailprice")
def _(s, d):
    return A.nth_distinct(T(s, d, "part"), "p_retailprice", 2)


@query("e6_majority", "WITH g AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) = 1")
def _(s, d):
    j = T(s, d, "orders").join(T(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    return A.majority(j, ["c_mktsegment"], "o_orderstatus", R.order_by_list("o_orderstatus", ["P", "O"]))


@query("e7_pick_by_priority", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) = 1")
def _(s, d):
    return A.top_n(T(s, d, "orders"), ["o_custkey"], [R.order_by_list("o_orderstatus", ["P", "O"]).asc(), F.desc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("e8_growth", "WITH g AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2) SELECT *, lag(n) OVER w AS previous, round(100.0 * (n - lag(n) OVER w) / lag(n) OVER w, 2) AS growth_pct FROM g WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)")
def _(s, d):
    g = T(s, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return A.growth(g, ["o_orderpriority"], "year", "n")


@query("e9_rolling", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS rolling FROM events")
def _(s, d):
    return A.rolling(T(s, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", F.round("rolling", 6).alias("rolling"))


@query("e10_above_own_average", "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, l_quantity, l_tax, avg(l_quantity) OVER w AS q, avg(l_tax) OVER w AS t FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) WHERE l_quantity > q AND l_tax > t + 0.0001 GROUP BY 1")
def _(s, d):
    x = A.above_own_average(T(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_tax"), "l_suppkey", ["l_quantity", "l_tax"], {"l_tax": "0.0001"})
    return x.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("e11_with_group_stats", "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS n, min(p_partkey) OVER (PARTITION BY p_name) AS least FROM part")
def _(s, d):
    return A.with_group_stats(T(s, d, "part").select("p_partkey", "p_name"), ["p_name"], {"n": F.count("*"), "least": F.min("p_partkey")}).drop("p_name")


@query("e12_forward_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 2) AS forward FROM orders")
def _(s, d):
    return A.forward_sum(T(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 3).select("o_orderkey", r2("forward").alias("forward"))


@query("e13_runs_over", "WITH g AS (SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS i, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT *, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS k FROM g WHERE n >= 60), h AS (SELECT event_type, i, n, count(*) OVER (PARTITION BY event_type, k) AS length FROM f) SELECT * FROM h WHERE length >= 3")
def _(s, d):
    g = T(s, d, "events").groupBy("event_type", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("i")).agg(F.count("*").alias("n"))
    return A.runs_over(g, ["event_type"], "i", c("n") >= 60, 3)


@query("e14_streaks", "WITH g AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS i FROM events), f AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM g) SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM f GROUP BY user_id, k HAVING count(*) >= 10")
def _(s, d):
    return A.streaks(T(s, d, "events").select("user_id", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("i")), ["user_id"], "i", 10)


@query("e15_next_delta", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE)) AS INTEGER) AS next_delta FROM orders")
def _(s, d):
    o = T(s, d, "orders").withColumn("i", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")))
    return A.next_delta(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], c("i")).select("o_orderkey", "next_delta")


@query("e16_canonical_label", "SELECT c_custkey, first_value(c_name) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS canonical FROM customer")
def _(s, d):
    return A.canonical_label(T(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), "c_mktsegment", ["c_custkey"], "c_name").select("c_custkey", "canonical")


@query("e17_median", "SELECT p_brand, round(median(p_retailprice), 4) AS median FROM part GROUP BY 1")
def _(s, d):
    return A.summarise(T(s, d, "part"), ["p_brand"], {"median": F.round(F.median("p_retailprice"), 4)})


@query("e18_last_two_changed", "WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), x AS (SELECT user_id, any_value(event_type) FILTER (k = 1) IS DISTINCT FROM any_value(event_type) FILTER (k = 2) AS changed_event_type, any_value(value) FILTER (k = 1) IS DISTINCT FROM any_value(value) FILTER (k = 2) AS changed_value FROM r WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2) SELECT * FROM x WHERE changed_event_type OR changed_value")
def _(s, d):
    return A.last_two_changed(T(s, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("e19_share_of_group", "WITH g AS (SELECT p_brand, p_size, sum(p_retailprice) AS t FROM part GROUP BY 1, 2) SELECT p_brand, p_size, round(t, 2) AS total, round(t / sum(t) OVER (PARTITION BY p_brand), 6) AS share FROM g")
def _(s, d):
    x = A.share_of_group(T(s, d, "part"), ["p_brand", "p_size"], ["p_brand"], "p_retailprice")
    return x.select("p_brand", "p_size", r2("total").alias("total"), F.round("share", 6).alias("share"))


@query("e22_rank_shift", "WITH g AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2), r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY y ORDER BY n DESC) AS INTEGER) AS k FROM g) SELECT n_name, min(k) FILTER (y = 1996) AS r1996, min(k) FILTER (y = 1997) AS r1997, min(k) FILTER (y = 1996) - min(k) FILTER (y = 1997) AS shift FROM r GROUP BY 1")
def _(s, d):
    j = T(s, d, "orders").filter(F.year("o_orderdate").isin(1996, 1997)).join(T(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(T(s, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    r = A.top_n(j.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")), ["y"], [F.desc("n")], 1000, "dense")
    p = A.pivot_agg(r, ["n_name"], "y", [1996, 1997], F.min("rank"))
    return p.select("n_name", c("1996").alias("r1996"), c("1997").alias("r1997"), (c("1996") - c("1997")).alias("shift"))


@query("e23_newest", "SELECT day, CAST(row_number() OVER (ORDER BY day DESC) AS INTEGER) AS rank FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) QUALIFY rank <= 3")
def _(s, d):
    return A.newest(T(s, d, "events").select(c("ts").cast("date").alias("day")), "day", 3)


@query("i39_nearest_marker", "WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), m AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS b, min(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM n) SELECT event_id, CAST(least(k - b, f - k) AS INTEGER) AS distance FROM m")
def _(s, d):
    return A.nearest_marker(T(s, d, "events"), ["user_id"], ["ts", "event_id"], c("event_type") == "purchase").select("event_id", "distance")


@query("h1_scalars", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(dayofweek(ts) AS INTEGER) AS day_of_week, CAST(date_trunc('week', ts) AS DATE) AS week_start, strftime(ts, '%Y-%m') AS month, round(value, 1) AS rounded, CAST(value AS DECIMAL(10,2)) AS exact, length(rtrim(event_type)) AS n FROM events")
def _(s, d):
    p = S.date_parts("ts")
    return T(s, d, "events").select("event_id", p["year"].alias("year"), p["day_of_year"].alias("day_of_year"), p["day_of_week"].alias("day_of_week"), S.week_start("ts").alias("week_start"), S.fmt_date("ts", "yyyy-MM").alias("month"), S.round_to("value", 1).alias("rounded"), S.to_decimal("value", 10, 2).alias("exact"), S.text_len("event_type").cast("long").alias("n"))


@query("h8_text", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, split_part(url, '://', 1) AS scheme, regexp_replace(list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1), '\\.[^.]*$', '') AS stem, contains(lower(html), 'anin') AS has, CASE WHEN length(url) > 20 THEN substr(url, 1, 19) || '…' ELSE url END AS short FROM pages")
def _(s, d):
    u = c("url")
    bare = F.regexp_replace(u, r"[?#].*$", "")
    return T(s, d, "pages").select("page_id", bare.alias("bare"), S.before("url", "://").alias("scheme"), S.file_stem(bare).alias("stem"), S.has_keyword("html", ["anin"]).alias("has"), S.ellipsis("url", 20).alias("short"))


@query("h22_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", S.parse_json("props", "k int")["k"].alias("k"))


@query("h26_calendar", "SELECT CAST(day AS DATE) AS day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, year(day) IN (1996, 2000) AS is_leap_year, count(o_orderkey) AS n FROM range(TIMESTAMP '1996-01-01', TIMESTAMP '2001-01-01', INTERVAL 1 DAY) t(day) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(day AS DATE) GROUP BY 1, 2, 3, 4")
def _(s, d):
    per = T(s, d, "orders").groupBy(c("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return S.calendar(s, "1996-01-01", "2000-12-31").join(per, "day", "left").fillna(0, ["n"])


# positions, windows over windows, named windows
@query("b11_rows_at_positions", "WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_totalprice, position FROM o WHERE position IN (1, 100, 5000, n)")
def _(s, d):
    return R.rows_at_positions(T(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [1, 100, 5000, -1])


@query("d23_latest_pair", "WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rank FROM g) SELECT user_id, CAST(coalesce(sum(n) FILTER (rank = 1), 0) AS BIGINT) AS newest, CAST(coalesce(sum(n) FILTER (rank = 2), 0) AS BIGINT) AS previous, newest - previous AS change FROM r WHERE rank <= 2 GROUP BY 1")
def _(s, d):
    g = T(s, d, "events").groupBy("user_id", c("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return A.latest_pair(A.top_n(g, ["user_id"], [F.desc("day")], 2), ["user_id"], "rank", "n")


@query("e5_best_months", "WITH g AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, total DESC, month) AS INTEGER) AS rank FROM g QUALIFY rank <= 3")
def _(s, d):
    g = T(s, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return A.top_n(g, ["year"], [F.desc("n"), F.desc("total"), F.asc("month")], 3)


@query("e20_run_member", "WITH a AS (SELECT event_id, user_id, ts, value > 50 AS hit, CASE WHEN (value > 50) IS NOT DISTINCT FROM lag(value > 50) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, coalesce(hit, false) AND count(*) OVER (PARTITION BY user_id, run) >= 3 AS member FROM b")
def _(s, d):
    return A.run_member(T(s, d, "events"), ["user_id"], ["ts", "event_id"], c("value") > 50, 3).select("event_id", "member")


@query("e21_with_windows", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)")
def _(s, d):
    x = A.with_windows(T(s, d, "events"), ["user_id"], ["ts", "event_id"], {"mean": F.avg("value"), "most": F.max("value"), "n": F.count("*")}, (-2, 0))
    return x.select("event_id", F.round("mean", 6).alias("mean"), "most", "n")


@query("j6_yoy", "WITH g AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n, lag(n) OVER (ORDER BY year) AS previous, round(100.0 * (n - lag(n) OVER (ORDER BY year)) / lag(n) OVER (ORDER BY year), 2) AS growth_pct FROM g")
def _(s, d):
    g = T(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return A.growth(g, [], "year", "n")  # a row for each year
