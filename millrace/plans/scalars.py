"""Scalar functions on the given tables (inventory H, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.io import read_table as T

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


@query("h3_seconds", "SELECT event_id, date_trunc('second', ts) AS second, to_timestamp(0)::TIMESTAMP + to_seconds(CAST(floor(epoch(ts)) AS BIGINT)) + INTERVAL 9 HOUR AS zoned, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS month_index FROM events")
def _(s, d):
    e = T(s, d, "events").withColumn("t", c("ts").cast("timestamp"))
    return e.select("event_id", S.to_second("t").alias("second"), S.from_epoch(F.unix_timestamp("t"), "Asia/Tokyo").alias("zoned"), S.month_index("t").alias("month_index"))


@query("h5_numbers", "SELECT c_custkey, c_custkey % 7 AS left_over, abs(c_acctbal) AS size FROM customer")
def _(s, d):
    return T(s, d, "customer").select("c_custkey", S.modulo("c_custkey", 7).alias("left_over"), S.absolute("c_acctbal").alias("size"))


@query("h6_nulls", "SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS tax, coalesce(nullif(l_discount, 0), l_tax) AS rate, CASE WHEN nullif(trim(CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END), '') IS NULL THEN l_linestatus ELSE l_returnflag END AS flag FROM lineitem")
def _(s, d):
    li = T(s, d, "lineitem")
    flag = F.when(c("l_returnflag") == "N", " ").otherwise(c("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.coalesce(F.nullif("l_discount", F.lit(0.0)), "l_tax").alias("rate"), S.first_non_blank(flag, "l_linestatus").alias("flag"))


@query("h7_label", "SELECT o_orderkey, o_orderpriority || ' #' || o_orderkey AS label FROM orders")
def _(s, d):
    return T(s, d, "orders").select("o_orderkey", S.label("%s #%d", "o_orderpriority", "o_orderkey").alias("label"))


@query("h10_clean_name", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')  [' || p_size || ']x  y', '\[.*?\]|\(.*?\)', '', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def _(s, d):
    return T(s, d, "part").select("p_partkey", S.clean_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")  ["), c("p_size").cast("string"), F.lit("]x  y"))).alias("name"))


@query("h11_min_level", "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '-' || (p_size + 5) WHEN 1 THEN 'level ' || (p_size + 100) WHEN 2 THEN '' END AS x FROM part) SELECT p_partkey, coalesce(TRY_CAST(substr(regexp_replace(split_part(x, '-', 1), '[^0-9]', '', 'g'), 1, 2) AS INTEGER), 0) AS level FROM t")
def _(s, d):
    p = T(s, d, "part").select("p_partkey", "p_size")
    x = F.when(c("p_partkey") % 4 == 0, F.concat(c("p_size").cast("string"), F.lit("-"), (c("p_size") + 5).cast("string"))).when(c("p_partkey") % 4 == 1, F.concat(F.lit("level "), (c("p_size") + 100).cast("string"))).when(c("p_partkey") % 4 == 2, "")
    return p.select("p_partkey", S.min_level(x).alias("level"))


@query("h12_money", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS price FROM orders")
def _(s, d):
    x = c("o_totalprice").cast("decimal(12,2)").cast("string")
    text = F.when(c("o_orderkey") % 2 == 0, F.concat(F.replace(x, F.lit("."), F.lit(",")), F.lit(" PLN"))).otherwise(F.concat(F.lit("$ "), x))
    return T(s, d, "orders").select("o_orderkey", S.parse_money(text).alias("price"))


@query("h13_squash", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{A0}\x0B]+', ' ', 'g'))) AS digest FROM documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", F.md5(S.squash("text")).alias("digest"))


@query("h14_canonical_url", r"WITH b AS (SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS x FROM pages) SELECT page_id, CASE WHEN regexp_matches(x, '/$|/[^/]*\.[^/.]*$') AND NOT regexp_matches(x, '^[a-z]+://[^/]*$') THEN x ELSE x || '/' END AS url FROM b")
def _(s, d):
    return T(s, d, "pages").select("page_id", S.canonical_url("url").alias("url"))


@query("h15_replace_all", "SELECT doc_id, md5(replace(replace(text, 'the', '{a}'), 'de', '{b}')) AS digest FROM documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", F.md5(S.replace_all("text", {"the": "{a}", "de": "{b}"})).alias("digest"))


@query("h16_paragraphs", r"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, md5(array_to_string(parts, chr(10) || chr(10))) AS digest FROM p WHERE parts IS NOT NULL")
def _(s, d):
    p = T(s, d, "documents").filter("text IS NOT NULL").select("doc_id", S.paragraphs(F.replace("text", F.lit(". "), F.lit(".\n \n"))).alias("parts"))
    return p.select("doc_id", F.size("parts").alias("n"), F.md5(S.rejoin("parts")).alias("digest"))


@query("h17_split_counter", "SELECT o_orderkey, o_orderpriority AS text, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS done, CASE WHEN o_orderkey % 2 = 0 THEN 5 END AS total FROM orders")
def _(s, d):
    x = F.when(c("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit(" "), (c("o_orderkey") % 5).cast("string"), F.lit("/5"))).otherwise(c("o_orderpriority"))
    return T(s, d, "orders").select("o_orderkey", S.split_counter(x).alias("x")).select("o_orderkey", "x.*")


@query("h18_text_tests", "SELECT doc_id, contains(lower(text), ' the ') OR contains(lower(text), ' und ') AS has, text IS NOT NULL AND trim(text) NOT IN ('', '-') AS sensible FROM documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", S.has_keyword("text", [" The ", " und "]).alias("has"), S.is_text("text").alias("sensible"))


@query("h19_rolling_key", "WITH t AS (SELECT c_custkey, list_transform(string_split(lower(c_name), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS u FROM customer) SELECT c_custkey, printf('%08x', list_reduce(list_prepend(CAST(5381 AS BIGINT), u), lambda h, x: (h * 33 + x) & 4294967295)) || printf('%08x', list_reduce(list_prepend(CAST(0 AS BIGINT), u), lambda h, x: (h * 65599 + x) & 4294967295)) AS key, 16 AS n FROM t")
def _(s, d):
    return T(s, d, "customer").select("c_custkey", S.rolling_key("c_name").alias("key"), F.length(S.text_key("c_name")).alias("n"))


@query("h20_lists", "SELECT p_partkey, p_brand AS brand, p_type AS type, unnest(list_filter(list_transform(string_split(p_name || ', ' || p_brand || ',,', ','), lambda x: trim(x)), lambda x: x <> '')) AS item FROM part")
def _(s, d):
    p = T(s, d, "part").select("p_partkey", F.struct(c("p_brand").alias("brand"), c("p_type").alias("type")).alias("x"), F.explode(S.split_list(F.concat("p_name", F.lit(", "), "p_brand", F.lit(",,")))).alias("item"))
    return S.explode_struct(p, "x")


@query("h21_maps", "WITH g AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, role AS key, n AS value, coalesce((SELECT n FROM g x WHERE x.conv_id = g.conv_id AND x.role = 'system'), 0) AS systems FROM g")
def _(s, d):
    g = T(s, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    m = g.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m")).withColumn("systems", S.map_get("m", "system", 0))
    return S.map_rows(m, "m").select("conv_id", "key", "value", "systems")


@query("h22_make_json", "SELECT event_id, CAST(to_json({'user_id': user_id, 'event_type': event_type}) AS VARCHAR) AS json FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", S.make_json("user_id", "event_type").alias("json"))


@query("h24_fold", "SELECT lower(trim(c_mktsegment)) AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(s, d):
    mixed = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(c("c_mktsegment"))
    return T(s, d, "customer").groupBy(S.fold(mixed).alias("segment")).agg(F.count("*").alias("n"))


@query("h25_any_char", "SELECT lang, count(*) FILTER (regexp_matches(text, '[\u00e9\u00e0\u00fc\u00f1]')) AS n FROM documents GROUP BY 1")
def _(s, d):
    return T(s, d, "documents").groupBy("lang").agg(F.count_if(S.has_any_char("text", "\u00e9\u00e0\u00fc\u00f1")).alias("n"))
