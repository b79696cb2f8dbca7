"""Conversations as JSON texts, some of them broken or with branches of another type (inventory I13, I14, I16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators.segments import numbered, segmented
from ..sources.io import read_table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col
SECTION = 1000


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def placed(s, d):
    """Conversations with `place`, a row's place in its conversation by turn (rows of one turn by role and text), and `section`:
    a document holds SECTION rows at most, so a conversation of any length is as many documents as it needs."""
    t = T(s, d, "conversations").select("conv_id", "turn", "role", "text")
    rows = numbered(segmented(t, ["conv_id"], ["turn", "role", "text"])).withColumn("place", c("n_").cast("long") - 1)
    return rows.withColumn("section", F.floor(c("place") / SECTION)).select("conv_id", "section", "place", "role", "text")


PLACED = f"""p AS (SELECT conv_id, role, text, place, place // {SECTION} AS section FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations))"""


def ordered(test, value):
    """The values of the rows that meet a test, in the order of the rows."""
    return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", value.alias("v"))))), lambda x: x["v"])


def texts(s, d):
    """(conv_id, section, json). By the last digit of conv_id: 0 broken, 1 a text where an object should be, 2 bad line numbers,
    3 an element that is no object and blocks without a kind, 4 nulls and numbers for texts, 5 no goals."""
    t = placed(s, d).withColumn("d", c("conv_id") % 10)
    at, role = c("place").cast("string"), F.coalesce("role", F.lit(""))
    number = F.concat(F.when(c("d") == 2, "n").otherwise(""), at)
    quoted = F.expr("coalesce(substring(to_json(array(text)), 2, length(to_json(array(text))) - 2), 'null')")
    value = F.when(c("d") != 4, quoted).when(c("place") % 2 == 0, "null").otherwise(F.concat(at, F.lit(".50")))
    entry = F.concat(F.lit('"'), number, F.lit('":'), value)
    entries = lambda test: F.concat(F.lit("{"), F.array_join(ordered(test, entry), ","), F.lit("}"))
    block = F.concat(F.lit('{"id":'), at, F.when(c("d") == 3, "").otherwise(F.concat(F.lit(',"kind":"'), role, F.lit('"'))), F.lit(',"speaker":"'), role, F.lit('","lines":{'), entry, F.lit("}}"))
    g = t.groupBy("conv_id", "section", "d").agg(entries(c("role") == "user").alias("user"), entries(c("role") == "assistant").alias("assistant"), entries(c("place") == 0).alias("first"), F.array_join(ordered(F.lit(True), block), ",").alias("blocks"))
    user = F.when(c("d") == 1, '"none"').otherwise(c("user"))
    goals = F.when(c("d") == 5, "").otherwise(F.concat(F.lit('"goals":{"Main":'), "first", F.lit(',"Side":[1],"Other":'), "first", F.lit("},")))
    whole = F.concat(F.lit('{"source":{"url":"u"},"parts":{"user":'), user, F.lit(',"assistant":'), "assistant", F.lit("},"), goals, F.lit('"blocks":['), "blocks", F.when(c("d") == 3, ",5").otherwise(""), F.lit("]}"))
    return g.select("conv_id", "section", "d", whole.alias("json")).select("conv_id", "section", F.when(c("d") == 0, F.expr("substring(json, 1, length(json) - 1)")).otherwise(c("json")).alias("json"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ROWS = f"""{PLACED}, r AS (SELECT conv_id, place, role, conv_id % 10 AS d, CASE WHEN conv_id % 10 = 2 THEN 1 ELSE CAST(place AS INTEGER) END AS line,
  CASE WHEN conv_id % 10 <> 4 THEN trim(text, {_BLANK}) WHEN place % 2 = 1 THEN CAST(place AS VARCHAR) || '.5' END AS text FROM p WHERE conv_id % 10 <> 0)"""


@query("i13_flatten_json", f"""WITH {_ROWS} SELECT conv_id, role AS part, NULL AS sub, line, text FROM r WHERE text <> '' AND (role = 'assistant' OR role = 'user' AND d <> 1)
UNION ALL SELECT conv_id, 'goals', 'MAIN', line, text FROM r WHERE place = 0 AND d <> 5 AND text <> ''""")
def _(s, d):
    return D.flatten(D.parse(texts(s, d), "json"), "conv_id", "doc", {p: ["parts", p] for p in ("user", "assistant")}, {"goals": (["goals"], {"Main": "MAIN", "Side": "SIDE", "Missing": "NONE"})})


@query("i14_flatten_json_blocks", f"""WITH {_ROWS} SELECT conv_id, CAST(place AS INTEGER) AS block, CASE WHEN d <> 3 THEN role END AS kind, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS speaker_id, line, text FROM r WHERE text <> ''""")
def _(s, d):
    names = s.createDataFrame([("user", 1), ("assistant", 2), ("other", 0)], "name string, speaker_id int")
    return D.flatten_blocks(D.parse(texts(s, d), "json"), "conv_id", "doc", ["blocks"], names, "speaker_id", "other")


@query("i16_validate_json", f"""WITH {PLACED}, g AS (SELECT conv_id, section, conv_id % 10 AS d, count(*) AS n, string_agg('root.blocks[' || (place % {SECTION}) || '].' || CASE WHEN conv_id % 10 = 3 THEN 'kind' ELSE 'kind (not in the list)' END, ';' ORDER BY place) FILTER (conv_id % 10 = 3 OR coalesce(role, '') NOT IN ('user', 'assistant')) AS blocks
  FROM p GROUP BY 1, 2)
SELECT conv_id, section, CASE WHEN d = 0 THEN 'root (object expected);root.parts (object expected);root.parts.user (object expected);root.goals (object expected);root.blocks (list expected)' ELSE
  concat_ws(';', CASE WHEN d = 5 THEN 'root.goals' END, CASE WHEN d = 1 THEN 'root.parts.user (object expected)' END, CASE WHEN d = 5 THEN 'root.goals (object expected)' ELSE 'root.goals.Sub' END, blocks, CASE WHEN d = 3 THEN 'root.blocks[' || n || '] (object expected)' END) END AS problems FROM g""")
def _(s, d):
    checked = D.validate(D.parse(texts(s, d), "json"), D.need_object(keys=["parts", "goals", "blocks"]), D.need_object("parts", keys=["user", "assistant"]), D.need_object("parts", "user"), D.need_object("goals", keys=["Main", "Sub"]), D.need_array("blocks", keys=["id", "kind", "lines"], closed={"kind": ["user", "assistant"]}))
    return checked.select("conv_id", "section", F.array_join("problems", ";").alias("problems"))
