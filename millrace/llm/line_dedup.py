"""Operator 7: removal of boilerplate lines by their spread over sites.

A line's spread is the number of distinct sites (column `source`) that have it. HyperLogLog sketches of the sites are
built for each line hash and merged by aggregation, so a line that a third of all documents hold costs one small sketch
for each task. Lines whose estimate is within `margin` of `min_sites` are near the threshold and get exact distinct
counts; lines further away are decided by the sketch (2^lg_k registers, 1.6 % error at 12, and exact for a few dozen
sites). A line on at least `min_sites` sites is boilerplate: every occurrence but the first one (smallest doc_id, then
place) is removed, so that its content stays once.

Lines are parts between line ends, compared without blanks around them by 96 bits of hashes; blank lines are never
boilerplate. The lines found go to the tasks when they are at most `broadcast_lines`; else they are joined by shuffling,
where adaptive execution splits hot lines.

Defined results: null and empty texts have one empty line and lose nothing. A null source is one site of its own. A null
doc_id counts as the largest. Repeated rows keep and lose the same lines. Other columns are kept, but
those named n_lines, n_removed or kept are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

LAST = (1 << 63) - 1


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, margin: float = 0.3, lg_k: int = 12, broadcast_lines: int = 500_000) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same columns with n_lines, n_removed and kept (the text that is left)."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    id_, text, h, site, gone, parts = (fresh(n, keep) for n in ("id_", "text_", "h_", "site_", "gone_", "parts_"))
    base = docs.select(*keep).withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), text: F.coalesce("text", F.lit(""))})
    base = base.withColumns({h: F.xxhash64(text), site: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    exploded = base.select(F.col(id_).alias("id"), F.col(h).alias("h"), F.col(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    lines = exploded.select("id", "h", "site", "at", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"))
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n"))
    spread = spread.filter(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").filter(F.col("sites") >= min_sites * (1 - margin))
    near = spread.filter(F.col("sites") <= min_sites * (1 + margin))
    exact = lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.countDistinct("site").alias("exact")).filter(F.col("exact") >= min_sites)
    found = spread.filter(F.col("sites") > min_sites * (1 + margin)).select("k1", "k2", "first").union(near.join(exact, ["k1", "k2"]).select("k1", "k2", "first"))
    found = cut(found)
    if found.count() <= broadcast_lines:
        found = F.broadcast(found)
    removed = lines.join(found, ["k1", "k2"]).filter(F.struct("id", "at") > F.col("first")).groupBy(F.col("id").alias(id_), F.col("h").alias(h)).agg(F.collect_set("at").alias(gone))
    out = base.join(removed, [id_, h], "left").withColumn(parts, F.split(text, "\n"))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    return out.select(*keep, F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def op7_line_spread(spark, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_line_spread": op7_line_spread}
SQL = {
    "op7_line_spread": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, site, pos, parts[pos] AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM d)),
b AS (SELECT trim(line) AS line, min({'i': coalesce(doc_id, 9223372036854775807), 'p': pos}) AS first FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.*, b.line IS NOT NULL AND {'i': coalesce(doc_id, 9223372036854775807), 'p': pos} > b.first AS gone FROM l LEFT JOIN b ON trim(l.line) = b.line)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
}
