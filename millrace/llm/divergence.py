"""Operator 12: how far sources of a language differ in their words.

Terms are the runs `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of a text (ASCII letters and everything from U+0080 on) with A to
Z lower-cased. Inside `mapInArrow` Arrow kernels do it: `ascii_lower`, `split_pattern_regex`, `dictionary_encode`, and
hash `group_by`, first by document and term, so that each document counts once for a term, then by language, source and
term. A task merges its partial counts and sends them on when they exceed a fixed number of rows, so Spark shuffles counts
and no words. A language keeps the terms that at least `min_docs` of its documents have.

With V kept terms and N their occurrences in a group, a term that occurs c times has p = 1 + floor(10^9 (c + 2) / (N + 2V)),
and two groups differ by floor((p - q)^2 / (p + q)) in a term. Two reports:

- term: for each source the `top` terms it has more of than its language, a window of which every task keeps its own
  first `top` rows before anything is shuffled;
- pair: for each two sources of a language the sum over all kept terms. Counts are laid out in columnar shards: a hash of
  the term says which shard of its language, and sources are numbered and tiled by `tile`, so a shard holds at most about
  `shard_rows` counts of at most two tiles of sources whatever the number of terms and sources is. Terms that neither
  source has add one value, known beforehand; terms that one has are grouped by their count; only terms that both have are
  compared one by one. Shards give sums for each two sources, which Spark adds up: the result itself has a row for each.

Arithmetic is on integers throughout (decimals where a product could exceed a long).

Defined results. Null text, lang and source are ''. Each row is a document, whatever its id; repeated rows count each. A
text without terms counts for its group's existence only. Sources without a kept term have c = 0 everywhere; a language without
kept terms gives pairs of value 0 and no terms. Equal values are ranked by the item's UTF-8 bytes. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ragged, slices, table

SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once, and partial counts that a task holds before it sends them.
BYTES, HELD = 8 << 20, 400_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(texts: pa.Array) -> pa.Table:
    """d (place of the text), t (term), n."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    term, doc = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(term, "")
    coded = term.filter(some).dictionary_encode()
    counted = pa.table({"d": doc.filter(some), "t": coded.indices}).group_by(["d", "t"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"d": counted["d"], "t": coded.dictionary.take(counted["t"].combine_chunks()), "n": counted["count_all"]})


def _long(text: str) -> pa.Table:
    """The same for one long text, a piece between separators at a time."""
    found, at = [], 0
    between = re.compile(SEPARATOR)
    while at < len(text):
        m = between.search(text, at + BYTES // 4)
        end = m.end() if m else len(text)
        found.append(_terms(pa.array([text[at:end]], pa.large_string()).cast(pa.large_string())).cast(pa.schema([("d", pa.int64()), ("t", pa.large_string()), ("n", pa.int64())])))
        at = end
    total = pa.concat_tables(found).group_by("t", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"d": np.zeros(len(total), np.int64), "t": total["t"].cast(pa.string()), "n": total["n_sum"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTS.names).cast(COUNTS)


def _partial(batches):
    held, size = [], 0
    for batch in batches:
        text, lang, source = (pc.fill_null(batch.column(i).cast(pa.string()), "") for i in range(3))
        begin = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))])
        for i, j in slices(begin, BYTES):
            who = [c.slice(i, j - i).dictionary_encode() for c in (lang, source)]
            found = _terms(text.slice(i, j - i)) if begin[j] - begin[i] <= 4 * BYTES else _long(text[i].as_py())
            d, term = found["d"].combine_chunks(), found["t"].combine_chunks().dictionary_encode()
            counted = pa.table({"l": who[0].indices.take(d), "s": who[1].indices.take(d), "t": term.indices, "n": found["n"]}).group_by(["l", "s", "t"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            every = pa.table({"l": who[0].indices, "s": who[1].indices}).group_by(["l", "s"], use_threads=False).aggregate([([], "count_all")])
            name = lambda t: [w.dictionary.take(t[k].combine_chunks()) for w, k in zip(who, "ls", strict=True)]
            held.append(pa.table([*name(counted), term.dictionary.take(counted["t"].combine_chunks()), counted["n_sum"], counted["n_count"]], schema=COUNTS))
            held.append(pa.table([*name(every), pa.nulls(len(every), pa.string()), pa.array(np.zeros(len(every), np.int64)), every["count_all"]], schema=COUNTS))
            size += len(counted) + len(every)
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0])
                if size > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, size = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); term null: the group's documents."""
    rows = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    partial = rows.mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    d = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * d(count + 2), d(total + 2 * terms))
    return 1 + F.when(terms > 0, whole).otherwise(0)


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _shard(wide: int):
    """Sums of one shard for each two sources of its tiles."""

    def run(shard: pa.Table) -> pa.Table:
        own = shard.filter(pc.is_null(shard["term"])).sort_by("number")
        rows = shard.filter(pc.is_valid(shard["term"]))
        number, p0 = own["number"].to_numpy(), own["p"].to_numpy()
        first, last = shard["a"][0].as_py(), shard["b"][0].as_py()
        count, apart = len(number), first != last
        nought = _apart(p0[:, None], p0[None, :])
        at, p = np.searchsorted(number, rows["number"].to_numpy()), rows["p"].to_numpy()
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((at, term))
        term, at, p = term[order], at[order], p[order]
        # terms that one source has, as if the other one had none of them
        one = np.zeros((count, count), np.int64)
        each, times = np.unique(np.stack([at, p]), axis=1, return_counts=True)
        for k in range(0, len(times), most := max(1, 2_000_000 // max(1, count))):
            who, some, n = each[0, k : k + most], each[1, k : k + most], times[k : k + most]
            np.add.at(one, who, (_apart(some[:, None], p0[None, :]) - nought[who]) * n[:, None])
        total = one + one.T
        # what that is wrong by for terms that both have
        ends = np.searchsorted(term, term, side="right")
        partners = ends - np.arange(len(term)) - 1
        for i, j in slices(np.concatenate([[0], np.cumsum(partners)]), 1_000_000):
            left, right = np.repeat(np.arange(i, j), partners[i:j]), ragged(np.arange(i, j) + 1, partners[i:j])
            if apart:
                across = (number[at[left]] // wide) != (number[at[right]] // wide)
                left, right = left[across], right[across]
            a, b, x, y = at[left], at[right], p[left], p[right]
            np.add.at(total, (a, b), _apart(x, y) - _apart(x, p0[b]) - _apart(p0[a], y) + nought[a, b])
        if shard["shard"][0].as_py() == 0:
            total += nought * (own["terms"][0].as_py() if count else 0)
        a, b = np.triu_indices(count, 1)
        if apart:
            across = (number[a] // wide) != (number[b] // wide)
            a, b = a[across], b[across]
        name = own["source"].combine_chunks()
        return pa.table({"lang": shard["lang"].combine_chunks().take(pa.array(np.zeros(len(a), np.int64))), "one": name.take(pa.array(a)), "other": name.take(pa.array(b)), "value": pa.array(total[a, b])})

    return run


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, tile: int = 128, shard_rows: int = 200_000, broadcast_groups: int = 100_000) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part (pair, term), item, value, rank."""
    counts = cut(term_counts(docs))
    each = counts.filter("term IS NOT NULL")
    vocabulary = cut(each.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"))
    kept = cut(each.drop("docs").join(vocabulary, ["lang", "term"]))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    tiles = F.ceil(F.count("*").over(of_lang) / tile)
    groups = groups.withColumns({"number": F.row_number().over(of_lang.orderBy("source")) - 1, "tiles": tiles, "p0": _share(F.lit(0), F.col("total"), F.col("terms"))})
    groups = cut(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("rows").over(of_lang) * F.col("tiles") / shard_rows)).cast("int")))
    sent = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    rows = kept.join(sent, ["lang", "source"]).withColumns({"p": p, "q": q})

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    def tiled(df: DataFrame, shard: Column, term: Column, p: Column, source: Column) -> DataFrame:
        mine = F.call_function("div", F.col("number"), F.lit(tile)).cast("int")
        out = df.withColumn("beside", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
        return out.select("lang", F.least(mine, F.col("beside")).alias("a"), F.greatest(mine, F.col("beside")).alias("b"), shard.cast("int").alias("shard"), F.col("number").cast("long").alias("number"), term.cast("string").alias("term"), p.alias("p"), source.cast("string").alias("source"), F.col("terms").cast("long").alias("terms"))

    shards = tiled(rows, F.pmod(F.xxhash64("term"), F.col("shards")), F.col("term"), F.col("p"), F.lit(None))
    heads = tiled(groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))), F.col("shard"), F.lit(None), F.col("p0"), F.col("source"))
    sums = shards.unionByName(heads).groupBy("lang", "a", "b", "shard").applyInArrow(_shard(tile), "lang string, one string, other string, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("one", "other"), ("other", "one"))])
    pairs = sums.select("lang", F.explode(both).alias("s"), "value").select("lang", "s.source", "s.item", "value").withColumn("rank", F.row_number().over(best))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").union(part(terms, "term"))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence": op12_divergence}
SQL = {
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(n.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
l AS MATERIALIZED (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
}
