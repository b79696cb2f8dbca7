"""Operator 6: MinHash near-duplicates with fast similarity sketches (Dahlgaard, Knudsen and Thorup 2017).

A sketch has `coords` coordinates. In each of the first `coords` rounds every shingle is hashed to one coordinate that it
may fill; in the next `coords` rounds all shingles go to the round's own coordinate, so every coordinate is filled. A
coordinate keeps the least hash of the first round that reached it. Most documents are done after a round or two, and
equal coordinates estimate the Jaccard similarity with concentration bounds like those of independent samples.

Bands of `rows` coordinates give candidates: with 51 bands of 5 a pair at similarity 0.75 shares no band with
probability (1 - 0.75^5)^51 < 2e-6. Documents with equal shingle sets form a class first. In each band bucket every class
is verified against the bucket's centre, the class that shares most band keys; then, for `turns` rounds, the classes
that are still in another component than the centre against one class of its component, in each bucket another one; at
last, in buckets that still span several components, all pairs across components. No pair within a component is needed,
so copies aren't expanded into pairs, and no candidate link between components stays untested. Verification is on the
full shingle sets, after two filters that are exact bounds: the set sizes, and the parities: how many shingles fall on
each of PARITIES places, modulo two. Two sets differ in as many shingles at least as their parities do, so a pair whose
parities differ in more places than a link allows is none.

Words are runs of characters other than space and \\x09-\\x0D, A-Z lower-cased; a set holds the distinct runs of `width`
words as 64-bit hashes (set classes compare 128 bits), or the whole sequence if there are fewer words.

Defined results: null, empty and blank texts have an empty set and are linked with nothing. Repeated rows of one doc_id
count as one document if their sets are equal, else each goes with its own text. A null doc_id is linked with nothing and keeps a null component. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, M3, U, components, cut, lower_ascii, mix, runs, slices, span_hashes, table, utf8

CHUNK = 2 << 20
PARITIES = 1024


def shingles(offsets: np.ndarray, buf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, sorted."""
    buf = lower_ascii(buf)
    starts, ends = runs(~((buf == 32) | ((buf >= 9) & (buf <= 13))), offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = span_hashes(buf, starts, ends)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    h = np.zeros(len(words), U)
    full = max(len(words) - width + 1, 0)
    acc = np.zeros(full, U)
    for j in range(width):
        acc = mix((acc ^ words[j : j + full]) + M1)
    h[:full] = acc
    place = np.arange(len(words)) - first[doc]
    whole = place + width <= n[doc]
    short = np.flatnonzero((n > 0) & (n < width))
    for d in short:
        x = U(0)
        for w in words[first[d] : first[d] + n[d]]:
            x = mix(np.array([(x ^ w)], U) + M1)[0]
        h[first[d]] = mix(np.array([x ^ U(n[d])], U))[0]
        whole[first[d]] = True
    doc, h = doc[whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sketches(doc: np.ndarray, h: np.ndarray, docs: int, coords: int) -> np.ndarray:
    """A row of `coords` values for each document; those without shingles keep the largest value."""
    top = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(docs * coords, top, U)
    filled = np.zeros(docs * coords, bool)
    for r in range(2 * coords):
        x = mix(h ^ (np.full(1, r + 1, U) * M2))
        if r < coords:
            slot = doc * coords + (x % U(coords)).astype(np.int64)
            value = mix(x * M3 + U(r))
        else:
            slot, value = doc * coords + (r - coords), x
        open_ = ~filled[slot]
        s = slot[open_]
        if s.size:
            np.minimum.at(out, s, np.minimum(value[open_], top - U(1)))
            filled[s] = True
        if r % 4 == 0 or r < 4:
            todo = ~filled.reshape(docs, coords).all(axis=1)
            keep = todo[doc]
            doc, h = doc[keep], h[keep]
            if not doc.size:
                break
    return out.reshape(docs, coords)


def _described(docs: DataFrame, width: int, coords: int, rows: int) -> DataFrame:
    bands = coords // rows

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            all_offsets, all_buf = utf8(batch.column(1))
            for i, j in slices(all_offsets, CHUNK):
                base = all_offsets[i]
                offsets = all_offsets[i : j + 1] - base
                doc, h = shingles(offsets, all_buf[base : all_offsets[j]], width)
                n = np.bincount(doc, minlength=j - i)
                sk = sketches(doc, h, j - i, coords)
                key = np.zeros((j - i, bands), U) + np.arange(1, bands + 1, dtype=U) * M1
                for r in range(rows):
                    key = mix((key ^ sk[:, r : bands * rows : rows]) + M2)
                s1, s2 = _sums(doc, h, j - i)
                odd = np.zeros((j - i) * (PARITIES // 64), U)
                place = (h >> U(9)) % U(PARITIES)
                np.bitwise_xor.at(odd, doc * (PARITIES // 64) + (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
                yield pa.record_batch([
                    pa.array(number + np.arange(j - i)), batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(odd.view(np.int64)), PARITIES // 64).cast(pa.list_(pa.int64())),
                ], ["row", "doc_id", "n_shingles", "s1", "s2", "bands", "odd"])
                number += j - i

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, odd array<long>")


def _sums(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    s1, s2 = np.zeros(docs, U), np.zeros(docs, U)
    np.add.at(s1, doc, mix(h + M1))
    np.add.at(s2, doc, mix(h ^ M3))
    return s1, s2


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            all_offsets, all_buf = utf8(batch.column(1))
            for i, j in slices(all_offsets, CHUNK):
                base = all_offsets[i]
                doc, h = shingles(all_offsets[i : j + 1] - base, all_buf[base : all_offsets[j]], width)
                s1, s2 = _sums(doc, h, j - i)
                at = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["doc_id", "s1", "s2", "set"])

    return docs.mapInArrow(run, "doc_id long, s1 long, s2 long, set array<long>")


def _apart(a: str, b: str) -> F.Column:
    """In how many places the parities differ: no more than the shingles that only one of the sets has."""
    out = F.lit(0)
    for i in range(PARITIES // 64):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b): the components of a graph of components."""
    for x in ("a", "b"):
        more = more.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    between = cut(more.filter("ca <> cb").select("ca", "cb").distinct())
    if not between.limit(1).count():
        return labels
    found = cut(components(between, "ca", "cb"))
    known = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(known.union(found.join(labels.select("node"), "node", "left_anti").select("node", "component")))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, coords: int = 256, rows: int = 5, turns: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept. Links: den * intersection >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    seen = cut(_described(docs, width, coords, rows))
    some = seen.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class of equal sets stands for its members; its node is the row of its smallest doc_id
    classes = cut(some.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("s1", "s2", "n_shingles", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("least")))
    reps = cut(some.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "doc_id", "s1", "s2", F.col("n_shingles").alias("n"), "bands", "odd"))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1")
    placed = cut(keys.join(shared, "key"))
    weight = placed.groupBy("rep").agg(F.sum("count").alias("weight"))
    centres = placed.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
    placed = cut(placed.join(centres, "key").select("key", "rep", "centre"))

    involved = placed.select("rep").distinct()
    facts = cut(reps.join(involved, "rep", "left_semi"))
    # by the set too, as a doc_id may come with several texts; rows of one doc_id and one set give one set
    found_sets = _sets(docs.join(facts.select("doc_id").distinct(), "doc_id", "left_semi"), width)
    found_sets = found_sets.groupBy("doc_id", "s1", "s2").agg(F.first("set").alias("set"))
    sets = cut(found_sets.join(facts.select("rep", "doc_id", "s1", "s2"), ["doc_id", "s1", "s2"]).select("rep", "set"))
    of_a, of_b = (facts.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}"), F.col("bands").alias(f"bands{x}")) for x in "ab")
    alike = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    # similarity num / den at least, for sets of na and nb that differ in d shingles: (num + den) * d <= (den - num) * (na + nb)
    alike &= (num + den) * _apart("odda", "oddb") <= (den - num) * (F.col("na") + F.col("nb"))

    def verified(near: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb) those that are links, by their full sets."""
        both = near.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("seta")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("setb")), "b")
        common = F.size(F.array_intersect("seta", "setb"))
        return both.filter(den * common >= num * (F.col("na") + F.col("nb") - common)).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(verified(pairs.distinct().join(of_a.drop("bandsa"), "a").join(of_b.drop("bandsb"), "b").filter(alike).select("a", "b", "na", "nb")))

    def named() -> DataFrame:
        """Each class of each bucket with its component and that of the bucket's centre."""
        own = placed.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        central = labels.select(F.col("node").alias("centre"), F.col("component").alias("main"))
        return own.join(central, "centre", "left").withColumn("main", F.coalesce("main", "centre"))

    links = linked(placed.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    labels = cut(components(links))
    for turn in range(turns):  # classes outside the centre's component against one class inside it, in every bucket another one
        now = cut(named())
        apart = now.filter("component <> main")
        if not apart.limit(1).count():
            break
        # a quarter of the keys for each turn: this only makes components meet sooner, the last comparison decides
        quarter = F.pmod(F.xxhash64("key", F.lit(turns + turn)), F.lit(4)) == 0
        one = now.filter((F.col("component") == F.col("main")) & quarter).groupBy("key").agg(F.max_by("rep", F.xxhash64("rep", "key", F.lit(turn))).alias("b"))
        labels = _joined(labels, linked(apart.join(one, "key").filter("b <> centre").select(F.col("rep").alias("a"), "b")))
    now = cut(named())
    # what is still outside, against all members of other components; a pair counts at the first key that both have
    apart = now.filter("component <> main").select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), "centre").join(of_a, "a")
    rest = now.join(apart.select("key").distinct(), "key", "left_semi").select("key", F.col("rep").alias("b"), F.col("component").alias("cb")).join(of_b, "b")
    others = apart.withColumnRenamed("key", "keya")
    first = F.col("keya") == F.array_intersect("bandsa", "bandsb")[0]
    both = F.col("ca").isNotNull() & (F.col("ca") != F.col("cb")) & (F.col("b") != F.col("centre"))
    across = others.join(rest, (F.col("keya") == F.col("key")) & both & alike & first)
    second = cut(verified(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()))
    labels = _joined(labels, second)
    labels = labels.select(F.col("node").alias("rep"), "component")
    named_ = classes.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named_.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named_.join(least, "component").select("s1", "s2", "n_shingles", "component_id")
    found = some.select("doc_id", "s1", "s2", "n_shingles").join(ids, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = seen.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_minhash": op6_minhash}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op6_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.node WHERE reach.c < link.b),
least AS (SELECT node, min(c) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
}
