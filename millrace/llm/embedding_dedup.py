"""Operator 4: near-duplicate vectors by iterative quantisation (Gong and Lazebnik 2011) and multi-index Hamming tables.

Vectors are normalised; a rotation of their principal axes is learned on at most about `sample_rows` of them so that
signs lose as little as possible, and each vector gets a code of as many bits as it has dimensions, 64 at most. The code
is cut into pieces with a table each, of about as many bits as it takes to tell the vectors of a label apart. A vector
looks up every piece at distance nought and one (or two, see below). A pair goes on if its codes differ in at most `far` bits, at the first
table that finds it, so that none comes up twice, and is reranked by the cosine of the original vectors in double
precision.

How many codes. One rotation finds nearly all links where vectors point everywhere. Where they share a direction, links
are wide apart once the mean is taken away, and one doesn't. So recall is measured while fitting: sampled vectors are
turned by just the angle of `cosine`, half of them in any direction and half of them in directions in which the sample
itself differs, and rotations (with codes and tables of their own) are added from other starts until both halves find
`recall` of their partners; if `most_turns` rotations don't do, pieces are looked up with two wrong bits as well, and
only then get shorter, down to eight bits. That costs time where vectors lie close together, not links. Recall against brute force is measured in tests/llm, for
vectors without and with a common direction (at least 0.98 there).

Equal vectors of a label form a class first and are never paired. The rest of the work grows with the candidates and
with the links between different vectors, which n_links counts. Rotations and means of each vector length go to every
task; the sample is all that comes to the driver.

Defined results: null, empty and zero vectors, and those with null or non-finite components, link with nothing, as do
vectors whose label is null. Vectors of different lengths never link. Lengths of any finite size count (vectors are
scaled before they are squared). Repeated rows of one vec_id with one vector count once. A null vec_id links with
nothing. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, table

#: Vectors whose recall is measured, and the share of turned vectors that `far` lets through.
MEASURED, NEAR = 1500, 0.9995


class Quantiser:
    """Rotations whose signs are the bits of codes, with the pieces of the codes that are looked up."""

    def __init__(self, x: np.ndarray, width: int, cosine: float, recall: float, most_turns: int, seed: int = 7):
        self.bits, self.mean = min(64, x.shape[1]), x.mean(axis=0)
        axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean))[1].T[::-1][: self.bits]  # principal axes, the largest first
        v = (x - self.mean) @ axes.T
        rng = np.random.default_rng(seed)
        turns: list[np.ndarray] = []
        near = [self._turned(x, cosine, way, rng) for way in (False, True)] if len(x) > 2 and x.shape[1] > 1 else []
        # more rotations first, then pieces with two wrong bits, then shorter pieces, which make larger buckets
        shortest = min(8, self.bits)
        for width in [*range(min(width, self.bits), shortest, -4), shortest]:
            self.width, self.pieces = width, max(1, self.bits // width)
            for self.radius in (1, 2):
                for n in range(1, most_turns + 1):
                    if n > len(turns):
                        turns.append(axes.T @ self._rotation(v, rng))
                    if self.radius == 1 and n < len(turns) and width < self.bits and n < most_turns:
                        continue  # for shorter pieces all rotations are there
                    self.turns = turns[:n]
                    self.far, self.recall = self._measured(near)
                    if self.recall >= recall:
                        return

    @staticmethod
    def _rotation(v: np.ndarray, rng, rounds: int = 30) -> np.ndarray:
        turn = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (a @ b).T
        return turn

    @staticmethod
    def _turned(x: np.ndarray, cosine: float, by_sample: bool, rng) -> tuple[np.ndarray, np.ndarray]:
        """Some vectors, and each turned by the angle of `cosine`."""
        a = x[rng.integers(0, len(x), MEASURED)]
        way = x[rng.integers(0, len(x), MEASURED)] - x[rng.integers(0, len(x), MEASURED)] if by_sample else rng.normal(size=a.shape)
        way = way - (way * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(way, axis=1, keepdims=True)
        ok = size.ravel() > 1e-9
        return a[ok], cosine * a[ok] + np.sqrt(1 - cosine**2) * way[ok] / size[ok]

    def _measured(self, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, float]:
        """The bits by which the first two codes of nearly all turned vectors differ, and the share of them that is found."""
        differ = [self.codes(a) ^ self.codes(b) for a, b in near if len(a)]
        if not differ:
            return 2 * self.bits, 1.0
        apart = [np.bitwise_count(d[:, :2]).sum(axis=1, dtype=np.int64) for d in differ]
        far = int(max(np.quantile(x, NEAR) for x in apart)) + 1
        found = []
        for d, x in zip(differ, apart, strict=True):
            some = np.zeros(len(d), bool)
            for t in range(self.pieces):
                some |= (np.bitwise_count((d >> np.uint64(t * self.width)) & np.uint64((1 << self.width) - 1)) <= self.radius).any(axis=1)
            found.append((some & (x <= far)).mean())
        return far, float(min(found))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of codes for each unit vector, one for each rotation."""
        out = np.empty((len(x), len(self.turns)), np.uint64)
        for k, turn in enumerate(self.turns):
            code = np.zeros((len(x), 64), bool)
            code[:, : self.bits] = (x - self.mean) @ turn >= 0
            out[:, k] = np.packbits(code, axis=1, bitorder="little").view("<u8").ravel()
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.99, sample_rows: int = 10_000, most_turns: int = 24) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)))
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")).withColumn("dim", F.size("embedding")))
    sizes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).filter("most > 1").collect()  # a row for each length of vector
    if not sizes:
        links = classes.sparkSession.createDataFrame([], "a long, b long")
    else:
        share = F.lit(0.0)
        for r in sizes:
            share = F.when(F.col("dim") == r.dim, min(1.0, sample_rows / len(sizes) / r.n)).otherwise(share)
        some = classes.filter((F.xxhash64("rep") / F.lit(2.0**64) + 0.5) < share + F.when(share >= 1, 1.0).otherwise(0.0)).select("dim", "embedding").toPandas()
        models = {}
        for r in sizes:
            x = np.array(some.loc[some["dim"] == r.dim, "embedding"].tolist(), np.float64).reshape(-1, r.dim)
            x = _unit(x) if len(x) else np.eye(r.dim)
            models[r.dim] = Quantiser(x, int(np.clip(np.ceil(np.log2(r.most)) + 3, 8, 30)), cosine, recall, most_turns)
        links = _links(classes.filter(F.col("dim").isin(list(models))), models, cosine)
    links = cut(links)
    size = classes.select("rep", "n")
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    per = both.join(size.select(F.col("rep").alias("other"), F.col("n").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("linked"))
    label = components(links).withColumnRenamed("node", "rep")
    facts = classes.join(per, "rep", "left").join(label, "rep", "left").select("label", "embedding", F.coalesce("linked", F.lit(0)).alias("linked"), "n", F.coalesce("component", "rep").alias("component"))
    # by hash of the vector, not by the vector itself, to keep the join's key short
    key = F.xxhash64("label", "embedding")
    facts = facts.withColumn("key", key).withColumnRenamed("embedding", "e").withColumnRenamed("label", "l")
    # the vector's class, if it has one; another class of the same hash is no match
    same = (F.col("r.key") == F.col("f.key")) & (F.col("f.e") == F.col("r.embedding")) & (F.col("f.l") == F.col("r.label"))
    known = rows.withColumn("key", key).alias("r").join(facts.alias("f"), same, "left")
    ok = F.col("e").isNotNull() & F.col("vec_id").isNotNull()
    return known.select(
        "vec_id", F.when(ok, F.col("linked") + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"), F.when(ok, F.col("component")).otherwise(F.col("vec_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, models: dict[int, Quantiser], cosine: float) -> DataFrame:
    """Pairs of classes (a, b) of one label and length whose vectors are at least that near."""
    sent = classes.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column(3))
            for dim in np.unique(dims):
                own, model = batch.filter(pa.array(dims == dim)), sent.value[int(dim)]
                x = np.asarray(own.column(2).flatten()).astype(np.float64).reshape(-1, dim)
                codes = model.codes(_unit(x))
                n, k = codes.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(codes.view(np.int64).ravel()))
                fixed = [pa.array(np.full(n, x, np.int32)) for x in (model.width, model.pieces, model.far, model.radius)]
                # very long and very short vectors are scaled, so that squares neither overflow nor vanish
                top = np.abs(x).max(axis=1, keepdims=True)
                x = x / np.where((top < 1e-100) | (top > 1e100), top, 1.0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.record_batch([own.column(0), own.column(1), own.column(3), lists, *fixed, vectors, pa.array(np.linalg.norm(x, axis=1))], ["rep", "label", "dim", "codes", "width", "pieces", "far", "radius", "v", "norm"])

    kind = classes.schema["label"].dataType.simpleString()
    codes = cut(classes.select("rep", "label", "embedding", "dim").mapInArrow(run, f"rep long, label {kind}, dim int, codes array<long>, width int, pieces int, far int, radius int, v array<double>, norm double"))
    piece = "CAST(shiftrightunsigned({code}, CAST(t % pieces AS INT) * width) & (shiftleft(1L, width) - 1) AS INT)"
    all_ = "sequence(0, size(codes) * pieces - 1)"
    values = F.posexplode(F.expr(f"transform({all_}, t -> {piece.format(code='codes[CAST(t DIV pieces AS INT)]')})"))
    held = codes.select(F.col("rep").alias("b"), F.col("codes").alias("cb"), "label", "dim", values.alias("table", "value"))
    asked = codes.select(F.col("rep").alias("a"), F.col("codes").alias("ca"), "label", "dim", "width", "pieces", "far", "radius", values.alias("table", "own"))
    one = "transform(sequence(0, width - 1), i -> own ^ shiftleft(1, i))"
    two = "flatten(transform(sequence(0, width - 2), i -> transform(sequence(i + 1, width - 1), j -> own ^ shiftleft(1, i) ^ shiftleft(1, j))))"
    asked = asked.withColumn("value", F.explode(F.expr(f"concat(array(own), {one}, CASE WHEN radius > 1 AND width > 1 THEN {two} ELSE CAST(array() AS array<int>) END)"))).drop("own")
    apart = " + ".join(f"coalesce(bit_count(get(ca, {k}) ^ get(cb, {k})), 0)" for k in range(2))
    earlier = piece.format(code="(ca[CAST(t DIV pieces AS INT)] ^ cb[CAST(t DIV pieces AS INT)])")
    first = f"NOT exists(slice({all_.replace('codes', 'ca')}, 1, table), t -> bit_count({earlier}) <= radius)"
    pairs = asked.join(held, ["label", "dim", "table", "value"]).filter(f"a < b AND {apart} <= far AND {first}").select("a", "b")
    vec = codes.select("rep", "v", "norm")
    both = pairs.join(vec.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), "a").join(vec.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return both.filter(dot / (F.col("na") * F.col("nb")) >= cosine).select("a", "b")


def op4_itq(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_itq": op4_itq}
SQL = {
    "op4_itq": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.node WHERE reach.c < link.b),
least AS (SELECT node, min(c) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON node = vec_id LEFT JOIN n ON a = vec_id
"""
}
