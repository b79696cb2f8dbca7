"""Operator 11: codes of vectors by one codebook for each part, fitted with active-entry Lloyd rounds (Kaukoranta, Fränti and
Nevalainen 2000).

A component x becomes the integer floor(scale * x), so all arithmetic is exact. Vectors are cut into `parts` equal
consecutive parts; a part's codebook begins as that part of the first `entries` vectors by id. A round assigns every part
to its nearest entry (squared Euclidean distance, the lower index of equally near ones) and replaces each entry by the
floor of its parts' mean; an entry without parts stays.

Each round is one pass of `mapInArrow` over the table that the round before wrote. Beside a vector the table holds the
entry of each part and the exact distance to it. A part whose entry didn't move in the last update keeps that distance,
and no other entry that stayed can have become nearer, so it is compared with the entries that moved only; all other
parts are compared with the whole codebook. The tasks write sums and counts of each entry into the same files, at most
parts * entries rows a task, which Spark adds up; only these parts * entries sums, of a size fixed by the parameters and the vectors'
length, reach the driver, and go back as the next codebook. A lost executor costs the tasks it ran: each round's input is
a written table.

Defined results. Vectors are left out when they are null or empty, hold null, NaN or infinite components, hold a
component of an amount beyond 2^30.5 / sqrt(length) after scaling (their distances would not fit a long), or have another length than most of the
kept ones whose length the parts divide (ties: the smaller length). Ids may repeat or be null (null sorts last); rows of
one id are ordered by their vectors, and each is a vector of its own. Null labels are one label. With fewer than `entries` vectors the codebooks are as short; an empty
table gives an empty result. Only the id and the label are carried; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

STATE = "id long, label string, vector array<int>, code binary, far array<long>, part int, entry int, n long, total array<long>"
ROWS = 4096


@dataclass
class Compressed:
    """rows: id, label (as text), vector (scaled), code (an index a part), far (squared distances); codebooks: part, entry, vector."""

    rows: DataFrame
    codebooks: DataFrame
    books: np.ndarray
    sha256: str


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows. Products of doubles are exact below 2^53, and faster than those of longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None, far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of the parts x and their distances, and how many distances were computed. code and far: those for
    the codebook before `moved` of its entries moved, None in the first round."""
    every = np.ones(len(x), bool) if code is None else moved[code]
    code = np.zeros(len(x), np.int64) if code is None else code.copy()
    far = np.zeros(len(x), np.int64) if far is None else far.copy()
    whole = np.flatnonzero(every)
    work = len(whole) * len(book)
    if whole.size:
        d = distances(x[whole], book)
        code[whole] = d.argmin(axis=1)  # the first of equal ones
        far[whole] = d[np.arange(len(whole)), code[whole]]
    active, fixed = np.flatnonzero(moved), np.flatnonzero(~every)
    if fixed.size and active.size:
        work += len(fixed) * len(active)
        d = distances(x[fixed], book[active])
        at = d.argmin(axis=1)
        best, entry = d[np.arange(len(fixed)), at], active[at]
        nearer = (best < far[fixed]) | ((best == far[fixed]) & (entry < code[fixed]))
        code[fixed[nearer]], far[fixed[nearer]] = entry[nearer], best[nearer]
    return code, far, work


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray, first: bool, path: str) -> DataFrame:
    """Writes the rows with their new entries, and the sums of each task behind them."""
    sent = state.sparkSession.sparkContext.broadcast((books, moved))
    parts, entries, width = books.shape
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("vector", pa.list_(pa.int32())), ("code", pa.binary()), ("far", pa.list_(pa.int64())), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches):
        books, moved = sent.value
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = b.column(2).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, parts, width)
                old = None if first else np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                was = None if first else b.column(4).flatten().to_numpy().reshape(-1, parts)
                code, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
                for p in range(parts):
                    code[:, p], far[:, p], _ = assign(x[:, p], books[p], moved[p], None if first else old[:, p], None if first else was[:, p])
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(total[p], code[:, p], x[:, p])
                packed = code.astype(np.uint8)
                none = pa.nulls(len(x))
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in packed], pa.binary()), _lists(far, pa.int64()), *[none.cast(f.type) for f in list(schema)[5:]]], schema=schema)
        p, e = np.nonzero(n)
        none = pa.nulls(len(p))
        yield pa.record_batch([*[none.cast(f.type) for f in list(schema)[:5]], pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), _lists(total[p, e], pa.int64())], schema=schema)

    state.mapInArrow(run, STATE).write.option("compression", "zstd").parquet(path)
    return state.sparkSession.read.schema(STATE).parquet(path)


def _drop(spark, path: str) -> None:
    """Deletes a round's table, from whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def compress(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Compressed:
    """A code has a byte a part, so there may be 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    spark = vectors.sparkSession
    v, n = F.col("v"), F.size("v")
    inside = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(2.0**30.5) / F.sqrt(n) - 1))
    base = vectors.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    scaled = cut(base.filter(v.isNotNull() & (n > 0) & inside).withColumn("vector", F.transform(v, lambda x: F.floor(x * scale).cast("int"))).drop("v"))
    usual = scaled.filter(F.size("vector") % parts == 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        rows = scaled.filter("false").select("id", "label", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<long>").alias("far"))
        return Compressed(rows, spark.createDataFrame([], "part int, entry int, vector array<long>"), np.zeros((parts, 0, 0), np.int64), hashlib.sha256(b"").hexdigest())
    state = scaled.filter(F.size("vector") == usual.d)
    seeds = state.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    books = np.array([r.vector for r in seeds], np.int64).reshape(len(seeds), parts, usual.d // parts).transpose(1, 0, 2).copy()
    moved = np.ones(books.shape[:2], bool)
    state = state.select("id", "label", "vector", *[F.lit(None).cast(k).alias(c) for c, k in (("code", "binary"), ("far", "array<long>"))])
    last = None
    for turn in range(rounds + 1):
        path = shared_dir(spark)
        written = _round(state, books, moved, turn == 0, path)
        state = written.filter("part IS NULL").select("id", "label", "vector", "code", "far")
        if last:
            _drop(spark, last)
        last = path
        if turn == rounds:
            break
        cells = written.filter("part IS NOT NULL").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        sums = cells.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        means = sums.select("part", "entry", "at", F.expr("(x - pmod(x, n)) div n").alias("x")).collect()
        after = books.copy()
        for r in means:
            after[r.part, r.entry, r.at] = r.x
        moved, books = (after != books).any(axis=2), after
    text = ",".join(map(str, books.ravel().tolist()))
    sent = [(p, e, books[p, e].tolist()) for p in range(parts) for e in range(books.shape[1])]
    return Compressed(state, spark.createDataFrame(sent, "part int, entry int, vector array<long>"), books, hashlib.sha256(text.encode()).hexdigest())


def with_label_error(rows: DataFrame, broadcast_labels: int = 200_000) -> DataFrame:
    """Adds `error`, a vector's squared distance from what its code stands for, and `label_error`, the sum over its label
    (null where it doesn't fit a long). Sums are made before anything is shuffled; beyond `broadcast_labels` labels they
    are joined from a written table, where adaptive execution splits a hot label."""
    rows = rows.withColumn("error", F.aggregate("far", F.lit(0).cast("long"), lambda a, x: a + x))
    sums = cut(rows.groupBy(F.col("label").alias("label_")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    few = sums.count() <= broadcast_labels
    return rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("label_")), "left").drop("label_")


def decode(rows: DataFrame, codebooks: DataFrame, scale: int = 1024) -> DataFrame:
    """Adds `decoded`, the vector that a row's code stands for. The codebooks have parts * entries rows."""
    books = codebooks.agg(F.map_from_entries(F.collect_list(F.struct(F.col("part") * 256 + F.col("entry"), "vector"))).alias("books_"))
    byte = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    out = F.flatten(F.transform(F.sequence(F.lit(0), F.length("code") - 1), lambda p: F.element_at("books_", p * 256 + byte(p))))
    return rows.crossJoin(F.broadcast(books)).withColumn("decoded", F.transform(out, lambda x: (x + 0.5) / scale)).drop("books_")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    done = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(done.rows).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.sha256).alias("codebooks_sha256"))


def _sql(rounds: int = 4, parts: int = 4) -> str:
    """The rounds one after the other: nearest entries, then means."""
    steps = [
        """e AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w FROM e, (SELECT unnest(range({parts})) AS p))",
        "b0 AS (SELECT p, r - 1 AS k, w AS c FROM x WHERE r <= 256)",
    ]
    far = "list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, x.p, min({{'d': CAST({far} AS BIGINT), 'k': k}}) AS best FROM x JOIN b{t} b ON b.p = x.p GROUP BY r, x.p)")
        if t < rounds:
            steps.append(
                f"m{t} AS (SELECT p, k, list(y ORDER BY i) AS c FROM (SELECT p, k, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y "
                f"FROM (SELECT x.p, a.best.k AS k, unnest(range(len(w))) AS i, unnest(w) AS y FROM x JOIN a{t} a ON a.r = x.r AND a.p = x.p) GROUP BY p, k, i) GROUP BY p, k)"
            )
            steps.append(f"b{t + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{t} b LEFT JOIN m{t} m ON m.p = b.p AND m.k = b.k)")
    return f"""WITH {", ".join(steps)},
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN e USING (r), s"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
SQL = {"op11_vector_codes": _sql()}
