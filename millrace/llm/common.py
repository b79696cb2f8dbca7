"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Odd multipliers for mixing 64-bit words.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by PYTHONPATH."""
    top, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "millrace_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "millrace").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only a local session may do without:
    there the driver is the only machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: ends the lineage, and is computed once for all its readers."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with more underscores before it, so that it is none of those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All strings as one byte array, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], buf


def slices(offsets: np.ndarray, most: int):
    """Runs of strings (first, end) of at most `most` bytes together, or of a single longer string."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which goes over an offset."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    return np.flatnonzero(mask & (~before | edge[:-1])), np.flatnonzero(mask & (~after | edge[1:])) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time for all spans together."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))
    left = ends - starts
    out = left.astype(U) * M1
    live = np.arange(len(starts))
    at = starts
    while live.size:
        block = eights[at].view(">u8").ravel().astype(U)
        short = np.minimum(left, 8)
        block >>= ((8 - short) * 8).astype(U) & U(63)
        out[live] = mix((out[live] ^ block) + M1)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 for each i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def multikey_order(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with a word as character: sorts by the first word, then only what is tied so far by the next one.
    The first word is an array, each other one an array or a function that gives the words of some rows, so that the
    characters of rows that are already apart are never looked at. Returns the order, and which sorted rows differ from
    the one before."""
    n = len(words[0])
    order = np.argsort(words[0])
    new = np.ones(n, bool)
    first = words[0][order]
    new[1:] = first[1:] != first[:-1]
    for w in words[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not at.size:
            break
        values = w(order[at]) if callable(w) else w[order[at]]
        sub = np.lexsort((values, np.cumsum(new[at])))
        order[at] = order[at][sub]
        values = values[sub]
        differs = values[1:] != values[:-1]
        new[at[1:]] |= differs
    return order, new


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40, broadcast_edges: int = 200_000) -> DataFrame:
    """Connected components of undirected links as rows (node, component): the smallest node that can be reached.
    Alternating large-star and small-star rounds (Kiveris et al. 2014); every round is a written table, and no
    neighbourhood is gathered in one place. Each node's least neighbour is joined to its edges as a broadcast while there
    are at most `broadcast_edges`, else from a written table, so that adaptive execution can split a hub's edges. Nodes
    without links don't appear."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        few = edges.count() <= broadcast_edges
        sent = F.broadcast if few else cut
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sent(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = sent(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = cut(small)
        # done when every node has one edge only and no target is itself moved
        targets = after.select(F.col("v").alias("u")).distinct()
        moved = after.join(F.broadcast(targets) if few else targets, "u", "left_semi").limit(1).count()
        many = after.groupBy("u").count().filter("count > 1").limit(1).count()
        edges = after
        if not moved and not many:
            break
    else:
        raise RuntimeError("components: not settled")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
