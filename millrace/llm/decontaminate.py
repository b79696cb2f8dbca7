"""Operator 8: benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words (64-bit hashes of runs of [0-9a-z] and characters from U+0080, A-Z lower-cased), the patterns are
the windows of `window` words of each benchmark item; an item of fewer words is one pattern of its own length. Each
pattern length has a block shift table over two-word blocks (one word where patterns have one): it tells how far the
search may move on because no pattern has that block nearer to its end. All texts of a batch are searched together: one
cursor for each stretch of words, moved by its own shifts. Where the shift is nought, the hashes of the last block and
of the whole string select the patterns to test, and the words themselves are compared, as text.

Scale. Only the shift tables are sent to the tasks: a byte for each slot, 16 MB at most for each of the `window` pattern
lengths, however large the benchmark; they are made by tasks and merged by slices. The patterns stay in a table that the
strings to be tested are joined with by hash (as a broadcast up to `broadcast_windows` patterns, else by shuffling, where
adaptive execution splits hot ones), so documents are read once at any size of the benchmark. Which items have a pattern
is joined by document and pattern, not by occurrence.

Defined results: null and empty texts have no words: n_words 0, not contaminated. Null benchmark texts and items without
an item_id have no windows. Repeated rows give a row each. Other columns are ignored, whatever their names; an empty
benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M1, M2, U, cut, lower_ascii, mix, ragged, runs, slices, span_hashes, table, utf8

CHUNK = 2 << 20
STRETCH = 512
SLICE = 1 << 16


class Words:
    """The words of some texts."""

    def __init__(self, offsets: np.ndarray, buf: np.ndarray):
        self.buf = lower_ascii(buf)
        self.starts, self.ends = runs((self.buf >= 128) | ((self.buf >= 48) & (self.buf <= 57)) | ((self.buf >= 97) & (self.buf <= 122)), offsets)
        self.hash = span_hashes(self.buf, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)  # the first word of each text

    def strings(self, at: np.ndarray, m: int) -> tuple[pa.Array, np.ndarray]:
        """The m words from each place with one space between them, and hashes of these strings."""
        word = ragged(at, np.full(len(at), m))
        size = self.ends[word] - self.starts[word] + 1
        flat = np.append(self.buf, np.uint8(32))[ragged(self.starts[word], size)]
        stop = np.cumsum(size)
        flat[stop - 1] = 32
        bounds = np.concatenate([[0], stop])[::m]
        text = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])
        return text.cast(pa.binary()), span_hashes(flat, bounds[:-1], bounds[1:])


def last_block(words: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    """A hash of the `block` words (one or two) up to each place."""
    h = mix(words[end - block + 1] + M1)
    return mix((h ^ words[end]) + M2) if block == 2 else h


class Shifts:
    """The shift table for patterns of m words."""

    def __init__(self, m: int, bits: int, shift: np.ndarray | None = None):
        self.m, self.bits, self.block = m, bits, min(2, m)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8) if shift is None else shift

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def add(self, patterns: np.ndarray) -> None:
        """patterns: a row of m word hashes each."""
        reach = self.m - self.block + 1
        flat, base = patterns.ravel(), np.arange(len(patterns)) * self.m
        for j in range(reach):  # a block that ends d words before the pattern's end allows a shift of d
            np.minimum.at(self.shift, self._slot(last_block(flat, base + j + self.block - 1, self.block)), np.uint8(reach - 1 - j))

    def search(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in words, inside the given ranges, where a pattern may begin."""
        m = self.m
        fits = ends - starts >= m
        starts, ends = starts[fits], ends[fits]
        pieces = -(-(ends - starts - m + 1) // STRETCH)
        at = np.repeat(starts, pieces) + ragged(np.zeros(len(pieces), np.int64), pieces) * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(ends - m + 1, pieces))
        found = [np.zeros(0, np.int64)]
        while at.size:
            step = self.shift[self._slot(last_block(words, at + m - 1, self.block))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found))


def windows(items: DataFrame, window: int) -> DataFrame:
    """items (item_id, text) -> number (a unique one), item_id, m, key, string, words: a row for each window."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            offsets, buf = utf8(batch.column(1))
            for i, j in slices(offsets, CHUNK):
                w = Words(offsets[i : j + 1] - offsets[i], buf[offsets[i] : offsets[j]])
                n = np.diff(w.bounds)
                for m in np.unique(np.minimum(n, window)).tolist():
                    mine = np.flatnonzero(np.minimum(n, window) == m)
                    count = n[mine] - m + 1
                    for x, y in slices(np.concatenate([[0], np.cumsum(count * m)]), 1 << 20) if m else []:
                        at, owner = ragged(w.bounds[mine[x:y]], count[x:y]), np.repeat(mine[x:y], count[x:y])
                        string, key = w.strings(at, m)
                        rows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 8 * m).astype(np.int32)), pa.py_buffer(w.hash[ragged(at, np.full(len(at), m))])])
                        yield pa.record_batch([pa.array(number + np.arange(len(at))), batch.column(0).take(pa.array(i + owner)), pa.array(np.full(len(at), m, np.int32)), pa.array(key.view(np.int64)), string, rows], ["number", "item_id", "m", "key", "string", "words"])
                        number += len(at)

    return items.mapInArrow(run, "number long, item_id long, m int, key long, string binary, words binary")


def shift_tables(patterns: DataFrame, sizes: dict[int, int]) -> list[Shifts]:
    """The tables for patterns (m, words): tasks make tables of their share, whose slices are merged."""
    bits = {m: int(np.clip(np.ceil(np.log2(n * m + 1)) + 3, 12, 24)) for m, n in sizes.items()}

    def part(batches):
        own: dict[int, Shifts] = {}
        for batch in batches:
            kinds = np.asarray(batch.column(0))
            for m in np.unique(kinds).tolist():
                rows = batch.column(1).filter(pa.array(kinds == m))
                own.setdefault(m, Shifts(m, bits[m])).add(np.frombuffer(b"".join(rows.to_pylist()), U).reshape(-1, m))
        for m, s in own.items():
            pieces = [s.shift[k : k + SLICE].tobytes() for k in range(0, len(s.shift), SLICE)]
            yield pa.record_batch([pa.array([m] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["m", "slice", "shift"])

    def least(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.column("shift"):
                own = np.frombuffer(row.as_py(), np.uint8)
                out = own if out is None else np.minimum(out, own)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["m", "slice", "shift"])

    kind = "m int, slice int, shift binary"
    merged = patterns.select("m", "words").mapInArrow(part, kind).groupBy("m", "slice").applyInArrow(least, kind)
    by: dict[int, dict[int, bytes]] = {}
    for r in merged.toLocalIterator():
        by.setdefault(r.m, {})[r.slice] = bytes(r.shift)
    return [Shifts(m, bits[m], np.frombuffer(b"".join(s[k] for k in sorted(s)), np.uint8)) for m, s in sorted(by.items())]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_windows: int = 100_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, hits (hit word ranges as array of start, end), items (array of item_id)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    all_windows = cut(windows(items, window))
    patterns = cut(all_windows.groupBy("m", "key", "string").agg(F.min("number").alias("pattern"), F.min("words").alias("words")))
    counted = patterns.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.octet_length("string") + 40).alias("bytes")).collect()  # a row for each length of window
    sizes = {r.m: r.n for r in counted}
    tables = docs.sparkSession.sparkContext.broadcast(shift_tables(patterns, sizes) if sizes else [])
    docs = docs.select("doc_id", "text")

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            offsets, buf = utf8(batch.column(1))
            for i, j in slices(offsets, CHUNK):
                w = Words(offsets[i : j + 1] - offsets[i], buf[offsets[i] : offsets[j]])
                places, lengths, keys, strings = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, U)], [pa.array([], pa.binary())]
                for t in tables.value:
                    at = t.search(w.hash, w.bounds[:-1], w.bounds[1:])
                    string, key = w.strings(at, t.m)
                    places.append(at)
                    lengths.append(np.full(len(at), t.m, np.int32))
                    keys.append(key)
                    strings.append(string)
                at = np.concatenate(places)
                order = np.argsort(at, kind="stable")
                at = at[order]
                per = np.searchsorted(at, w.bounds).astype(np.int32)
                local = at - w.bounds[np.searchsorted(w.bounds, at, side="right") - 1]
                found = pa.StructArray.from_arrays([pa.array(local), pa.array(np.concatenate(lengths)[order]), pa.array(np.concatenate(keys)[order].view(np.int64)), pa.concat_arrays(strings).take(pa.array(order))], ["at", "m", "key", "string"])
                yield pa.record_batch([pa.array(number + np.arange(j - i)), batch.column(0).slice(i, j - i), pa.array(np.diff(w.bounds)), pa.ListArray.from_arrays(pa.array(per), found)], ["row", "doc_id", "n_words", "tested"])
                number += j - i

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = cut(docs.mapInArrow(run, f"row long, doc_id {kind}, n_words long, tested array<struct<at:long,m:int,key:long,string:binary>>"))
    small = sum(sizes.values()) <= broadcast_windows and sum(r.bytes for r in counted) <= broadcast_bytes
    known = patterns.select("m", "key", "string", "pattern")
    tested = seen.select("row", F.explode("tested").alias("t")).select("row", "t.*")
    hit = cut(tested.join(F.broadcast(known) if small else known, ["m", "key", "string"]).select("row", F.col("at").alias("start"), (F.col("at") + F.col("m")).alias("end"), "pattern"))
    # runs of hit words: a new one begins where no window before it reaches
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = hit.select("row", "start", "end", F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True)).cast("int").alias("new"))
    numbered = marked.withColumn("run", F.sum("new").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    owners = all_windows.join(known, ["m", "key", "string"]).select("pattern", "item_id").distinct()
    own = hit.select("row", "pattern").distinct().join(owners, "pattern").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = [F.coalesce("hits", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")).alias("hits"), F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")).alias("items")]
    return seen.drop("tested").join(spans, "row", "left").join(own, "row", "left").select("doc_id", "n_words", *none)


def decided(found: DataFrame, num: int = 1, den: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: at least num / den of the words are hit."""
    found = found.withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, s) -> n + s.end - s.start)"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (den * F.col("n_hit") >= num * F.col("n_words")))


def op8_wu_manber(spark, sf_dir: str) -> DataFrame:
    out = decided(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


QUERIES = {"op8_wu_manber": op8_wu_manber}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op8_wu_manber": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT item_id, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM c)),
p AS (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT r, k, p.m, item_id FROM p JOIN b ON p.m = b.m AND p.s = b.s),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT r, k, m FROM h)) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
}
