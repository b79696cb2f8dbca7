"""Operator 3: token ids of a corpus in files that hold a wavelet matrix for each shard.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts and writes them as shards of whole
documents, of about `shard_tokens` ids. A shard is one row of one compressed file: the doc_ids and lengths of its
documents, and a plane of bits for each bit of an id, most significant first. A plane holds that bit of all ids in the
order that the planes above it have sorted them into (zeros before ones, otherwise stable), with the number of ones
before each block of 512 bits. That gives, from one file and without unpacking it: `access` (the id at a place), `rank`
(how often an id occurs before a place), `count`, and `select` (the place of its k-th occurrence), each in one step for
each plane. `occurrences` looks ids up in all files. Spark's writer commits the files, so a lost executor leaves none
half written.

Encoding: with a byte-level tokenizer each distinct unit (a word with the space before it, or signs after a word) of a
batch is encoded once by the library and kept in the worker process up to a fixed number; texts with white space beyond
ASCII, and all texts for other tokenizers, are encoded whole. Both give what encoding the whole text gives.

Defined results: null and empty texts have the end id alone. Repeated rows are written one after the other (ties in
doc_id by a hash of the text). A null doc_id comes first. An empty table writes no shard. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ragged, shared_dir, slices, table, utf8
from .units import Store, cut_at, gathered

BLOCK = 512
CHUNK = 8 << 20
SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"
_stores: dict[str, tuple] = {}
#: Fixed: white space beside that of ASCII.
WIDE = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK = frozenset(b"\t\n\x0b\x0c\r ")


def _pairs() -> np.ndarray:
    """Bytes that a byte-level tokenizer never joins: a sign after a letter or digit, white space after anything else, and
    what follows a line end (`_starts` takes back those cuts inside white space)."""
    out = np.zeros((256, 256), bool)
    blank = np.isin(np.arange(256), list(BLANK))
    alnum = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
    sign = np.array([32 < i < 127 for i in range(256)]) & ~alnum
    out[np.ix_(alnum, sign)] = True
    out[np.ix_(~blank, blank)] = True
    out[10, (np.arange(256) > 32) & (np.arange(256) < 128)] = True
    return out.ravel()


def _starts(buf: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    starts = cut_at(buf, offsets, pairs)
    # after a line end that ends a longer run of white space there is no cut
    inner = starts[starts > 1]
    inner = inner[(buf[inner - 1] == 10) & np.isin(buf[inner - 2], list(BLANK))]
    inner = inner[~np.isin(inner, offsets) & ~np.isin(inner - 1, offsets)]
    return starts[~np.isin(starts, inner)] if inner.size else starts


class _Tokenizer:
    """The tokenizer of this worker process, with the ids of units it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        before = parts.get("pre_tokenizer") or {}
        # only then units are encoded on their own as in their text
        self.by_units = not parts.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and parts["model"].get("type") == "BPE"
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids if self.by_units else []
        self.store, self.pairs = Store(self._units, self.kind), _pairs()

    def each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), 1000) for e in self.library.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]

    def _units(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units without other white space than a space before them go to the library together, a line end between them."""
        inner = np.flatnonzero(np.isin(buf, list(BLANK)))
        owner = np.searchsorted(at, inner, side="right") - 1
        alone = np.zeros(len(at) - 1, bool)
        alone[owner[(inner != at[owner]) | (buf[inner] != 32)]] = True
        alone |= np.diff(at) < 2
        texts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.large_string())
        number, flat = np.zeros(len(at) - 1, np.int64), []
        where = []
        together = np.flatnonzero(~alone)
        if len(self.line_end) != 1:
            together = together[:0]
        for k in range(0, len(together), 5000):
            some = together[k : k + 5000]
            ids = np.array(self.each(["\n".join(texts.take(pa.array(some)).to_pylist())])[0], self.kind)
            ends = np.append(np.flatnonzero(ids == self.line_end[0]), len(ids))
            if len(ends) != len(some):
                alone[some] = True
                continue
            number[some] = np.diff(np.concatenate([[-1], ends])) - 1
            flat.append(ids[ids != self.line_end[0]])
            where.append(some)
        rest = np.flatnonzero(alone) if len(self.line_end) == 1 else np.arange(len(at) - 1)
        if rest.size:
            found = self.each(texts.take(pa.array(rest)).to_pylist())
            number[rest] = list(map(len, found))
            flat.append(np.fromiter(itertools.chain.from_iterable(found), self.kind, int(number[rest].sum())))
            where.append(rest)
        out = np.zeros(int(number.sum()), self.kind)
        begin = np.cumsum(number) - number
        for ids, units in zip(flat, where, strict=True):
            out[ragged(begin[units], number[units])] = ids
        return out, number

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, WIDE)) if self.by_units else np.ones(len(texts), bool)
        offsets, buf = utf8(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        flat, number = gathered(self.store, buf, offsets, _starts(buf, offsets, self.pairs))
        if not odd.any():
            return flat, number
        whole = self.each(texts.take(pa.array(np.flatnonzero(odd))).to_pylist())
        begin = np.cumsum(number) - number
        number[odd] = list(map(len, whole))
        out = np.zeros(int(number.sum()), self.kind)
        to = np.cumsum(number) - number
        out[ragged(to[~odd], number[~odd])] = flat[ragged(begin[~odd], number[~odd])]
        out[ragged(to[odd], number[odd])] = np.fromiter(itertools.chain.from_iterable(whole), self.kind, int(number[odd].sum()))
        return out, number


def _tokenizer(path: str) -> _Tokenizer:
    if path not in _stores:
        _stores[path] = _Tokenizer(path)
    return _stores[path]


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.planes = n, zeros, [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        zeros, planes, ranks = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << b)) != 0
            packed = np.packbits(bit)
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            z = len(ids) - int(ones.sum())
            zeros.append(z)
            planes.append(packed.tobytes())
            ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
            sorted_ = np.empty_like(ids)
            np.compress(~bit, ids, out=sorted_[:z])
            np.compress(bit, ids, out=sorted_[z:])
            ids = sorted_
        return cls(len(ids), zeros, planes, ranks)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i <= 0:
            return 0
        block = (i - 1) // BLOCK
        part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
        bits = np.unpackbits(part, count=i - block * BLOCK)
        return int(self.ranks[level][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            b, r = self.bit(level, i), self.ones(level, i)
            value, i = value << 1 | b, (z + r if b else i - r)
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before place i."""
        if value < 0 or value >> len(self.zeros):
            return 0
        a, b = 0, i
        for level, z in enumerate(self.zeros):
            ra, rb = self.ones(level, a), self.ones(level, b)
            a, b = (z + ra, z + rb) if value >> (len(self.zeros) - 1 - level) & 1 else (a - ra, b - rb)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _place(self, level: int, one: int, k: int) -> int:
        """Where a plane has its k-th (from 0) bit of that kind: its block from the ranks, then inside the block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * BLOCK
        bits = np.unpackbits(self.planes[level][start // 8 : (start + BLOCK) // 8], count=min(BLOCK, self.n - start))
        return start + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def _range(self, value: int) -> tuple[int, int]:
        """Where occurrences of value stand below the last plane, in their order."""
        if value < 0 or value >> len(self.zeros):
            return 0, 0
        a, b = 0, self.n
        for level, z in enumerate(self.zeros):
            ra, rb = self.ones(level, a), self.ones(level, b)
            a, b = (z + ra, z + rb) if value >> (len(self.zeros) - 1 - level) & 1 else (a - ra, b - rb)
        return a, b

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0), -1 if there are no more: down the planes once, and up again."""
        a, b = self._range(value)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            i = self._place(level, one, i - self.zeros[level] * one)
        return i

    def places(self, value: int) -> np.ndarray:
        """The places of all occurrences, in order: one range of the last plane, carried up all planes together."""
        a, b = self._range(value)
        at = np.arange(a, b)
        for level in range(len(self.zeros) - 1, -1, -1):
            if not at.size:
                break
            one = value >> (len(self.zeros) - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n)
            at = np.flatnonzero(bits == one)[at - self.zeros[level] * one]
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        out = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit, z = np.unpackbits(self.planes[level], count=self.n).astype(bool), self.zeros[level]
            up = np.empty_like(out)
            up[~bit], up[bit] = out[:z], out[z:] | out.dtype.type(1 << (len(self.zeros) - 1 - level))
            out = up
        return out


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 1 << 20, partition_bytes: int = 24 << 20, most_partitions: int = 20_000) -> None:
    """docs (doc_id, text) -> files in the folder `out`. A task streams over its sorted partition and holds a shard, so
    beyond `most_partitions` (0.5 TB) partitions grow, shards don't."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def shards(batches):
        coder = _tokenizer(tokenizer)
        part, seq, held, ids, lengths, doc_ids = TaskContext.get().partitionId(), 0, 0, [], [], []

        def shard():
            w = WaveletMatrix.build(np.concatenate(ids))
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([w.n]), pa.array([np.concatenate(doc_ids).tolist()], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                pa.array([w.zeros], pa.list_(pa.int64())), pa.array([[p.tobytes() for p in w.planes]], pa.list_(pa.binary())), pa.array([[r.tobytes() for r in w.ranks]], pa.list_(pa.binary())),
            ], ["part", "seq", "n_tokens", "doc_ids", "lengths", "zeros", "planes", "ranks"])

        for batch in batches:
            for k, end in slices(utf8(batch.column(1))[0], CHUNK):
                piece = batch.slice(k, end - k)
                flat, n = coder.ids(piece.column(1))
                size = n + 1
                stop = np.cumsum(size)
                new = np.full(stop[-1], end_id, flat.dtype)
                keep = np.ones(len(new), bool)
                keep[stop - 1] = False
                new[keep] = flat
                names = np.array(piece.column(0).to_pylist(), object)
                i = 0
                while i < len(size):  # whole documents up to the shard's size
                    done = stop[i - 1] if i else 0
                    j = max(i + 1, int(np.searchsorted(stop, done + shard_tokens - held, side="right")))
                    ids.append(new[done : stop[j - 1]])
                    lengths.append(size[i:j])
                    doc_ids.append(names[i:j])
                    held += stop[j - 1] - done
                    i = j
                    if held >= shard_tokens or i < len(size):
                        yield shard()
                        seq, held, ids, lengths, doc_ids = seq + 1, 0, [], [], []
        if ids:
            yield shard()

    count = min(max(1, -(-total // partition_bytes)), most_partitions)
    # by a hash of the text too, so that rows of one doc_id (or null) don't all go to one task
    order = [F.col("doc_id").asc_nulls_first(), F.col("__h")]
    dealt = docs.withColumn("__h", F.xxhash64("text")).repartitionByRange(count, *order).sortWithinPartitions(*order, "text").drop("__h")
    dealt.mapInArrow(shards, SCHEMA).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of each document, from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ranks"]).ids().astype(np.uint32)
                size = np.array(r["lengths"], np.int64)
                stop = np.cumsum(size)
                for i in range(0, len(size), 2000):
                    j = min(i + 2000, len(size))
                    base = stop[i] - size[i]
                    data = ids[base : stop[j - 1]].astype("<u4")
                    at = (np.concatenate([[base], stop[i:j]]) - base).astype(np.int32) * 4
                    binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
                    k = j - i
                    yield pa.record_batch([pa.array([r["part"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array(r["doc_ids"][i:j], pa.int64()), pa.array((stop - size)[i:j]), pa.array(size[i:j]), binary], ["part", "seq", "doc_id", "local", "n_tokens", "ids"])

    docs = files.mapInArrow(rows, "part int, seq int, doc_id long, local long, n_tokens long, ids binary")
    size = files.select("part", "seq", F.col("n_tokens").alias("n"))
    # the window without partitions has one row for each task that wrote, the other one the shards of a task
    parts = size.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    shards = size.select("part", "seq", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("within"))
    starts = shards.join(parts, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def occurrences(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Where the ids occur, looked up in the wavelet matrices of the files: doc_id, start (of the document in its shard),
    part, seq, id, n and places (in the document, in order); a row for each document and id that it has."""
    wanted = sorted(set(ids))

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                matrix = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ranks"])
                stop = np.cumsum(np.array(r["lengths"], np.int64))
                for value in wanted:
                    places = matrix.places(value)
                    if not places.size:
                        continue
                    doc, first, n = np.unique(np.searchsorted(stop, places, side="right"), return_index=True, return_counts=True)
                    start = stop[doc] - np.array(r["lengths"], np.int64)[doc]
                    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(places)).astype(np.int32)), pa.array(places - np.repeat(start, n)))
                    k = len(doc)
                    yield pa.record_batch([pa.array([r["doc_ids"][d] for d in doc], pa.int64()), pa.array(start), pa.array([r["part"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array([value] * k, pa.int64()), pa.array(n.astype(np.int64)), at], ["doc_id", "start", "part", "seq", "id", "n", "places"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(rows, "doc_id long, start long, part int, seq int, id long, n long, places array<long>")


def op3_wavelet_tokens(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path(vocabulary))
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_wavelet_tokens": op3_wavelet_tokens}
SQL: dict[str, str] = {}
