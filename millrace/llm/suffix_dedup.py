"""Operator 1: removal of byte strings that repeat across documents, by a sampled suffix array.

Every `width`-byte string has one anchor inside it: the start of its k bytes with the smallest hash. The anchors are the
suffixes that are sorted (about one byte in fourteen), and two equal strings have equal anchors at equal places, so
nothing is lost by leaving the other suffixes out. All strings with the same anchor form a cell.

1. Documents are dealt into blocks by a hash of doc_id and text; a block lists its anchors once each: leading tokens (24 bytes:
   the first eight as they are, a hash of the rest), a hash of the whole cell, and the smallest doc_id.
2. Sampled splitters range-partition these by leading tokens. A bucket sorts its share by multikey quicksort and compares
   neighbours; splitters are keys, so equal keys never lie on both sides of a boundary. Blocks hear which of their
   anchors occur elsewhere, with the smallest doc_id, and if all cells there are equal.
3. Where all cells are equal, the cell is a copy or the original. Where they differ, one suffix text for each different
   cell of a block goes to the bucket; for anchors that very many blocks have (a common line before different texts)
   four neighbouring strings go together, dealt by a hash of what they share, so that no bucket grows with one line.
4. Buckets sort all `width`-byte strings of these texts by multikey quicksort, seven words deep, and compare neighbours
   byte for byte.
5. Each block takes the union of what was found.

Equality of whole cells is decided by 128 bits of leading tokens and hash, everything else by the bytes themselves.
Memory of a task: a block (`block_bytes`), or a bucket, of which there are as many as blocks, so that both stay as large
whatever the corpus; an anchor that is in every block has a row of some 20 bytes for each of them in its bucket. The
driver gets the sampled leading tokens for the splitters, PER_BUCKET for each bucket and about MOST_KEYS in all (from
some 4 TB of text on, buckets grow), nothing else; the splitters are broadcast. A block writes a message to each bucket
that it has anchors for, never more than it has anchors.

Defined results: null and empty text have zero bytes and no spans. A repeated row (same doc_id) is no earlier document,
so it removes nothing from its twin. A null doc_id counts as the largest; a doc_id of 2^63 - 1 is taken for
null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, M3, U, mix, multikey_order, ragged, runs, span_hashes, table, utf8

K = 24
STEP = 1 << 17
BASE = U(0x2545F4914F6CDD1D)
BYTE = mix(np.arange(1, 257, dtype=U) * M1)
LAST = (1 << 63) - 1
#: Sampled keys for each bucket, and at most (12 bytes each).
PER_BUCKET, MOST_KEYS = 16, 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The big-endian word of the eight bytes from each place."""
    x = buf.astype(U)
    x = (x[:-1] << U(8)) | x[1:]
    x = (x[:-2] << U(16)) | x[2:]
    return (x[:-4] << U(32)) | x[4:]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def cells(buf: np.ndarray, offsets: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """All cells of the documents: first and last string start, document, leading tokens, hash of the bytes and of the anchor's place."""
    n, out = len(buf), []
    long = np.diff(offsets) >= width
    change = np.zeros(n + 1, np.int8)
    change[offsets[:-1][long]] += 1
    change[offsets[1:][long] - width + 1] -= 1
    valid = np.cumsum(change[:n], dtype=np.int8).astype(bool)
    up, down = _powers(STEP + width)
    mask = U((1 << 20) - 1)
    for p in range(0, n - width + 1, STEP):
        part = buf[p : p + STEP + width - 1]
        starts = len(part) - width + 1
        ok = valid[p : p + starts]
        if not ok.any():
            continue
        w = _eights(part)
        tail = w[8 : len(w) - K + 16]
        for j in range(16, K, 8):
            tail = mix(tail * M1) ^ w[j : len(w) - K + 8 + j]
        h = mix(w[: len(tail)] * M1 ^ mix(tail * M2))
        at = (_sliding_min((h & ~mask) | np.arange(len(h), dtype=U), width - K + 1) & mask).astype(np.int64)
        fresh = np.ones(starts, bool)
        fresh[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        ends = np.ones(starts, bool)
        ends[:-1] = fresh[1:] | ~ok[1:]
        a, b = np.flatnonzero(ok & fresh), np.flatnonzero(ok & ends)
        anchor = at[a]
        total = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[part] * up[: len(part)], dtype=U)])
        cell = mix((total[b + width] - total[a]) * down[a] ^ ((b - a).astype(U) * M2 + (anchor - a).astype(U) * M3)) >> U(24)
        out.append((a + p, b + p, w[anchor], mix(tail[anchor] * M3) >> U(40), np.maximum(cell, U(1)), anchor + p))
    names = ("first", "last", "lead", "rest", "cell", "anchor")
    got = {k: np.concatenate([x[i] for x in out]) if out else np.zeros(0, U if 1 < i < 5 else np.int64) for i, k in enumerate(names)}
    got["doc"] = np.searchsorted(offsets, got["first"], side="right") - 1
    return got


def _keys(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.empty((len(lead), 12), np.uint8)
    out[:, :8] = lead.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = rest.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.view("S12").ravel()


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """The low n bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).view(f"V{n}").ravel()


def _whole(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.itemsize] = x.view(np.uint8).reshape(len(x), x.itemsize)
    return out.view("<u8").ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each as bytes: byte planes, then compressed."""
    parts = [len(a).to_bytes(8, "little") + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in map(np.dtype, kinds):
        n = int.from_bytes(raw[at : at + 8], "little")
        at += 8
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


class _Block:
    """A block's documents in a fixed order, with their cells grouped by leading tokens."""

    def __init__(self, docs: pa.Table, width: int, listed: bool = True):
        ids = docs.column("doc_id").to_numpy().astype(np.int64)
        text = docs.column("text").combine_chunks()
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py() or "")))
        self.ids = ids[order]
        self.offsets, self.buf = utf8(text.take(pa.array(order)))
        if not listed:
            return
        self.c = c = cells(self.buf, self.offsets, width)
        self.order, new = multikey_order([c["lead"], c["rest"]])
        self.group = np.cumsum(new) - 1  # of the sorted cells
        self.at = at = np.flatnonzero(new)
        self.doc_id = self.ids[c["doc"][self.order]]
        cell = c["cell"][self.order]
        self.lead, self.rest = c["lead"][self.order][at], c["rest"][self.order][at]
        if len(at):
            self.least = np.minimum.reduceat(self.doc_id, at)
            one = np.minimum.reduceat(cell, at)
            self.mixed = one != np.maximum.reduceat(cell, at)
            self.one = np.where(self.mixed, U(0), one)
        else:
            self.least, self.mixed, self.one = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, U)

    def cuts(self, splitters: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(_keys(self.lead, self.rest), splitters), [len(self.lead)]])


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def suffix_dedup(docs: DataFrame, width: int = 50, block_bytes: int = 4 << 20, wide_blocks: int = 48) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, spans (removed byte ranges as array of start, end), kept (binary: the remaining bytes).
    An anchor with different cells in more than `wide_blocks` blocks is compared in groups of four strings."""
    if not K <= width <= 56:
        raise ValueError("width must be from 24 to 56")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    count = max(1, -(-total // block_bytes))
    # by the text too, so that no doc_id (or null) makes a block of its own size
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("long"))

    # sampled for splitters: some PER_BUCKET anchors for each bucket, of one document in `rare`, until MOST_KEYS are reached
    wanted = min(PER_BUCKET * count, MOST_KEYS)
    anchors = max(total // 14, 1)
    share = min(1.0, max(64 * wanted / anchors, min(1.0, 2000 / max(n, 1))))
    rate = U(int(min(1.0, wanted / (anchors * share)) * float(1 << 63)) * 2 + 1) if anchors * share > wanted else U(0xFFFFFFFFFFFFFFFF)

    def sample(batches):
        for batch in batches:
            offsets, buf = utf8(batch.column(0))
            c = cells(buf, offsets, width)
            some = np.flatnonzero(mix(c["lead"] * M1 + c["rest"]) <= rate)
            yield pa.record_batch([pa.array(_keys(c["lead"][some], c["rest"][some]).tolist(), pa.binary())], ["key"])

    some = docs.filter((F.xxhash64("doc_id", "text", F.lit("splitters")) / F.lit(2.0**64) + 0.5) < F.lit(share + (share == 1.0))).select("text")
    keys = np.sort(np.array([r.key for r in some.mapInArrow(sample, "key binary").distinct().collect()], "S12"))
    splitters = np.unique(keys[np.linspace(0, len(keys) - 1, count + 1)[1:-1].astype(int)]) if len(keys) else keys
    buckets = len(splitters) + 1
    sent = docs.sparkSession.sparkContext.broadcast(splitters)

    def listing(key, docs):
        b = _Block(docs, width)
        cut = b.cuts(sent.value)
        rows = [(i, x, y) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        data = [pack(b.lead[x:y], _low(b.rest[x:y], 3), _low(b.one[x:y], 5), b.least[x:y]) for _, x, y in rows]
        return pa.table({"bucket": pa.array([i for i, *_ in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "data": _binary(data)})

    def shared(key, rows):
        got = [unpack(x.as_py(), "<u8", "V3", "V5", "<i8") for x in rows.column("data")]
        row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        place = np.concatenate([np.arange(len(g[0])) for g in got])
        order, new = multikey_order([np.concatenate([g[0] for g in got]), _whole(np.concatenate([g[1] for g in got]))])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(order)))
        cell = _whole(np.concatenate([g[2] for g in got]))[order]
        least = np.minimum.reduceat(np.concatenate([g[3] for g in got])[order], at)
        low, high = np.minimum.reduceat(cell, at), np.maximum.reduceat(cell, at)
        state = np.where((low != high) | (low == 0), np.where(size > wide_blocks, 2, 1), 0).astype(np.uint8)
        group = np.cumsum(new) - 1
        told = np.flatnonzero(size[group] > 1)
        told = told[np.argsort(row[order[told]], kind="stable")]
        ends = np.searchsorted(row[order[told]], np.arange(len(got) + 1))
        data, blocks = [], []
        for r, block in enumerate(rows.column("block").to_pylist()):
            mine = told[ends[r] : ends[r + 1]]
            if len(mine):
                data.append(pack(place[order[mine]].astype("<u4"), least[group[mine]], state[group[mine]]))
                blocks.append(block)
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "data": _binary(data)})

    def texts(key, docs, replies):
        """Kind 0: suffix texts for a bucket. Kind 1: ranges that are known to be copies, which pass any bucket."""
        block = key[0].as_py()
        none = {"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "kind": pa.array([], pa.int64()), "data": _binary([])}
        if not docs.num_rows:
            return pa.table(none)
        b = _Block(docs, width)
        cut, c = b.cuts(sent.value), b.c
        least, state = b.least.copy(), b.mixed.astype(np.uint8)
        for bucket, data in zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True):
            place, low, kind = unpack(data, "<u4", "<i8", "u1")
            i = cut[bucket] + place.astype(np.int64)
            least[i], state[i] = np.minimum(least[i], low), np.maximum(state[i], kind)
        kind, doc_id = state[b.group], b.doc_id
        first, last, doc = (c[k][b.order] for k in ("first", "last", "doc"))
        copy = (kind == 0) & (doc_id > least[b.group])
        open_ = np.flatnonzero(kind > 0)
        if len(open_):  # of equal cells only those of the smallest document stay open
            order, new = multikey_order([b.group[open_].astype(U), c["cell"][b.order[open_]]])
            at = np.flatnonzero(new)
            low = np.repeat(np.minimum.reduceat(doc_id[open_][order], at), np.diff(np.append(at, len(order))))
            later = doc_id[open_][order] > low
            copy[open_[order[later]]] = True
            open_ = np.sort(open_[order[~later]])
        wide = open_[kind[open_] == 2]
        near = open_[kind[open_] == 1]
        found = [np.flatnonzero(copy)]
        spans = [(doc[found[0]], first[found[0]], last[found[0]] + width)]
        rows = []
        bucket_of = np.searchsorted(cut[1:], b.group[near], side="right")
        for bucket in np.unique(bucket_of):
            i = near[bucket_of == bucket]
            rows.append((int(bucket), 0, self_texts(b, doc[i], first[i], last[i] + width)))
        if len(wide):
            # strings of four neighbouring places share all but three bytes at either end: the middle says which bucket
            lengths = last[wide] - first[wide] + 1
            start, d, at = ragged(first[wide], lengths), np.repeat(doc[wide], lengths), np.repeat(c["anchor"][b.order[wide]], lengths)
            four = (at - start) >> 2
            fresh = np.ones(len(start), bool)
            fresh[1:] = (four[1:] != four[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1])
            i = np.flatnonzero(fresh)
            start, end, d = start[i], start[np.append(i[1:], len(start)) - 1] + width, d[i]
            middle = at[i] - 4 * four[i]
            h = np.zeros(len(i), U)
            for x in (*range(0, width - 10, 8), width - 11):
                h = mix((h ^ _gather(b.buf, middle + x)) + M1)
            order, new = multikey_order([h, span_hashes(b.buf, start, end), (middle - start).astype(U)])
            head = np.flatnonzero(new)
            low = np.repeat(np.minimum.reduceat(b.ids[d][order], head), np.diff(np.append(head, len(order))))
            later = b.ids[d][order] > low
            spans.append((d[order[later]], start[order[later]], end[order[later]]))
            keep = np.sort(order[~later])
            to = (h[keep] % U(buckets)).astype(np.int64)
            for bucket in np.unique(to):
                i = keep[to == bucket]
                rows.append((int(bucket), 0, self_texts(b, d[i], start[i], end[i])))
        d, x, y = (np.concatenate(z) for z in zip(*spans, strict=True))
        if len(d):
            base = b.offsets[d]
            rows.append((block % buckets, 1, pack(d.astype("<u4"), (x - base).astype("<i8"), (y - base).astype("<i8"))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int64()), "data": _binary([r[2] for r in rows])})

    def self_texts(b: _Block, doc, start, end) -> bytes:
        return pack(doc.astype("<u4"), b.ids[doc], (start - b.offsets[doc]).astype("<i8"), (end - start).astype("<i8"), b.buf[ragged(start, end - start)])

    def compared(key, rows):
        kinds, blocks, data = (rows.column(k).to_pylist() for k in ("kind", "block", "data"))
        out = [(blk, x) for kind, blk, x in zip(kinds, blocks, data, strict=True) if kind == 1]
        own = [(blk, unpack(x, "<u4", "<i8", "<i8", "<i8", "u1")) for kind, blk, x in zip(kinds, blocks, data, strict=True) if kind == 0]
        if own:
            doc, doc_id, start, length, buf = (np.concatenate([g[i] for _, g in own]) for i in range(5))
            row = np.repeat(np.arange(len(own)), [len(g[0]) for _, g in own])
            base = np.cumsum(length) - length
            strings = length - width + 1
            at, text = ragged(base, strings), np.repeat(np.arange(len(doc)), strings)
            order, new = multikey_order([_gather(buf, at), *((lambda i, x=x: _gather(buf, at[i] + x)) for x in (*range(8, width - 7, 8), width - 8))])
            head = np.flatnonzero(new)
            ids = doc_id[text[order]]
            low = np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, len(order))))
            copy = np.sort(order[ids > low])
            if len(copy):
                fresh = np.ones(len(copy), bool)
                fresh[1:] = (copy[1:] != copy[:-1] + 1) | (text[copy[1:]] != text[copy[:-1]])
                i = np.flatnonzero(fresh)
                j = np.append(i[1:], len(copy)) - 1
                t, x, y = text[copy[i]], at[copy[i]], at[copy[j]] + width
                x, y = x - base[t] + start[t], y - base[t] + start[t]
                for r in np.unique(row[t]):
                    k = row[t] == r
                    out.append((own[r][0], pack(doc[t[k]], x[k], y[k])))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "data": _binary([o[1] for o in out])})

    def removed(key, docs, found):
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], spans_type), "kept": _binary([])})
        b = _Block(docs, width, listed=False)
        n = len(b.buf)
        change = np.zeros(n + 1, np.int64)
        for data in found.column("data").to_pylist():
            d, x, y = unpack(data, "<u4", "<i8", "<i8")
            np.add.at(change, b.offsets[d] + x, 1)
            np.add.at(change, b.offsets[d] + y, -1)
        gone = np.cumsum(change[:n]) > 0
        x, y = runs(gone, b.offsets)
        doc = np.searchsorted(b.offsets, x, side="right") - 1
        per = np.searchsorted(doc, np.arange(len(b.ids) + 1)).astype(np.int32)
        base = b.offsets[doc]
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(x - base, pa.int64()), pa.array(y - base, pa.int64())], ["start", "end"]))
        left = np.concatenate([[0], np.cumsum(~gone)])[b.offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(b.ids), [None, pa.py_buffer(left.tobytes()), pa.py_buffer(b.buf[~gone].tobytes())])
        return pa.table({"doc_id": pa.array(b.ids), "n_bytes": pa.array(np.diff(b.offsets)), "spans": spans, "kept": kept})

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    listed = docs.groupBy("block").applyInArrow(listing, "bucket long, block long, data binary")
    replies = listed.groupBy("bucket").applyInArrow(shared, "block long, bucket long, data binary")
    sent = docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(texts, "bucket long, block long, kind long, data binary")
    found = sent.groupBy("bucket").applyInArrow(compared, "block long, data binary")
    out = docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(removed, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def _gather(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.lib.stride_tricks.as_strided(buf, (max(len(buf) - 7, 0), 8), (1, 1))
    return rows[at].view(">u8").ravel().astype(U)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
#: Bytes as pairs of hex digits, in stretches of 500 places so that no substring is far from its text's start.
SQL = {
    "op1_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT r, doc_id, q, substr(x, 2 * q + 1, 1098) AS y, least(500, n - 49 - q) AS m FROM (SELECT *, unnest(range(0, greatest(n - 49, 0), 500)) AS q FROM d)),
t AS (SELECT r, doc_id, q + p AS pos, unhex(substr(y, 2 * p + 1, 100)) AS s FROM (SELECT *, unnest(range(0, m)) AS p FROM q)),
f AS (SELECT s, min(doc_id) AS least FROM t GROUP BY 1),
g AS (SELECT r, pos, pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) AS gap FROM t JOIN f USING (s) WHERE doc_id > least),
k AS (SELECT r, pos, gap, count(*) FILTER (gap IS NULL OR gap > 50) OVER (PARTITION BY r ORDER BY pos) AS run FROM g),
u AS (SELECT r, run, min(pos) AS a, max(pos) + 50 AS b FROM k GROUP BY 1, 2),
c AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS last FROM u),
z AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept, max(b) AS tail FROM c JOIN d USING (r) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""
}
