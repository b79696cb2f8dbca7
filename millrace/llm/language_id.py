"""Operator 5: language identification, words first.

A word that the model knows scores by its log frequency in each language. An unseen word falls back to its character
n-grams of the longest length of which the model knows one, from `longest` characters down to one; the mean of their log
frequencies is scaled by `backoff` for each length given up. The document's language has the largest sum; `score` is
its posterior probability with equal priors.

The model learns from text and lang of at most about `sample_docs` labelled documents (all of them where there are no
more), chosen by a hash of doc_id: Spark counts words and n-grams by language, and those that occur `least` times in
them come to the driver and go to the tasks, as many as that sample holds: 8 bytes and a number for each language.

A word is a run of letters of the lower-cased text.

Defined results: null text or text without letters gives lang_pred `und` and score 0. With no labelled rows every
document is `und`. Of languages that score alike the first by name is predicted, with its share as score. A text none
of whose words or characters are known scores alike in all. Repeated rows get equal results. Rows without lang aren't learned from. Columns that are
kept may have any names but lang_pred and score, which are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, U, cut, fresh, mix, ragged, table

CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and start, end and document of each word."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[points]
    edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(t) + 1 for t in low])
    return points, starts, ends, np.searchsorted(bounds, starts, side="right")


def _hash(points: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points, one place for all spans at a time."""
    out = length.astype(U) * M1
    live = np.arange(len(at))
    j = 0
    while live.size:
        out[live] = mix((out[live] ^ points[at[live] + j]) + M2)
        j += 1
        live = live[length[live] > j]
    return out


def _grams(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and start of each run of n characters inside a word."""
    count = np.maximum(ends - starts - n + 1, 0)
    return np.repeat(np.arange(len(starts)), count), ragged(starts, count)


class Model:
    def __init__(self, langs: list[str], keys: list[np.ndarray], logs: list[np.ndarray], backoff: float):
        """keys, logs: sorted hashes and their log frequencies by language; first of words, then of n-grams of 1, 2, ... characters."""
        self.langs, self.keys, self.logs, self.backoff = langs, keys, logs, backoff

    def _find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return i, keys[i] == h

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log frequencies for each text and language, and which texts have letters."""
        points, starts, ends, doc = _words(texts)
        total = np.zeros((len(texts), len(self.langs)))
        has = np.bincount(doc, minlength=len(texts)) > 0
        if not len(starts) or not self.langs:
            return total, has
        # each distinct word is looked up once
        h, first, which = np.unique(_hash(points, starts, ends - starts), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        logs = np.zeros((len(h), len(self.langs)))
        i, known = self._find(0, h)
        logs[known] = self.logs[0][i[known]]
        open_, factor = np.flatnonzero(~known), 1.0
        for n in range(len(self.keys) - 1, 0, -1):
            if not open_.size:
                break
            factor *= self.backoff
            word, at = _grams(s[open_], e[open_], n)
            if not word.size:
                continue
            i, known = self._find(n, _hash(points, at, np.full(len(at), n)))
            word, i = word[known], i[known]
            number = np.bincount(word, minlength=len(open_))
            for k in range(len(self.langs)):
                logs[open_, k] = np.bincount(word, self.logs[n][i, k], minlength=len(open_)) / np.maximum(number, 1) * factor
            open_ = open_[number == 0]
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(doc, logs[which, k], minlength=len(texts))
        return total, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, has = self.scores(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def train(docs: DataFrame, sample_docs: int = 8000, least: int = 2, longest: int = 5, backoff: float = 0.4) -> Model:
    """Learns from docs (doc_id, text, lang): about `sample_docs` rows in all, as many of each language, and 50 of each at least."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # a short list: the languages
    wanted = max(50, sample_docs / max(1, len(sizes)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 2.0 if n <= wanted else wanted / n)]) if sizes else F.create_map().cast("map<string,double>")
    docs = docs.filter((F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5) < F.element_at(share, F.col("lang")))

    def count(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lang = np.array(part.column(1).to_pylist(), object)
                points, starts, ends, doc = _words(part.column(0).to_pylist())
                for name in set(lang):
                    mine = np.flatnonzero(lang[doc] == name)
                    s, e = starts[mine], ends[mine]
                    for kind in range(longest + 1):
                        if kind:
                            _, at = _grams(s, e, kind)
                            h = _hash(points, at, np.full(len(at), kind))
                        else:
                            h = _hash(points, s, e - s)
                        key, number = np.unique(h, return_counts=True)
                        yield pa.record_batch([pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(number, pa.int64())], ["lang", "kind", "key", "n"])

    counts = docs.select("text", "lang").mapInArrow(count, "lang string, kind int, key long, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))  # a short list: the languages
    rows = counts.groupBy("kind", "key").agg(F.sum("n").alias("total"), by.alias("by")).filter(F.col("total") >= least)
    got = rows.select("kind", "key", *(F.coalesce(F.element_at("by", F.lit(x)), F.lit(0)).cast("double").alias(f"n{k}") for k, x in enumerate(langs))).toArrow()
    kinds, hashes = (got.column(c).to_numpy() for c in ("kind", "key"))
    number = np.stack([got.column(f"n{k}").to_numpy() for k in range(len(langs))], axis=1) if langs else np.zeros((len(kinds), 0))
    keys, logs = [], []
    for kind in range(longest + 1):
        mine = np.flatnonzero(kinds == kind)
        own = hashes[mine].view(U)
        order = np.argsort(own)
        keys.append(own[order])
        seen = number[mine[order]] + 0.5
        logs.append(np.log(seen / np.maximum(seen.sum(axis=0), 1)) if len(mine) else seen)
    return Model(langs, keys, logs, backoff)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (text, ...) -> the columns `keep` with lang_pred and score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text = batch.column(len(keep))
            for k in range(0, batch.num_rows, 500):
                lang, score = sent.value.predict(text.slice(k, 500).to_pylist())
                part = batch.slice(k, 500)
                yield pa.record_batch([*(part.column(c) for c in range(len(keep))), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    source = docs.select(*keep, F.col("text").alias(fresh("text", keep)))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
