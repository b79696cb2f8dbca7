"""Every stage of the pipeline against a plain version of it, on odd rows and clashing columns too."""

import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id
from millrace.llm.common import cut, table

SF = "/root/testdata/sf0.001"
LINE = "All rights reserved by the owners of this site."


@pytest.fixture(scope="module")
def documents(spark):
    base = table(spark, SF, "documents")
    first = [r.text for r in base.filter("doc_id < 6 AND text IS NOT NULL").orderBy("doc_id").collect()]
    odd = [(None, first[0], "en", "s1"), (None, "Nul id: " + first[1], "en", None), (7, first[2], None, "s2"), (7, first[2], None, "s2"), (7, first[3] + " other end", "en", "s3"), (9001, None, "en", "s1"), (9002, "", None, "s1"), (9003, " \n\t", None, "s1"), (9004, "12 34", "en", "s1")]
    odd += [(9100 + i, f"{LINE}\n{first[4][:300 + i]} number {i}\n  {LINE}", "en", f"site{i % 14}") for i in range(28)] + [(9200 + i, LINE, "en", f"site{i}") for i in range(14)]
    bench = [r.text for r in table(spark, SF, "benchmark").limit(3).collect()]
    odd += [(9300 + i, f"{t} {t}", "en", "s1") for i, t in enumerate(bench)] + [(9300, f"{bench[0]} and clean words of its own", "en", "s1"), (None, bench[1], "en", "s1")]
    extra = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in odd], "doc_id long, text string, lang string, source string, n_chars long")
    rows = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(extra)
    clashing = {c: F.lit(k) for k, c in enumerate(["score", "kept", "lang_pred", "n_removed", "n_lines", "row", "rest", "ids", "decoded", "__text", "hits", "m"])}
    return cut(rows.withColumns(clashing))


def plain(rows):
    return sorted(map(repr, rows))


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def stages(spark, documents):
    out = [documents]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return [(df.columns, df.collect()) for df in out]


def test_columns(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    assert [len(rows) for _, rows in stages] == sorted((len(rows) for _, rows in stages), reverse=True) and len(stages[-1][1]) == len(stages[-2][1]) > 100


def test_language(documents, stages):
    model = language_id.train(documents.select("doc_id", "text", "lang"))
    rows = stages[0][1]
    lang, score = model.predict([r.text for r in rows])
    assert plain(stages[1][1]) == plain(r for r, x, s in zip(rows, lang, score, strict=True) if x != "und" and s >= 0.5)


def test_lines(stages):
    rows, want = stages[1][1], []
    sites, first = defaultdict(set), {}
    place = lambda r, p: (1 << 63 if r.doc_id is None else r.doc_id, p)
    for r in rows:
        for p, x in enumerate(r.text.split("\n")):
            if x := x.strip(" "):
                sites[x].add(r.source)
                first[x] = min(first.get(x, (1 << 64, 0)), place(r, p))
    for r in rows:
        keep = [x for p, x in enumerate(r.text.split("\n")) if not (x.strip(" ") and len(sites[x.strip(" ")]) >= 10 and place(r, p) > first[x.strip(" ")])]
        if len(keep) == r.text.count("\n") + 1:
            want.append(r)
        elif "".join(keep).strip(" "):
            want.append(type(r)(**(r.asDict() | {"text": "\n".join(keep), "n_chars": len("\n".join(keep))})))
    assert plain(stages[2][1]) == plain(want) and len(want) < len(rows)


def test_near_copies(stages):
    rows = sorted(stages[2][1], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(r.text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    # rows of one doc_id may come in any order; what stays is as many documents, of the smallest doc_id of each group
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    got = plain(stages[3][1])
    assert len(got) == len(groups)
    allowed = [{repr(rows[i]) for i in g if rows[i].doc_id == rows[g[0]].doc_id} for g in groups.values()]
    assert all(sum(x in a for a in allowed) >= 1 for x in got) and all(any(x in a for x in got) for a in allowed)


def test_benchmark(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(len(w) - min(13, len(w)) + 1 if w else 0)}
    want = []
    for r in stages[3][1]:
        w, hit = words(r.text), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
        if not hit or 20 * len(hit) < len(w):
            want.append(r)
    assert plain(stages[4][1]) == plain(want) and len(want) < len(stages[3][1])


def test_pieces(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert plain((r.doc_id, r.lang, r.source, r.n_ids, list(r.ids), r.round_trip) for r in stages[5][1]) == plain((r.doc_id, r.lang, r.source, len(ids), ids, True) for r, ids in zip(stages[4][1], sp.encode([r.text for r in stages[4][1]]), strict=True))


def test_empty_table(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() == 0
