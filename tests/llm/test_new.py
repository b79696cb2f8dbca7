"""Operators 11 to 13 against plain versions, and edge rows in every table."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import chat_format, divergence, vector_codes


# ---- 11
def plain_codes(rows, entries, rounds=4, parts=4):
    kept = [(i is None, i or 0, [math.floor(1024 * x) for x in v], lab, i) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[:3])
    w = len(kept[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for t in range(rounds + 1):
        best = [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if t == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, b in zip(cut, best, strict=True) if b[p][1] == k]
                if own:
                    books[p][k] = [math.floor(Fraction(sum(col), len(own))) for col in zip(*own, strict=True)]
    flat = [x for b in books for e in b for x in e]
    error = [sum(d for d, _ in b) for b in best]
    by_label = Counter()
    for r, e in zip(kept, error, strict=True):
        by_label[r[3]] += e
    sha = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    return sorted((str(r[4]), "".join(f"{k:02x}" for _, k in b), e, by_label[r[3]], sha) for r, b, e in zip(kept, best, error, strict=True)), books


@pytest.mark.parametrize("entries", [3, 16])
def test_vector_codes(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.26, rng.gauss(0, 0.1)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(7, rows[7][1], 1), (200, None, 1), (201, [], 1), (202, [0.1, None] * 4, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] * 8, 1), (None, [0.5] * 8, None), (None, [0.5] * 8, 2)]
    expected, books = plain_codes(rows, entries)
    odd = [(300, [0.5] * 4, 1), (301, [0.5] * 7, 1), (302, [3e30] * 8, 1)]  # another length, one that the parts don't divide, too large
    df = spark.createDataFrame([(*r, 9) for r in rows + odd], "vec_id long, embedding array<float>, label int, code int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    expected, books = plain_codes(rows32, entries)
    done = vector_codes.compress(df.repartition(3), entries=entries)
    out = vector_codes.with_label_error(done.rows).selectExpr("id", "lower(hex(code))", "error", "label_error").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], done.sha256) for r in out) == expected
    assert done.books.tolist() == books
    back = vector_codes.decode(done.rows, done.codebooks).select("vector", "decoded", "far").collect()
    for r in back:  # half a step is added when codes are read
        assert sum((x - (y * 1024 - 0.5)) ** 2 for x, y in zip(r.vector, r.decoded, strict=True)) == pytest.approx(sum(r.far), abs=1e-6)


def test_vector_codes_joined_labels(spark):
    df = spark.createDataFrame([(i, [i / 7.0, 1.0, -1.0, 0.0], None if i % 3 else 5) for i in range(30)], "vec_id long, embedding array<double>, label int")
    done = vector_codes.compress(df, entries=4)
    a, b = (vector_codes.with_label_error(done.rows, broadcast_labels=n).select("id", "error", "label_error") for n in (10, 0))
    assert sorted(a.collect()) == sorted(b.collect())


def test_active_entries_do_less(spark):
    """Parts of entries that stayed are compared with the moved ones only, and nothing changes by it, ties included."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (4000, 3))  # small integers: many ties
    book = rng.integers(-3, 4, (40, 3))
    code, far, all_work = vector_codes.assign(x, book, np.ones(40, bool), None, None)
    for _ in range(6):
        after = book.copy()
        which = rng.choice(40, 5, replace=False)
        after[which] = rng.integers(-3, 4, (5, 3))
        moved = (after != book).any(axis=1)
        code, far, work = vector_codes.assign(x, after, moved, code, far)
        d = ((x[:, None] - after[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        assert work < all_work / 2
        book = after


def test_distances_of_large_numbers():
    x = np.array([[1 << 27, -(1 << 27)], [5, 7]])
    book = np.array([[(1 << 27) - 1, 3], [-(1 << 27), 1 << 27]])
    assert vector_codes.distances(x, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x]


def test_vector_codes_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    done = vector_codes.compress(df)
    assert vector_codes.with_label_error(done.rows).count() == 0 and done.codebooks.count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=257)


# ---- 12
def plain_divergence(rows, min_docs, top):
    words = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = words.findall(fold(text or ""))
        for w in found:
            n[lang, source, w] += 1
        for w in set(found):
            docs[lang, w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), d in docs.items() if g == lang and d >= min_docs]
        share = lambda count: {w: 1 + 10**9 * (count(w) + 2) // (sum(map(count, kept)) + 2 * len(kept)) for w in kept}
        q = share(lambda w: sum(n[lang, s, w] for s in sources))
        p = {s: share(lambda w, s=s: n[lang, s, w]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items[:most])]
    return sorted(out)


def _texts():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("wort", "Ähre", "IDÉE", "mot") for b in "abcdefghijk"] + ["Große", "naïve", "日本"]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "de", None, "x"])
        text = " ".join(rng.choice(vocabulary[: 10 + 8 * (i % 5)]) + rng.choice(["", ",", "_", "9"]) for _ in range(rng.randrange(40)))
        rows.append((text, lang, f"s{rng.randrange(7)}" if rng.random() < 0.9 else None))
    return rows + [(None, "en", "silent"), ("", "en", "s1"), ("  \n\x00", None, None), ("once", "lonely", "a"), ("twice", "lonely", "b"), *[("wortA wortA again", "en", "s0")] * 30]


@pytest.mark.parametrize("tile,shard,sent", [(128, 200_000, 1000), (2, 7, 0), (3, 50, 1000)])
def test_divergence(spark, tile, shard, sent):
    rows = _texts()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = divergence.divergence(df, min_docs=4, top=5, tile=tile, shard_rows=shard, broadcast_groups=sent).collect()
    assert sorted(map(tuple, got)) == plain_divergence(rows, 4, 5)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(empty).count() == 0


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BYTES", 400)
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = [("one Two, two " * 500, "en", "a"), ("x" * 5000, "en", "b"), (None, None, "b"), *[(f"w{i % 7} two", "en", "a") for i in range(50)]]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["text", "lang", "source"])
    n, docs = Counter(), Counter()
    for b in divergence._partial([batch, batch.slice(0, 3)]):
        for r in b.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    assert n["en", "a", "two"] == 2 * 1000 + 50 and docs["en", "a", "two"] == 52 and n["en", "a", "one"] == 1000
    assert docs["en", "b", "x" * 5000] == 2 and docs["", "b", None] == 2 and docs["en", "a", None] == 52


def test_share_of_more_than_a_long(spark):
    from pyspark.sql import functions as F

    big = [(10**13, 3 * 10**14, 10**9), (0, 5, 3), (0, 0, 0)]
    got = spark.createDataFrame(big, "c long, n long, v long").select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + (10**9 * (c + 2) // (n + 2 * v) if v else 0) for c, n, v in big]


# ---- 13
TEXTS = ["", "a", "\\", "\\\\", "<", "</", "</s>", "[INST] ok [/INST]", "<\\/s>", "<<s>>", "[[INST]", "tail [INST", "x\\<", "line\nend", "ß日本", "</s" * 9, "\\</s>\\", "</s>[INST", None]


def test_escape_round_trip():
    c = chat_format.Controls(("<s>", "</s>", "[INST]", "[/INST]"))
    rng = random.Random(1)
    some = [t or "" for t in TEXTS] + ["".join(rng.choice("<>/s\\[]INT") for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for t in some:
        e = c.escape(t)
        assert c.unescape(e) == t and not any(s in e for s in c.strings)
        for s in c.strings:  # nor across its end
            assert min((e + s).find(o) for o in c.strings if o in e + s) == len(e)
    for bad in (("x",), ("<\\>",), ("<s>", "<s>>")):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Controls(bad)


@pytest.mark.parametrize("part,segment", [(1, 10**6), (50, 64), (1 << 20, 64), (1 << 20, 10**6)])
def test_chat_format(spark, part, segment):
    rng = random.Random(part)
    roles = ["user", "assistant", "system", "", None, "[INST]<"]
    rows = [(c, t, rng.choice(roles), rng.choice(TEXTS)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "</s>"), (50, None, "user", "x"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a")]
    rows += [(60, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(700)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string").repartition(5)
    done = chat_format.format_chats(df, part_chars=part, segment_turns=segment).cache()
    if segment == 64:  # the long conversation is split
        assert done.filter("conv_id = 60").select("segment").distinct().count() > 4 and done.filter("conv_id = 50 AND segment > 0").count() == 0
    got = {r.conv_id: r for r in chat_format.digest_chats(done).collect()}
    chats = defaultdict(list)
    for c, t, role, text in rows:
        chats[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(chats)
    sizes = Counter()
    for r in done.collect():
        sizes[r.conv_id] += len(r.text)
    for c, turns in chats.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(learned), sizes[c])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    read = defaultdict(list)
    for r in chat_format.read_chats(done).orderBy("conv_id", "segment", "part", "at").collect():
        read[r.conv_id].append((r.role, r.text))
    assert read == {c: [(role, t) for _, role, t in sorted(turns)] for c, turns in chats.items()}


def _render(source, *turns):
    parts = list(chat_format.compiled(source).render(iter(turns)))
    assert len(parts) == 1
    return parts[0][0], [parts[0][0][a:b] for a, b in parts[0][1]]


def test_template_language():
    text, learned = _render(
        "{# note #}{% set sep = '-' ~ (1 + 2) %}begin{% for m in messages -%}  {%- if loop.first and not (m.role == 'x') %}[{{ loop.index }}]{% elif loop.last %}(last{{ loop.index0 }}){% else %}.{% endif %}"
        "{{ m.text | trim | upper }}{{ sep if loop.index < 3 else 'z' }}{% generation %}{{ m.role }}{% endgeneration %}{% endfor %}end",
        ("a", " q ", 0), ("b", "r", 1), ("c", None, 2),
    )
    assert text == "begin[1]Q-3a.R-3b(last2)zcend"
    assert learned == ["a", "b", "c"]


def test_segments_of_a_conversation():
    """Segments are what the whole conversation would be there."""
    t = chat_format.compiled("BOS{% set x = 'q' %}{% for m in messages %}{{ '^' if loop.first }}{{ x }}{{ loop.index }}{{ m.text }}{{ '$' if loop.last }}{% endfor %}EOS")
    turns = [("r", str(i), i) for i in range(9)]
    whole = [p for p, _, _ in t.render(iter(turns))]
    parts = [p for at in (0, 3, 6) for p, _, _ in t.render(iter(turns[at : at + 3]), 1 << 20, at, at == 6)]
    assert "".join(parts) == "".join(whole) and whole[0].startswith("BOS^q10q21") and whole[0].endswith("$EOS")


def test_constants_are_folded():
    t = chat_format.Template("a{{ 'b' ~ 1 }}{% if 1 == 2 %}never{% else %}c{% endif %}{% for m in messages %}{% if true and 'x' in 'xy' %}{{ 'q' | upper }}{% endif %}{{ m.text }}{% generation %}{% endgeneration %}{% endfor %}")
    assert t._parts[0] == ("block", [("const", "ab1c")])
    assert t._parts[1] == ("block", [("const", "Q"), ("out", ("field", "m", "text"))])


@pytest.mark.parametrize(
    "source",
    [
        "no loop", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in other %}{% endfor %}", "{% for m in messages %}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ m.text.upper() }}{% endfor %}",
        "{% for m in messages %}{{ open('x') }}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}", "{% for m in messages %}{{ m.text | eval }}{% endfor %}", "{{ m.text }}{% for m in messages %}{% endfor %}", "{% for m in messages %}{% if m.text %}{% endfor %}", "{% import x %}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{{ 'open }}{% endfor %}", "{% for m in messages %}{{ 1 + 'a' }}{% endfor %}", "{% for m in messages %}{% set loop = 1 %}{% endfor %}", "{% control x %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}", "{{ 'a' {% for m in messages %}{% endfor %}",
        "{% if true %}{% for m in messages %}a{% endfor %}{% endif %}{% for m in messages %}b{% endfor %}",
    ],
)
def test_templates_that_are_refused(source):
    with pytest.raises(chat_format.TemplateError):
        chat_format.Template(source)


@pytest.mark.parametrize("body", ["{{ m.text }}<e>", "{{ m.text | escape }}x<e>", "<e>{{ m.text | escape }}", "{{ m.role | escape }}{{ m.text | escape }}<e>", ""])
def test_templates_that_cannot_be_read(body):
    t = chat_format.Template("{% control '<e>' %}{% for m in messages %}" + body + "{% endfor %}")
    with pytest.raises(chat_format.TemplateError):
        _ = t.reader


def test_other_templates_round_trip(spark):
    source = "{% control '<|' '|>' %}BOS{% for m in messages %}{% if m.role == 'system' %}<|sys|>{{ m.text | escape }}<|end|>{% else %}<|{{ m.role | escape }}|>{% generation %}{{ m.text | escape }}{% endgeneration %}<|end|>{% endif %}{% endfor %}EOS"
    rows = [(1, 0, "system", "|><|"), (1, 1, "user", "<|end|>\\"), (2, 0, "user", "BOSEOS")]
    done = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), source)
    back = sorted((r.conv_id, r.at, r.role, r.text) for r in chat_format.read_chats(done, source).collect())
    assert back == [(1, 0, None, "|><|"), (1, 1, "user", "<|end|>\\"), (2, 0, "user", "BOSEOS")]


def test_no_chats(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest_chats(chat_format.format_chats(empty)).count() == 0


# ---- 4, with few rotations
def test_pieces_with_two_wrong_bits(spark):
    """One rotation alone doesn't find links where vectors share a direction; two wrong bits in a piece do."""
    from millrace.llm import embedding_dedup

    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 48)) + 3
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base + rng.normal(size=base.shape) * 0.17 / math.sqrt(48)
    x = np.concatenate([base, near / np.linalg.norm(near, axis=1, keepdims=True)])
    model = embedding_dedup.Quantiser(x, 12, 0.98, 0.99, 1)
    assert model.radius == 2 and len(model.turns) == 1 and model.recall >= 0.99
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, most_turns=1).collect()}
    cosine = x @ x.T
    np.fill_diagonal(cosine, 0)
    want = (cosine >= 0.98).sum(axis=1)
    assert want.sum() > 100 and sum(got.values()) >= 0.98 * want.sum() and all(got[i] <= w for i, w in enumerate(want))
