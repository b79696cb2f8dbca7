"""Tokens: models made by hand against the sentencepiece library, wavelet matrices and lookups against brute force."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from millrace.llm import piece_fst, token_files
from millrace.llm.common import shared_dir

SIGNS = ["a", "b", "c", "d", "e", "1", ",", " ", "  ", "\u2581", "zz", "\u00e9", "\ufb01", "\u2460", "\u3000", "\t", "\u65e5", "\uff21", "[X]", "[XY]", "ab", "cd", "\n"]


def model(path, kind, pieces, fallback, rule, squeeze, user):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((u, 0, 4) for u in user), *((f"<0x{b:02X}>", 0, 6) for b in range(256) if fallback), *((t, s, 1) for t, s in pieces)]
    for piece, score, type_ in rows:
        m.pieces.add(piece=piece, score=score, type=type_)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = rule, True, squeeze
    if rule != "identity":
        own = pb.ModelProto()
        own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    path.write_bytes(m.SerializeToString())
    return str(path)


def pieces(kind, rnd):
    """Random pieces over a few letters; those of a BPE model are made by merging."""
    if kind == piece_fst.UNIGRAM:
        words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5))) for _ in range(150)} | set("abcde1,")
        return [("\u2581", -3.0), *((p + w, -rnd.random() * 8 - 2) for w in sorted(words) for p in ("", "\u2581"))]
    have = [*"abcde1,", "\u2581"]
    while len(have) < 130:
        x = rnd.choice(have) + rnd.choice(have)
        if "\u2581" not in x[1:] and len(x) < 8 and x not in have:
            have.append(x)
    return [(t, -1000.0 - i if i < 8 else 8.0 - i) for i, t in enumerate(have)]


@pytest.mark.parametrize("kind", [piece_fst.UNIGRAM, piece_fst.BPE])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("rule,squeeze,user", [("identity", False, ()), ("nmt_nfkc", True, ("[X]", "[XY]"))])
def test_models_made_by_hand(tmp_path, kind, fallback, rule, squeeze, user):
    import sentencepiece

    rnd = random.Random(5)
    path = model(tmp_path / "m.model", kind, pieces(kind, rnd), fallback, rule, squeeze, user)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_fst.PieceTransducer(path)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 25))) for _ in range(2000)] + ["", "abcd" * 300, "  ", "\u2581 a"]
    for _ in range(2):  # the second time from the store
        flat, n = own.ids(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(n)])
        for i, ids in enumerate(library.encode(texts)):
            got = flat[at[i] : at[i + 1]].tolist()
            # of paths that differ by rounding the library may take the other one
            assert got == ids or (kind == piece_fst.UNIGRAM and abs(own.weight[got].sum() - own.weight[ids].sum()) < 1e-3 and library.decode(got) == library.decode(ids)), texts[i]
        assert own.texts(flat, at) == [library.decode(flat[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]


def test_unused_pieces_are_refused(tmp_path):
    path = model(tmp_path / "m.model", piece_fst.UNIGRAM, [("a", -1.0)], True, "identity", False, ())
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString((tmp_path / "m.model").read_bytes())
    m.pieces.add(piece="b", score=-1.0, type=piece_fst.UNUSED)
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="unused"):
        piece_fst.PieceTransducer(path)


def test_pieces_of_odd_texts():
    import sentencepiece

    rnd = random.Random(2)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", "x" * 3000, "=" * 2000, "".join(rnd.choice("abcdeXYZ019+/") for _ in range(5000)), "\u65e5\u672c\u8a9e" * 700, *("".join(rnd.choice([*SIGNS, "the", "ing ", "====", "\U0001f600", "<s>", "don't"]) for _ in range(rnd.randint(0, 14))) for _ in range(3000))]
    own = piece_fst.PieceTransducer(path)
    flat, n = own.ids(pa.array([*texts, None]))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [*sentencepiece.SentencePieceProcessor(model_file=path).encode(texts), []]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_odd_white_space(vocabulary):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    path = public_tokenizers.path(vocabulary)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    signs = [" ", "  ", "\n", "\n\n", " \n", "\n ", "a", "foo", "don't", "'s", "12", "3.5", "\u00e9", "\u65e5\u672c", ",", "...", "!", "\t", "\r\n", "_", "Ab", "\x1c", "x'", "\x0b", "\u00a0", "\u3000", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["", " ", "\n"]
    coder = token_files._Tokenizer(path)
    for _ in range(2):
        flat, n = coder.ids(pa.array([*texts, None]))
        at = np.concatenate([[0], np.cumsum(n)])
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [*(library.encode(t, add_special_tokens=False).ids for t in texts), []]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 300, 3000).astype(np.uint16), rng.zipf(1.3, 2000).clip(0, 70000).astype(np.uint32), np.zeros(5, np.uint16), np.full(700, 65535, np.uint16), np.zeros(0, np.uint16)):
        m = token_files.WaveletMatrix.build(x)
        assert (m.ids() == x).all()
        for value in {*x[:20].tolist(), 299, 70000, -1}:
            at = np.flatnonzero(x == value)
            assert m.count(value) == len(at) and m.places(value).tolist() == at.tolist()
            assert [m.select(value, k) for k in range(min(len(at), 9))] == at[:9].tolist() and m.select(value, len(at)) == m.select(value, -1) == -1
        for i in rng.integers(0, max(len(x), 1), 20):
            assert not len(x) or (m.access(int(i)) == x[i] and m.rank(int(x[0]), int(i)) == (x[:i] == x[0]).sum())


def test_occurrences(spark):
    texts = [(i, " ".join(random.Random(i).choice(["the", "of", "a", "word"]) for _ in range(i % 40))) for i in range(300)] + [(7, None), (None, "the of")]
    out = shared_dir(spark)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    token_files.write_tokens(docs, out, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=700)
    want = defaultdict(list)
    rows = token_files.read_tokens(spark, out).collect()
    wanted = [0, 262, 1573, 50_000_000]
    for r in rows:
        for value in wanted:
            if (at := np.flatnonzero(np.frombuffer(r.ids, "<u4") == value)).size:
                want[value].append((str(r.doc_id), len(at), at.tolist()))
    got = defaultdict(list)
    for r in token_files.occurrences(spark, out, wanted).collect():
        got[r.id].append((str(r.doc_id), r.n, r.places))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(want) >= 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = shared_dir(spark)
    token_files.write_tokens(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_tokens(spark, out).count() == token_files.occurrences(spark, out, [1]).count() == 0
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert piece_fst.encode(docs, path, back=True).count() == piece_fst.decode(piece_fst.encode(docs, path), path).count() == 0


def test_many_user_pieces_in_a_text():
    """The normaliser goes through them in a loop, so their number has no limit."""
    from types import SimpleNamespace

    import pyarrow as pa

    from millrace.llm.piece_fst import Normaliser

    n = Normaliser(SimpleNamespace(add_dummy_prefix=False, remove_extra_whitespaces=False, precompiled_charsmap=b""), ["<x y>", "<x>"])
    text = "a<x>b <x y>" * 50_000
    assert n.apply(pa.array([text]))[0].as_py() == text
