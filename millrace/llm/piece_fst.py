"""Operator 10: SentencePiece encoding and decoding with weighted finite-state transducers.

A model file is compiled, on the driver, to three transducers in arrays, which are sent to the tasks (their size is the
model's):

- the normaliser: a trie of the model's character map that rewrites the longest match, with the model's rules for white
  space (space to U+2581, one before the text, runs of spaces made one);
- the pieces: a trie whose states are prefixes of pieces and whose arcs are characters (a hashed table of state and
  character); a final state puts out its piece, with the piece's weight;
- the byte fallback: a character that starts no path of its own goes to the pieces of its bytes, or to the unknown piece.

They are composed with each input as a lattice: all places of all words of a batch walk the trie together, one character
at a time. The path with the least sum of weights in the tropical semiring (min, +) is the encoding, found column by
column for all words of a batch at once.

Weights. A unigram model's pieces weigh minus their score; ties go to the longer last piece (of
paths that differ by rounding alone the library may take another). In a BPE model the scores
are merge ranks, and a least sum of ranks isn't what merging gives. There the states are pairs of a place and the piece
that ends there, an arc between two pieces weighs nought if merging their text gives just these two, and infinity
otherwise: a sequence is what merging gives if and only if that holds for all neighbours (Berglund and van der Merwe
2023), so a single path has a finite weight, and ids equal those of the sentencepiece library.

Two characters that stand side by side in no piece are never on one arc, so the lattice is cut there: texts fall into
units, by a table of byte pairs, of which each distinct one is composed once for a batch and kept in the worker process
up to a fixed number; new units fall into shorter words the same way, by pairs of characters. Where a model has no byte
fallback, neighbouring unknown pieces become one, as in the library.

Decoding inverts the transducers: bytes of all pieces, U+2581 to space, the spaces taken away that encoding put before.

Defined results: null and empty texts have no ids and decode to the empty text. U+2581 in a text decodes to a space, as
in sentencepiece. Repeated rows get equal results. Models with unused pieces, or with white space behind words, are
refused. Columns that are kept may have any names but `ids` and `decoded`, which are replaced; empty tables give empty
results.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import M1, M2, U, fresh, mix, ragged, slices, table, utf8
from .units import Store, cut_at, gathered

SPACE = "▁"
CHUNK = 4 << 20
#: Characters of words composed together, and the length from which a word is composed on its own.
LATTICE, LONG = 1 << 17, 400
FOREVER = float("inf")
#: Fixed: kinds of pieces, and of models, in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
FREE = -1
#: Fixed: what the unknown piece decodes to.
NO_TEXT = " ⁇ "
_compiled: dict[str, PieceTransducer] = {}


class Hashed:
    """A fixed map from numbers (not negative) to numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, FREE, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = left[self.key[slot[left]] == FREE]
            _, first = np.unique(slot[free], return_index=True)
            here = free[first]
            self.key[slot[here]], self.value[slot[here]] = keys[here], values[here]
            left = left[self.key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U) * M1) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.value[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != FREE))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.key[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.value[slot[open_[same]]]
            open_ = open_[~same & (held != FREE)]
        return out


class Normaliser:
    """The transducer from a text to what the pieces are matched with; U+2581 is held as a space there."""

    def __init__(self, spec, kept: list[str]):
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        rules = _character_map(spec.precompiled_charsmap) if spec.precompiled_charsmap else {}
        # states are (arcs by character, what a final state puts out or None)
        self.rules = ({}, None) if rules else None
        for source, to in rules.items():
            state = self.rules
            for k, c in enumerate(source, 1):
                after = state[0].get(c, ({}, None))
                state[0][c] = state = (after[0], to) if k == len(source) else after
        self.ascii = re.compile("|".join(map(re.escape, sorted({k[0] for k in rules if k[0] < "\x80"}))) or "(?!)")
        self.kept = re.compile("|".join(map(re.escape, sorted(kept, key=len, reverse=True)))) if kept else None

    @property
    def plain(self) -> bool:
        return not self.rules and not self.squeeze and not self.kept

    def _rewrite(self, text: str) -> str:
        """What users defined as pieces stays; what is between is mapped."""
        if self.kept is None:
            return self._mapped(text)
        out, at = [], 0
        for m in self.kept.finditer(text):
            out += self._mapped(text[at : m.start()]), m.group().replace(" ", SPACE)
            at = m.end()
        return "".join(out) + self._mapped(text[at:])

    def _mapped(self, text: str) -> str:
        """Longest matches first."""
        if not self.rules or (text.isascii() and not self.ascii.search(text)):
            return text
        out, i, n, root = [], 0, len(text), self.rules
        while i < n:
            state, k, to, end = root, i, text[i], i + 1
            while k < n and (state := state[0].get(text[k])) is not None:  # along the arcs, to the last final state
                k += 1
                if state[1] is not None:
                    to, end = state[1], k
            out.append(to)
            i = end
        return "".join(out)

    def apply(self, texts: pa.Array) -> pa.Array:
        """For a column without nulls."""
        if not self.plain:
            some = map(self._rewrite, texts.to_pylist())
            texts = pa.array([re.sub(" +", " ", t.strip(" ")).rstrip(" " + SPACE) for t in some] if self.squeeze else list(some), pa.string())
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        return pc.replace_substring(texts, SPACE, " ")


def _character_map(blob: bytes) -> dict[str, str]:
    """All rewritings of a compiled map: its double array is walked from the root, level by level. Fixed: the layout of its units."""
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    at, keys, out = np.array([offset[0]]), [b""], {}
    while at.size:
        child = at[:, None] ^ np.arange(1, 256)
        inside = child < len(units)
        row, label = np.nonzero(inside & ((units[np.where(inside, child, 0)] & 0x800000FF) == np.arange(1, 256)))
        node = child[row, label]
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row, label, strict=True)]
        at = node ^ offset[node]
        for i in np.flatnonzero((units[node] >> 8) & 1):
            begin = int(units[at[i]] & 0x7FFFFFFF)
            out[keys[i].decode("utf-8", "replace")] = strings[begin : strings.index(b"\0", begin)].decode("utf-8", "replace")
    return out


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = model.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE) or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == UNUSED for p in model.pieces):
            raise ValueError("only unigram and BPE models with white space before words and without unused pieces")
        self.bpe = kind == BPE
        texts = [p.piece.replace(SPACE, " ") for p in model.pieces]
        kinds = np.array([p.type for p in model.pieces])
        self.user = [t for t, k in zip(texts, kinds, strict=True) if k == USER]
        self.normaliser = Normaliser(model.normalizer_spec, self.user)
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.bytes = np.full(256, self.unknown, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.bytes[int(texts[i][3:5], 16)] = i
        self.fallback = bool(model.trainer_spec.byte_fallback)
        normal = {t: i for i, t in enumerate(texts) if kinds[i] == NORMAL}
        score = np.array([p.score for p in model.pieces], np.float64)
        low, high = score[kinds == NORMAL].min(initial=FOREVER), score[kinds == NORMAL].max(initial=-FOREVER)
        self.weight = -score
        for t in self.user:
            self.weight[texts.index(t)] = -(len(t.replace(" ", SPACE).encode()) * high - 0.1)
        self.no_piece = -(low - 10.0)
        self.user_ids = {t: texts.index(t) for t in self.user}
        if self.bpe and not all(c in normal for t in normal for c in t):
            raise ValueError("a character of a piece is no piece")
        if self.bpe:
            self.weights = {t: -score[i] for t, i in normal.items()}
            normal = {t: i for t, i in normal.items() if self._spines(t)}
            self._merging(normal)
            del self.weights
        else:
            normal |= self.user_ids
        self._trie(normal)
        seen = np.zeros((256, 256), bool)
        pairs = set()
        for t in [*normal, *self.user]:
            b = t.encode()
            seen[list(b[:-1]), list(b[1:])] = True
            pairs.update(ord(x) << 21 | ord(y) for x, y in itertools.pairwise(t))
        self.cuts = (~seen & ~((np.arange(256) & 0xC0) == 0x80)).ravel()
        self.joined = Hashed(np.array(sorted(pairs), np.int64), np.zeros(len(pairs), np.int32))
        data = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else NO_TEXT.encode() if k == UNKNOWN else t.encode() for t, k in zip(texts, kinds, strict=True)]
        self.size = np.array([len(d) for d in data], np.int64)
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        self.length = np.array([max(1, len(t)) for t in texts])
        self.store = None

    # the pieces' trie

    def _trie(self, pieces: dict[str, int]) -> None:
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64) for t in pieces]
        size, ids = np.array([len(p) for p in points]), np.array(list(pieces.values()), np.int32)
        flat, begin = np.concatenate(points), np.cumsum(size) - size
        state, keys, made = np.zeros(len(points), np.int64), [], 1
        final = [np.full(1, -1, np.int32)]
        for d in range(size.max()):
            on = np.flatnonzero(size > d)
            key, which = np.unique(state[on] << 21 | flat[begin[on] + d], return_inverse=True)
            state[on] = made + which
            ends = np.full(len(key), -1, np.int32)
            last = size[on] == d + 1
            ends[which[last]] = ids[on[last]]
            final.append(ends)
            keys.append(key)
            made += len(key)
        self.longest, self.final = int(size.max()), np.concatenate(final)
        keys = np.concatenate(keys)
        self.arcs = Hashed(keys, np.arange(1, made, dtype=np.int32))
        self.root = np.full(0x110000, -1, np.int32)
        first = keys >> 21 == 0
        self.root[keys[first]] = np.flatnonzero(first) + 1

    # when merging keeps two pieces apart

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left and right end of a piece while it is merged, and when each is merged on; None if merging
        its characters doesn't give it."""
        parts = [(c, -FOREVER, [], []) for c in piece]  # text, time, left spine, right spine
        while len(parts) > 1:
            best = min(((self.weights.get(a[0] + b[0], FOREVER), i) for i, (a, b) in enumerate(itertools.pairwise(parts))), default=(FOREVER, 0))
            if best[0] == FOREVER:
                return None
            a, b = parts[best[1]], parts[best[1] + 1]
            time = max(best[0], a[1], b[1])
            parts[best[1] : best[1] + 2] = [(a[0] + b[0], time, [*a[2], (a[0], time)], [*b[3], (b[0], time)])]
        return [*parts[0][2], (piece, FOREVER)], [*parts[0][3], (piece, FOREVER)]

    def _merging(self, pieces: dict[str, int]) -> None:
        n = max(pieces.values()) + 1
        names: dict[str, int] = {}
        self.spine: list[tuple] = []
        both = {i: self._spines(t) for t, i in pieces.items()}
        for side in (0, 1):
            begin, node, time = np.zeros(n, np.int64), [], []
            for i, s in both.items():
                begin[i] = len(node)
                for text, t in s[side]:
                    node.append(names.setdefault(text, len(names)))
                    time.append(t)
            self.spine.append((begin, np.array(node, np.int64), np.array(time)))
        keys, values = [], []
        for t in self.weights:
            for k in range(1, len(t)):
                if (x := names.get(t[:k])) is not None and (y := names.get(t[k:])) is not None:
                    keys.append(x << 24 | y)
                    values.append(len(values))
        self.merged = Hashed(np.array(keys, np.int64), np.array(values, np.int32))
        weight = [self.weights[t] for t in self.weights for k in range(1, len(t)) if t[:k] in names and t[k:] in names]
        self.merge_weight = np.array([*weight, FOREVER])  # the last one is for pairs that don't merge
        self.memo_key = self.memo = None

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """If merging the text of pieces a and b gives just these two."""
        if self.memo_key is None:
            self.memo_key, self.memo = np.full(1 << 20, FREE, np.int64), np.zeros(1 << 20, bool)
        key = a.astype(np.int64) << 24 | b
        slot = (mix(key.astype(U) * M2) >> U(44)).astype(np.int64)
        out = self.memo[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        if new.size:
            out[new] = self._merge_apart(a[new], b[new])
            self.memo_key[slot[new]], self.memo[slot[new]] = key[new], out[new]
            clash = self.memo_key[slot[new]] != key[new]  # two new pairs at one slot: keep neither's answer for the other
            self.memo_key[slot[new[clash]]] = FREE
        return out

    def _merge_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (_, _, _), (begin_r, node_r, time_r) = self.spine
        begin_l, node_l, time_l = self.spine[0]
        i, j, live = begin_r[a], begin_l[b], np.arange(len(a))
        out = np.zeros(len(a), bool)
        while live.size:
            ti, tj = time_r[i], time_l[j]
            w = self.merge_weight[self.merged.get(node_r[i] << 24 | node_l[j])]
            joined = (w < ti) & (w <= tj)
            over = joined | (np.isinf(ti) & np.isinf(tj) & (ti > 0) & (tj > 0))
            out[live[over]] = ~joined[over]
            left = ti <= tj
            i, j = (i + left)[~over], (j + ~left)[~over]
            live = live[~over]
        return out

    # composition and shortest path

    def _lattice(self, points: np.ndarray, column: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """Composes words with the pieces. `points` has first the first characters of all words, then all second ones, and so
        on, longer words first; column says where each begins, words how many words reach it. Entry d: the piece of d + 1
        characters that ends at each place, or -1."""
        n = len(points)
        out = [np.full(n, -1, np.int32) for _ in range(min(self.longest, len(words)))]
        at = np.arange(n)
        col = np.repeat(np.arange(len(words)), words)
        row = at - column[col]
        state = self.root[points]
        for d, ends in enumerate(out):
            if d:
                state = self.arcs.get(state.astype(np.int64) << 21 | points[column[col] + row])
            ok = state >= 0
            state, col, row = state[ok], col[ok], row[ok]
            piece = self.final[state]
            has = piece >= 0
            ends[column[col[has]] + row[has]] = piece[has]
            on = col + 1 < len(words)
            on[on] = row[on] < words[col[on] + 1]
            state, col, row = state[on], col[on] + 1, row[on]
            if not col.size:
                break
        return out

    def _paths(self, points: np.ndarray, column: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The last piece of the best path to each place; -1 is the character's own bytes or the unknown piece."""
        pieces = self._lattice(points, column, words)
        last = np.full(len(points), -1, np.int32)
        cost = np.zeros(0) if self.bpe else np.full(len(points), FOREVER)
        for c, n in enumerate(words):
            a = column[c]
            here = last[a : a + n]
            if self.bpe:
                open_ = np.flatnonzero(pieces[0][a : a + n] >= 0)
                for d in range(min(c, len(pieces) - 1), -1, -1):
                    piece = pieces[d][a : a + n][open_]
                    has = np.flatnonzero(piece >= 0)
                    if not has.size:
                        continue
                    rows, piece = open_[has], piece[has]
                    if d < c:
                        before = last[column[c - d - 1] + rows]
                        fits = before < 0
                        some = np.flatnonzero(~fits)
                        fits[some] = self._fits(before[some], piece[some])
                    else:
                        fits = np.ones(len(rows), bool)
                    here[rows[fits]] = piece[fits]
                    open_ = np.delete(open_, has[fits])
                    if not open_.size:
                        break
                if open_.size:
                    raise ValueError("no path")
            else:
                best = cost[a : a + n]
                for d in range(min(c, len(pieces) - 1), -1, -1):
                    piece = pieces[d][a : a + n]
                    before = cost[column[c - d - 1] : column[c - d - 1] + n] if d < c else 0.0
                    w = np.where(piece >= 0, before + self.weight[piece], FOREVER)
                    less = w < best
                    best[less], here[less] = w[less], piece[less]
                before = cost[column[c - 1] : column[c - 1] + n] if c else np.zeros(n)
                alone = np.where(pieces[0][a : a + n] < 0, before + self.no_piece, FOREVER)
                less = alone < best
                best[less], here[less] = alone[less], -1
        return last

    def _long(self, points: np.ndarray) -> np.ndarray:
        """As _paths for a single word, one place after the other."""
        n = len(points)
        pieces = self._lattice(points, np.arange(n), np.ones(n, np.int64))
        arcs = [[(d + 1, int(p[i])) for d, p in enumerate(pieces) if p[i] >= 0][::-1] for i in range(n)]
        last, cost, memo = [-1] * n, [0.0] * (n + 1), {}
        weight = self.weight.tolist()
        for i, some in enumerate(arcs):
            best, own = (FOREVER, -1) if some and some[-1][0] == 1 else (cost[i] + self.no_piece, -1)
            for d, piece in some:
                before = last[i - d] if i >= d else -1
                if not self.bpe:
                    if (w := cost[i + 1 - d] + weight[piece]) < best or (w == best and own < 0):
                        best, own = w, piece
                    continue
                if before >= 0 and (before, piece) not in memo:
                    memo[before, piece] = bool(self._fits(np.array([before]), np.array([piece]))[0])
                if before < 0 or memo[before, piece]:
                    own = piece
                    break
            last[i], cost[i + 1] = own, best
        return np.array(last, np.int32)

    def words(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (code points and their bounds) in order, and their number for each word."""
        length = np.diff(at)
        last = np.full(len(points), -1, np.int32)
        order = np.argsort(-length, kind="stable")
        long = int(np.searchsorted(-length[order], -LONG, side="left"))
        for i in order[:long]:
            last[at[i] : at[i + 1]] = self._long(points[at[i] : at[i + 1]])
        sizes = np.concatenate([[0], np.cumsum(length[order[long:]])])
        for x, y in slices(sizes, LATTICE):
            some = order[long + x : long + y]
            own = length[some]
            if not own[0]:
                continue
            words = np.searchsorted(-own, -np.arange(1, own[0] + 1), side="right")
            column = np.cumsum(words) - words
            place = at[some][ragged(np.zeros(len(words), np.int64), words)] + np.repeat(np.arange(len(words)), words)
            last[place] = self._paths(points[place], column, words)
        # back from the ends of the words: which places end a piece of the path
        step = np.where(last >= 0, self.length[np.maximum(last, 0)], 1)
        marks = np.zeros(len(points), bool)
        here = (at[1:] - 1)[length > 0]
        start = at[:-1][length > 0]
        while here.size:
            marks[here] = True
            here = here - step[here]
            on = here >= start
            here, start = here[on], start[on]
        place = np.flatnonzero(marks)
        piece = last[place]
        number = np.ones(len(place), np.int64)
        out = piece
        if (piece < 0).any():
            alone = np.flatnonzero(piece < 0)
            if not self.fallback:
                out = np.where(piece < 0, self.unknown, piece)
            else:
                raw = [self.bytes[list(chr(p).encode("utf-8", "replace"))] for p in points[place[alone]].tolist()]
                number[alone] = [len(r) for r in raw]
                out = np.zeros(int(number.sum()), np.int32)
                begin = np.cumsum(number) - number
                out[begin[piece >= 0]] = piece[piece >= 0]
                out[ragged(begin[alone], number[alone])] = np.concatenate(raw)
        ends = np.concatenate([[0], np.cumsum(number)])[np.searchsorted(place, at)]
        return out.astype(np.int32), np.diff(ends)

    def units(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As words(), for units as bytes: they fall into words where two characters stand side by side in no piece."""
        lead = (buf & 0xC0) != 0x80
        points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lead)])[at]
        cut = np.ones(len(points) + 1, bool)
        if len(points):
            cut[1:-1] = self.joined.get(points[:-1] << 21 | points[1:]) < 0
        cut[bounds] = True
        fixed = {}
        if self.bpe and self.user:
            for u, text in enumerate(points[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in itertools.pairwise(bounds)):
                for m in self.normaliser.kept.finditer(text):
                    a, b = bounds[u] + m.start(), bounds[u] + m.end()
                    cut[a : b + 1] = False
                    cut[[a, b]] = True
                    fixed[a] = self.user_ids[m.group()]
        starts = np.flatnonzero(cut)
        flat, number = self.words(points, starts)
        if fixed:
            rows = np.split(flat, np.cumsum(number)[:-1])
            rows = [np.array([fixed[s]], np.int32) if s in fixed else r for s, r in zip(starts[:-1].tolist(), rows, strict=True)]
            flat, number = np.concatenate(rows), np.array([len(r) for r in rows])
        ends = np.concatenate([[0], np.cumsum(number)])[np.searchsorted(starts, bounds)]
        return flat, np.diff(ends)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if self.store is None:
            self.store = Store(self.units, "<i4", 400_000, 1_500_000)
        offsets, buf = utf8(self.normaliser.apply(pc.fill_null(texts.cast(pa.string()), "")))
        flat, number = gathered(self.store, buf, offsets, cut_at(buf, offsets, self.cuts))
        if not self.fallback and len(flat):
            again = np.zeros(len(flat), bool)
            again[1:] = (flat[1:] == self.unknown) & (flat[:-1] == self.unknown)
            begin = np.cumsum(number) - number
            again[begin[number > 0]] = False
            number = number - np.diff(np.concatenate([[0], np.cumsum(again)])[np.append(begin, len(flat))])
            flat = flat[~again]
        return flat, number

    def texts(self, flat: np.ndarray, at: np.ndarray) -> list[str]:
        """The text of each run of ids between neighbouring bounds."""
        size = self.size[flat]
        data = self.data[ragged(self.begin[flat], size)].tobytes()
        stop = np.concatenate([[0], np.cumsum(size)])[at]
        out = [data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(stop)]
        if self.normaliser.squeeze:
            return [t[:k].lstrip(" ") + t[k:] for t in out for k in [t.find(NO_TEXT) if NO_TEXT in t else len(t)]]
        return [t[1:] if t[:1] == " " and t[:3] != NO_TEXT else t for t in out] if self.normaliser.prefix else out

    def __getstate__(self):
        return self.__dict__ | {"store": None} | ({"memo_key": None, "memo": None} if self.bpe else {})


def _transducer(path: str) -> PieceTransducer:
    """The compiled model, kept on the driver."""
    if path not in _compiled:
        _compiled[path] = PieceTransducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """docs (text, ...) -> the columns `keep` with ids (array of int); `back` adds decoded, what the ids decode to, in the
    same pass."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    sent = docs.sparkSession.sparkContext.broadcast(_transducer(model))
    names = [*keep, "ids", *(["decoded"] if back else [])]

    def run(batches):
        fst = sent.value
        for batch in batches:
            text = batch.column(len(keep))
            for i, j in slices(utf8(text)[0], CHUNK):
                ids, n = fst.ids(text.slice(i, j - i))
                at = np.concatenate([[0], np.cumsum(n)])
                own = batch.slice(i, j - i)
                more = [pa.array(fst.texts(ids, at), pa.string())] if back else []
                yield pa.record_batch([*(own.column(c) for c in range(len(keep))), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), *more], names)

    fields = [*docs.select(*keep).schema.fields, StructField("ids", ArrayType(IntegerType()))]
    return docs.select(*keep, F.col("text").alias(fresh("text", keep))).mapInArrow(run, StructType(fields + [StructField("decoded", StringType())] * back))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows (ids, ...) -> the same with decoded (string). Null ids decode to the empty text."""
    columns = [c for c in rows.columns if c != "decoded"]
    sent = rows.sparkSession.sparkContext.broadcast(_transducer(model))

    def run(batches):
        fst = sent.value
        for batch in batches:
            ids = pc.fill_null(batch.column("ids"), [])
            at = np.asarray(ids.offsets).astype(np.int64)
            flat = np.asarray(ids.values)[at[0] : at[-1]].astype(np.int64)
            at = at - at[0]
            for i, j in slices(np.concatenate([[0], np.cumsum(fst.size[flat])])[at], CHUNK):
                part = batch.slice(i, j - i)
                text = fst.texts(flat[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.record_batch([*part.columns, pa.array(text, pa.string())], [*columns, "decoded"])

    rows = rows.select(*columns)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def op10_sentencepiece(spark, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """A row per document: number and checksum of its ids, and if they decode to the text again (U+2581 as space)."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(vocabulary), back=True)
    same = F.translate(F.coalesce("text", F.lit("")), SPACE, " ") == F.col("decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
SQL: dict[str, str] = {}
