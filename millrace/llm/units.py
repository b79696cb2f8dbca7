"""Cutting a batch of texts into units that a tokenizer treats on their own, so that each distinct unit is encoded once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import M1, M3, U, mix, ragged, span_hashes


def cut_at(buf: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Starts of the units: the texts' own starts (but of empty texts), and every byte that, by the table `pairs` of 256
    times 256, may be cut from the byte before it."""
    start = np.zeros(len(buf), bool)
    if len(buf):
        start[1:] = pairs[(buf[:-1].astype(np.uint16) << 8) | buf[1:]]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def distinct(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units as bytes with their bounds, and the place of each unit of the texts among them."""
    bounds = np.append(starts, len(buf)).astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = spans.dictionary_encode()
    kinds = coded.dictionary
    at = np.frombuffer(kinds.buffers()[1], np.int32)[: len(kinds) + 1].astype(np.int64)
    data = kinds.buffers()[2]
    return (np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)), at, np.asarray(coded.indices)


class Store:
    """Ids of units by a 128-bit hash of their bytes, kept in a worker process from batch to batch. It holds at most
    `most` units and `most_ids` ids, some 40 MB; once it is full, units it doesn't hold are encoded anew in each batch.
    `encode` takes the bytes and bounds of units, and gives all their ids and the number of each."""

    def __init__(self, encode, kind: str, most: int = 800_000, most_ids: int = 4_000_000):
        self.encode, self.kind, self.most, self.most_ids = encode, kind, most, most_ids
        self.key, self.check = np.zeros(0, U), np.zeros(0, U)
        self.start, self.size, self.held = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, kind)

    def ids(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit: ids of all units in one array, where each unit's begin there, and their number."""
        n = len(at) - 1
        first = span_hashes(buf, at[:-1], at[1:])
        second = mix((first ^ _last(buf, at)) * M3 + M1)
        start, size, held = np.zeros(n, np.int64), np.zeros(n, np.int64), self.held
        known = np.zeros(n, bool)
        if len(self.key):
            place = np.minimum(np.searchsorted(self.key, first), len(self.key) - 1)
            known = (self.key[place] == first) & (self.check[place] == second)
            start[known], size[known] = self.start[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        if new.size:
            length = np.diff(at)[new]
            flat, number = self.encode(buf[ragged(at[:-1][new], length)], np.concatenate([[0], np.cumsum(length)]))
            begin = np.cumsum(number) - number
            start[new], size[new] = begin + len(held), number
            held = np.concatenate([held, flat.astype(self.kind)])
            fits = (np.arange(len(new)) < self.most - len(self.key)) & (begin + number + len(self.held) <= self.most_ids)
            room = int(fits.sum()) if fits.all() else int(np.argmin(fits))
            if room:
                keep = new[:room]
                key = np.concatenate([self.key, first[keep]])
                order = np.argsort(key, kind="stable")
                self.key, self.check = key[order], np.concatenate([self.check, second[keep]])[order]
                self.start, self.size = (np.concatenate([x, y[keep].astype(np.int32)])[order] for x, y in ((self.start, start), (self.size, size)))
                self.held = held[: int(begin[room - 1] + number[room - 1]) + len(self.held)].copy()
        return held, start, size


def _last(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A sum over each unit's bytes by place, to tell apart units of one hash."""
    value = (buf.astype(U) + U(1)) * mix(np.arange(len(buf), dtype=U) - np.repeat(at[:-1], np.diff(at)).astype(U) + M1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(value, dtype=U)])
    return total[at[1:]] - total[at[:-1]]


def gathered(store: Store, buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has."""
    if not len(starts):
        return np.zeros(0, store.kind), np.zeros(len(offsets) - 1, np.int64)
    kinds, at, codes = distinct(buf, starts)
    held, start, size = store.ids(kinds, at)
    own = size[codes]
    ends = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(starts, offsets)]
    return held[ragged(start[codes], own)], np.diff(ends)
