"""Elias-Fano coded monotone sequences, and a two-level n-gram trie of them, in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np


class EliasFano:
    """A non-decreasing sequence: low bits in an array, high bits in unary in a bit vector, one directory entry for 64 bits of it."""

    def __init__(self, folder: str, name: str, values: np.ndarray | None = None):
        self.files = {k: os.path.join(folder, f"{name}.{k}.npy") for k in ("low", "high", "zeros", "shape")}
        if values is not None:
            self.write(values.astype(np.uint64))
        self.low, self.high, self.zeros, shape = (np.load(self.files[k], mmap_mode="r") for k in ("low", "high", "zeros", "shape"))
        self.n, self.bits, self.top = (int(x) for x in shape)

    def write(self, v: np.ndarray) -> None:
        n = len(v)
        most = int(v[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(bits)).astype(np.int64)
        top = int(high[-1]) if n else 0
        unary = np.zeros((n + top + 1 + 63) // 64 * 64, np.uint8)
        unary[high + np.arange(n)] = 1  # then a zero ends each high value
        kind = next(k for k, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits <= b)
        zeros = np.cumsum(64 - unary.reshape(-1, 64).sum(1, dtype=np.int64))
        for k, a in (("low", (v & np.uint64((1 << bits) - 1)).astype(kind)), ("high", np.packbits(unary)), ("zeros", np.concatenate([[0], zeros])), ("shape", np.array([n, bits, top]))):
            np.save(self.files[k], a)

    def zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        packed = self.high.reshape(-1, 8)
        for low in range(0, len(k), 1 << 16):
            w = word[low : low + (1 << 16)]
            free = 1 - np.unpackbits(packed[w], axis=1)
            nth = k[low : low + (1 << 16)] - self.zeros[w] + 1
            out[low : low + (1 << 16)] = w * 64 + (np.cumsum(free, axis=1, dtype=np.int16) == nth[:, None]).argmax(1)
        return out

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The place of the first element that is >= x among those from place `first` up to `last` (`last` if there is none): successor search."""
        last = self.n if last is None else last
        if not self.n:
            return np.zeros(len(x), np.int64)
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        over = high > self.top
        high = np.minimum(high, self.top)
        begin = np.where(high > 0, self.zero(np.maximum(high - 1, 0)) - high + 1, 0)
        stop = self.zero(high) - high
        begin, stop = np.where(over, self.n, begin), np.where(over, self.n, stop)
        begin, stop = np.clip(begin, first, last), np.clip(stop, first, last)
        want = x & np.uint64((1 << self.bits) - 1)
        while True:  # binary search among those of the same high bits
            live = np.flatnonzero(begin < stop)
            if not len(live):
                break
            mid = (begin[live] + stop[live]) // 2
            less = self.low[mid] < want[live]
            begin[live] = np.where(less, mid + 1, begin[live])
            stop[live] = np.where(less, stop[live], mid)
        return begin

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by place."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        out = np.empty(len(i), np.uint64)
        packed = self.high.reshape(-1, 8)
        for low in range(0, len(i), 1 << 16):
            s = slice(low, low + (1 << 16))
            w = word[s]
            set_ = np.unpackbits(packed[w], axis=1)
            nth = i[s] - ones[w] + 1
            at = w * 64 + (np.cumsum(set_, axis=1, dtype=np.int16) == nth[:, None]).argmax(1)
            out[s] = ((at - i[s]).astype(np.uint64) << np.uint64(self.bits)) | self.low[i[s]].astype(np.uint64)
        return out


#: Levels of the quantised log10 probabilities: codes from 1 on, the finest step that two bytes hold down to 10^-12; 0 is "not there".
STEP = 12 / 65_000


def quantise(p: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.rint(-np.log10(p) / STEP), 0, 65_000)).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(float) - 1) * STEP), 0.0)


class Trie:
    """Contexts, pointers to their successors, successors, and the successors' quantised probabilities.

    A context's successors are a range of one monotone sequence, each raised by the value at the end of the range before. A pair is found by
    successor search inside its context's range, from the pointer on, relative to that value.
    """

    def __init__(self, folder: str, contexts: np.ndarray, owner: np.ndarray, successor: np.ndarray, p: np.ndarray):
        """contexts: ascending; owner, successor: pairs in ascending order, by the context's place and the successor."""
        self.contexts = EliasFano(folder, "contexts", contexts)
        begin = np.searchsorted(owner, np.arange(len(contexts) + 1))
        self.pointers = EliasFano(folder, "pointers", begin)
        ends = begin[1:][begin[1:] > begin[:-1]]  # of contexts that have successors
        before = np.zeros(len(contexts) + 1, np.uint64)
        before[1:][begin[1:] > begin[:-1]] = successor[ends - 1]
        self.successors = EliasFano(folder, "successors", successor.astype(np.uint64) + np.cumsum(before, dtype=np.uint64)[:-1][owner])
        np.save(os.path.join(folder, "codes.npy"), quantise(p))
        self.codes = np.load(os.path.join(folder, "codes.npy"), mmap_mode="r")

    def query(self, contexts: np.ndarray, lengths: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs: `lengths` successors for each context, one after another."""
        if not self.contexts.n or not self.successors.n or not len(successor):
            return np.zeros(len(successor), np.uint16)
        place = self.contexts.find(contexts)
        safe = np.minimum(place, self.contexts.n - 1)
        known = (place < self.contexts.n) & (self.contexts.get(safe) == contexts.astype(np.uint64))
        begin, stop = self.pointers.get(safe).astype(np.int64), self.pointers.get(safe + 1).astype(np.int64)
        stop = np.where(known, stop, begin)
        raised = np.where(begin > 0, self.successors.get(np.maximum(begin - 1, 0)), np.uint64(0))
        begin, stop, raised = (np.repeat(x, lengths) for x in (begin, stop, raised))
        want = successor.astype(np.uint64) + raised
        at = self.successors.find(want, begin, stop)
        out = np.zeros(len(successor), np.uint16)
        hit = np.flatnonzero(at < stop)
        hit = hit[self.successors.get(at[hit]) == want[hit]]
        out[hit] = self.codes[at[hit]]
        return out
