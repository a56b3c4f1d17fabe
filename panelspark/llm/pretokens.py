"""Splitting of text into pre-tokens, for whole batches in numpy, and a bounded store of what each pre-token encodes to.

Two split rules are known: "spaced" (a word takes the space before it; white space is kept) and "plain" (white space
is dropped, each digit stands alone). Texts with characters whose class could differ between Unicode versions are left to the
caller's exact path.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .common import KEEP, M1, M2, M3, M4, U, mix, windows8

OTHER, LETTER, NUMBER, BLANK, UNSURE = 0, 1, 2, 3, 9
#: Ranges of code points whose classes have been stable for long; others go the caller's exact path.
STABLE = [(0, 0x378), (0x384, 0x588), (0x5D0, 0x5EB), (0x620, 0x6D5), (0x904, 0x93A), (0x1E00, 0x1F16), (0x2000, 0x2065), (0x2070, 0x208F), (0x20A0, 0x20BE), (0x2100, 0x214F), (0x2190, 0x2300), (0x2500, 0x2700), (0x3001, 0x3040), (0x3041, 0x3097), (0x30A1, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFFBF), (0x1F300, 0x1F6D0)]
#: The White_Space property.
BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings after an apostrophe that make a pre-token of their own: one letter, or two.
ONE, TWO = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.full(0x110000, UNSURE, np.uint8)
    for low, high in STABLE:
        for c in range(low, high):
            kind = unicodedata.category(chr(c))
            table[c] = UNSURE if kind in ("Cn", "Co") else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    table[BLANKS] = BLANK
    return table


def split(buf: np.ndarray, offsets: np.ndarray, rule: str, known: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens, the first pre-token's number by row (one more at the end), rows with unsure characters.

    known: gives the classes of characters that the table leaves unsure.
    """
    size = int(offsets[-1])
    raw = buf[:size]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(cp)
    at = np.flatnonzero((raw & 0xC0) != 0x80) if n != size else np.arange(n)  # byte place of each character
    row_char = np.searchsorted(at, offsets)
    kind = classes()[cp]
    if known is not None and (kind == UNSURE).any():
        kind[kind == UNSURE] = known(cp[kind == UNSURE])
    first = np.zeros(n + 1, bool)
    first[row_char] = True
    unsure = np.unique(np.searchsorted(row_char, np.flatnonzero(kind == UNSURE), side="right") - 1)
    start = np.zeros(n + 3, bool)
    start[:n] = first[:n]
    start[1:n] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    if rule == "spaced":
        last = blank.copy()
        last[:-1] &= ~blank[1:] & ~first[1:n]
        last[-1:] = False
        last = np.flatnonzero(last)  # white space just before something else in its row
        start[last] = True
        start[last[cp[last] == 32] + 1] = False
    else:
        start[:n] |= kind == NUMBER
    quote = np.flatnonzero((cp == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        c1 = cp[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~first[far], cp[far], 0)
        one = np.isin(c1, [ord(c) for c in ONE])
        two = np.zeros(len(quote), bool)
        for a, b in TWO:
            two |= (c1 == ord(a)) & (c2 == ord(b))
        for hit, width in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            start[q + 1] = False
            e = q + width
            e = e[e < n]
            e = e[~first[e] & (kind[e] == LETTER)]
            start[e] = True
    begins = np.flatnonzero(start[:n])
    ends = np.append(begins[1:], n)
    at = np.append(at, size)
    if rule == "plain":
        keep = ~blank[begins]
        begins, ends = begins[keep], ends[keep]
    return at[begins], at[ends], np.searchsorted(begins, row_char), unsure


class Memo:
    """Pre-token bytes to ids, in arrays: keys of up to 24 bytes are held exactly, longer ones in a dictionary.

    A task's helper, not a model: when `most` entries are reached those that were met again stay, the most frequent half at most. `encode`
    gets the bytes that are not known.
    """

    WIDTH = 24

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], bits: int = 20, most: int = 600_000):
        self.encode, self.bits, self.most = encode, bits, most
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros((3, size), np.uint64)
        self.lens = np.zeros(size, np.uint8)
        self.vals = np.full(size, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.offs, self.counts, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)
        self.hits = np.zeros(1 << 12, np.int32)
        self.n = self.n_ids = 0

    def trim(self) -> None:
        """Makes room: keeps entries met more than once since the last time, the most frequent ones first."""
        slots = np.flatnonzero(self.vals >= 0)
        hits = self.hits[self.vals[slots]]
        often = np.argsort(-hits, kind="stable")[: self.most // 2]
        slots, hits = slots[often][hits[often] > 1], hits[often][hits[often] > 1]
        k, lens, entries = self.keys[:, slots], self.lens[slots].astype(np.int64), self.vals[slots]
        counts, ids = self.counts[entries], self.spread(entries)[0]
        self.clear()
        vals = self.append(counts, ids).astype(np.int32)
        self.hits[: self.n] = hits // 2
        if len(vals):
            self.place(k, lens, (self.hashed(k, lens) & U((1 << self.bits) - 1)).astype(np.int64), vals)

    @staticmethod
    def hashed(k: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return mix((k[0] * M1) ^ (k[1] * M2 + M3) ^ (k[2] * M3 + M4) ^ (lens.astype(np.uint64) * M4))

    @staticmethod
    def room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, found: list[list[int]]) -> np.ndarray:
        """Entry numbers of new encodings."""
        return self.append(np.array([len(x) for x in found], np.int32), np.array([i for x in found for i in x], np.int32))

    def append(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n = self.n + len(counts)
        self.offs, self.counts, self.hits = self.room(self.offs, n), self.room(self.counts, n), self.room(self.hits, n)
        self.ids = self.room(self.ids, self.n_ids + len(ids))
        self.counts[self.n : n] = counts
        self.offs[self.n : n] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        new = np.arange(self.n, n)
        self.n, self.n_ids = n, self.n_ids + len(ids)
        return new

    def place(self, k: np.ndarray, lens: np.ndarray, slot: np.ndarray, vals: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        todo = np.arange(len(vals))
        while len(todo):
            free = todo[self.vals[slot[todo]] < 0]
            _, lead = np.unique(slot[free], return_index=True)
            won = free[lead]
            self.keys[:, slot[won]] = k[:, won]
            self.lens[slot[won]] = lens[won]
            self.vals[slot[won]] = vals[won]
            rest = np.ones(len(vals), bool)
            rest[won] = False
            todo = todo[rest[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def entries(self, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry number of each pre-token."""
        if self.n - len(self.long) > self.most or len(self.long) > self.most // 6:
            self.trim()
        out = np.full(len(begins), -1, np.int32)
        lens = ends - begins
        mask = U((1 << self.bits) - 1)
        short = np.flatnonzero(lens <= self.WIDTH)
        if len(short):
            win, size = windows8(buf), lens[short]
            b = begins[short]
            k = np.stack([win[b] & KEEP[np.minimum(size, 8)], win[b + 8] & KEEP[np.clip(size - 8, 0, 8)], win[b + 16] & KEEP[np.clip(size - 16, 0, 8)]])
            slot = (self.hashed(k, size) & mask).astype(np.int64)
            got = np.full(len(short), -1, np.int32)
            todo, missing = np.arange(len(short)), []
            while len(todo):
                s = slot[todo]
                v = self.vals[s]
                empty = v < 0
                same = ~empty & (self.keys[0, s] == k[0, todo]) & (self.keys[1, s] == k[1, todo]) & (self.keys[2, s] == k[2, todo]) & (self.lens[s] == size[todo])
                got[todo[same]] = v[same]
                missing.append(todo[empty])
                todo = todo[~empty & ~same]
                slot[todo] = (slot[todo] + 1) & int(mask)
            miss = np.concatenate(missing) if missing else np.zeros(0, np.int64)
            if len(miss):
                order = miss[np.lexsort((size[miss], k[2, miss], k[1, miss], k[0, miss]))]
                new = np.ones(len(order), bool)
                new[1:] = (k[:, order[1:]] != k[:, order[:-1]]).any(0) | (size[order[1:]] != size[order[:-1]])
                lead = order[new]
                raw = buf.tobytes()
                vals = self.add(self.encode([raw[x:y] for x, y in zip((b[lead]).tolist(), (b[lead] + size[lead]).tolist())])).astype(np.int32)
                got[order] = vals[np.cumsum(new) - 1]
                self.place(k[:, lead], size[lead], slot[lead].copy(), vals)
            out[short] = got
        far = np.flatnonzero(lens > self.WIDTH)
        if len(far):
            raw = buf.tobytes()
            words = [raw[x:y] for x, y in zip(begins[far].tolist(), ends[far].tolist())]
            fresh = [w for w in dict.fromkeys(words) if w not in self.long]
            if fresh:
                self.long.update(zip(fresh, self.add(self.encode(fresh)).tolist()))
            out[far] = [self.long[w] for w in words]
        np.add.at(self.hits, out, 1)
        return out

    def spread(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these entries in order, and the place of each entry's first id (one more at the end)."""
        counts = self.counts[entries].astype(np.int64)
        begin = np.zeros(len(entries) + 1, np.int64)
        np.cumsum(counts, out=begin[1:])
        return self.ids[np.repeat(self.offs[entries] - begin[:-1], counts) + np.arange(begin[-1])], begin
