"""Byte-level BPE by the ranks of a vocabulary file.

Encoding has two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole. The rest
are merged pair by pair: the bytes form a linked list, and a heap gives the adjacent pair of lowest rank, the leftmost first. What a
worker has resolved it keeps in a bounded memo. Decoding concatenates the tokens' bytes.

The split is that of the vocabulary's published pattern: contractions, words and numbers with the space before them, other runs, white space. It is done for a
batch at a time in numpy, by the classes (letter, number, white space, other) of its characters. Classes that could differ
between Unicode versions are asked of the tiktoken library, character by character.

Null or empty texts give no ids (n_tokens 0, both digests those of no bytes). Very long texts are encoded as a whole. Rows that repeat are
kept. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import M1, M2, M4, U, chunks, flat, hash_ranges, mix, texts_of
from .pretokens import BLANK, LETTER, NUMBER, OTHER, Memo, split


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, one small seed for each bucket of about 4 keys.

    Each slot holds its key, so that bytes outside the vocabulary are told apart for certain.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        buckets = self.n // 4 + 1
        h = self.hashes(keys)
        where = (h % U(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(where, minlength=buckets))[:-1])
        self.seeds, slots, taken = np.zeros(buckets, np.uint32), np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
            g = groups[b]
            if not len(g):
                continue
            for low in range(0, 1 << 24, 256):  # seeds are tried 256 at a time
                seeds = np.arange(low, low + 256, dtype=np.uint64)
                to = (mix(h[g][None, :] + seeds[:, None] * M1) % U(self.n)).astype(np.int64)
                good = ~taken[to].any(1)
                if len(g) > 1:
                    s = np.sort(to, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.seeds[b], slots[g] = low + k, to[k]
                    taken[to[k]] = True
                    break
            else:
                raise ValueError("no seed found for a bucket")
        self.slot_key: list[bytes] = [b""] * self.n
        self.slot_of = slots
        for i, s in enumerate(slots.tolist()):
            self.slot_key[s] = keys[i]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        buf = np.frombuffer(b"".join(keys) + b"\0" * 32, np.uint8)
        lens = np.array([len(k) for k in keys], np.int64)
        return hash_ranges(buf, np.cumsum(lens) - lens, lens)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Each key's slot, or -1 if it isn't among the keys."""
        h = self.hashes(keys)
        to = (mix(h + self.seeds[(h % U(len(self.seeds))).astype(np.int64)].astype(np.uint64) * M1) % U(self.n)).astype(np.int64)
        held = self.slot_key
        return np.array([s if held[s] == k else -1 for s, k in zip(to.tolist(), keys)], np.int64)


class Bpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_id = np.zeros(len(keys), np.int64)
        self.slot_id[self.hash.slot_of] = [ranks[k] for k in keys]
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, i in ranks.items():
            self.bytes[i] = k
        self.text = [str(i) for i in range(len(self.bytes))]
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: (left id, right id) as one number -> id of the two joined; a pair may be cut from a token at any place.
        self.pairs = {ranks[k[:c]] << 20 | ranks[k[c:]]: i for k, i in ranks.items() for c in range(1, len(k)) if k[:c] in ranks and k[c:] in ranks}
        self.memo = Memo(self.encode_words)
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        self.probes = [(kind, tiktoken.Encoding("probe", pat_str=p, mergeable_ranks=single, special_tokens={})) for kind, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s"))]
        self.class_of: dict[int, int] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the adjacent pair of lowest rank is joined first, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        n, get = len(ids), self.pairs.get
        heap = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            a = ids[i]
            if a < 0 or (j := after[i]) >= n or get(a << 20 | ids[j]) != rank:
                continue  # one of the two has gone into another token
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 20 | ids[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := get(ids[p] << 20 | rank)) is not None:
                heappush(heap, r << 32 | p)
        return [i for i in ids if i >= 0]

    def classes(self, points: np.ndarray) -> np.ndarray:
        """The classes of code points by the tables of the tiktoken library: which of three expressions finds the character."""
        for c in set(points.tolist()) - self.class_of.keys():
            self.class_of[c] = next((kind for kind, probe in self.probes if probe.encode_ordinary(chr(c))), OTHER)
        return np.array([self.class_of[c] for c in points.tolist()], np.uint8)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        slots = self.hash.slots(words)
        ids = self.slot_id[slots]
        return [[i] if s >= 0 else self.merge(w) for s, i, w in zip(slots.tolist(), ids.tolist(), words)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the place of each text's first id (one more at the end)."""
        buf, offsets = flat(texts)
        begins, ends, first, _ = split(buf, offsets, "spaced", self.classes)
        ids, place = self.memo.spread(self.memo.entries(buf, begins, ends))
        return ids, place[first]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    """One for each Python worker, kept between tasks."""
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>): no shuffle, each batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in chunks(batches):
            ids, place = coder.encode_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, bytes (binary) of encoded ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        text, piece = coder.text.__getitem__, coder.bytes.__getitem__
        for batch in chunks(batches):
            ids, place = coder.encode_batch(batch.column("text"))
            ids, cuts = ids.tolist(), place.tolist()
            rows = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(place).astype(np.int64)),
                    pa.array([hashlib.sha256(",".join(map(text, r)).encode()).hexdigest() for r in rows]),
                    pa.array([hashlib.sha256(b"".join(map(piece, r))).hexdigest() for r in rows]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
