"""Packing of documents into sequences of a fixed number of tokens, by non-negative least squares over the length histogram.

1. Every text is encoded, with an end id, and stored as bytes of fixed width. Whole windows of a long document are sequences of their own; what is
   left of each document is its remainder, of 1 to window - 1 tokens.
2. The remainders' lengths are counted: window - 1 numbers at most, whatever the input.
3. All combinations of two or three lengths that fill a window exactly are enumerated. Non-negative least squares finds how often to
   repeat each so that the lengths used match the histogram; the counts are rounded and held within the supply.
4. Remainders get places by their rank among those of their length. Ranks come from counts by file and length, so no task sees all
   remainders of a common length.
5. Remainders beyond the plan are packed greedily: one after another, cut where a window is full. The last window's
   rest is split into sequences whose lengths are powers of two, which need no padding.

Null or empty texts have one token, the end id. Rows that repeat are packed each. Very long texts are whole windows and a remainder. Special
strings of the vocabulary in a text are read as the library reads them by default. An empty table gives no pieces. Further columns are
ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, stored, texts_of, tidy
from .encoders import encoder

STORE = "part int, row long, doc_id long, n_tokens long, n_full long, full_before long, rem int, rem_rank long, crcs array<long>, tokens binary"
STORE_ARROW = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_full", pa.int64()), ("full_before", pa.int64()), ("rem", pa.int32()), ("rem_rank", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tokens", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, row long"
PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def id_width(vocabulary: str) -> int:
    """Bytes that hold any id of the vocabulary file."""
    with open(vocabulary, encoding="utf-8") as f:
        known = json.load(f)
    most = max([*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", []))])
    return 2 if most < 1 << 16 else 4


def encode_store(docs: DataFrame, vocabulary: str, end: int, window: int) -> DataFrame:
    """One row a document: its ids, the checksum of each whole window and of the remainder, ranks within its task."""
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary, "plain")
        row, full, seen = 0, 0, np.zeros(window, np.int64)
        for batch in chunks(batches):
            ids, place = encode(batch.column("text"), end)
            n = np.diff(place)
            n_full, rem = n // window, n % window
            view = memoryview(ids.astype("<u4")).cast("B")
            crcs = [[zlib.crc32(view[4 * i : 4 * min(i + window, b)]) for i in range(a, b, window)] for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
            order = np.argsort(rem, kind="stable")
            run_start = np.searchsorted(rem[order], rem[order])
            rank = np.empty(len(n), np.int64)
            rank[order] = seen[rem[order]] + np.arange(len(n)) - run_start
            np.add.at(seen, rem, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(row + np.arange(len(n))),
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array(n_full),
                    pa.array(full + np.cumsum(n_full) - n_full),
                    pa.array(rem.astype(np.int32)),
                    pa.array(rank),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((place * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))]),
                ],
                schema=STORE_ARROW,
            )
            row, full = row + len(n), full + int(n_full.sum())

    return stored(texts_of(docs).mapInArrow(tidy(run), STORE), "packing", compression="zstd", **{"parquet.enable.dictionary": "false"})


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of these lengths that fill the window, one a row; the third of a pair is 0."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = []
    pair = lengths[lengths <= window // 2]
    pair = pair[have[window - pair]]
    found.append(np.stack([pair, window - pair, np.zeros_like(pair)], 1))
    for a in lengths[lengths <= window // 3].tolist():
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[have[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def solve(histogram: np.ndarray, window: int, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often to use each, so that no length is used more often than it occurs.

    Accelerated projected gradient on |A x - h|^2 with x >= 0; A has two or three entries a column, so it is never built.
    """
    combos = combinations(np.flatnonzero(histogram).astype(np.int64), window)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    target = histogram.astype(float)
    target[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        u = sum(np.bincount(combos[:, k], weights=x, minlength=window) for k in range(3))[:window]
        u[0] = 0
        return u

    def gradient(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.ones(len(combos))
    for _ in range(12):
        v = gradient(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * gradient(used(y) - target))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    counts = np.floor(x).astype(np.int64)
    supply = histogram.astype(np.int64).copy()
    supply[0] = 1 << 60
    rows = combos.tolist()
    for whole in (True, False):  # first the whole parts, then what the supply still holds, largest fractions first
        order = np.flatnonzero(counts) if whole else np.argsort(counts - x, kind="stable")
        want = counts.tolist()
        for i in order.tolist():
            a, b, c = rows[i]
            if not (supply[a] and supply[b] and supply[c]):
                if whole:
                    counts[i] = 0
                continue
            most = min(supply[k] // (a, b, c).count(k) for k in (a, b, c) if k)
            take = min(most, want[i]) if whole else most
            for k in (a, b, c):
                if k:
                    supply[k] -= take
            counts[i] = take if whole else counts[i] + take
    keep = counts > 0
    return combos[keep], counts[keep]


class Plan:
    """Where the remainders of each length go: by rank, first to the first combination that uses the length, and so on."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.combos, self.counts = solve(histogram, window)
        self.first = np.cumsum(self.counts) - self.counts
        self.sequences = int(self.counts.sum())
        k = np.repeat(np.arange(len(self.combos)), 3)
        slot = np.tile(np.arange(3), len(self.combos))
        length = self.combos.reshape(-1)
        offset = (np.cumsum(self.combos, 1) - self.combos).reshape(-1)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        self.combo, self.offset, self.length = k[order], offset[order], length[order]
        size = self.counts[self.combo]
        total = np.cumsum(size) - size
        self.at = np.searchsorted(self.length, np.arange(window + 1))  # first interval of each length
        self.begin = total - np.append(total, 0)[np.minimum(self.at[self.length], len(total))] if len(total) else total
        self.planned = np.bincount(self.length, weights=size, minlength=window).astype(np.int64)[:window]
        #: Length and rank as one ascending key.
        self.key = self.length.astype(np.int64) << 44 | self.begin

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (from 0) and offset of remainders that are planned."""
        i = np.searchsorted(self.key, length.astype(np.int64) << 44 | rank, side="right") - 1
        return self.first[self.combo[i]] + rank - self.begin[i], self.offset[i]


def with_before(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """By part (and the keys), the sum of `value` over the parts before: rows are as many as files, not documents."""
    over = Window.partitionBy(*keys).orderBy("part") if keys else Window.orderBy("part")
    return df.withColumn(name, F.sum(value).over(over) - F.col(value)).drop(value)


def pack(docs: DataFrame, vocabulary: str, end: int, window: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The pieces (one row each) and the store of ids that they refer to by part and row: a doc_id may be null or repeat."""
    store, width = encode_store(docs, vocabulary, end, window), id_width(vocabulary)
    meta = store.drop("tokens")
    lengths = meta.groupBy("part", "rem").agg(F.count("*").alias("n"), F.sum("n_full").alias("full"))
    lengths = stored(lengths, "packing-lengths")
    histogram = np.zeros(window, np.int64)
    n_full = 0
    for rem, n, full in lengths.groupBy("rem").agg(F.sum("n"), F.sum("full")).collect():  # window rows at most
        histogram[rem] = n
        n_full += full
    histogram[0] = 0
    plan = Plan(histogram, window)
    ranks = with_before(lengths.select("part", "rem", "n"), ["rem"], "n", "rank_base")
    fulls = with_before(lengths.groupBy("part").agg(F.sum("full").alias("full")), [], "full", "full_base")
    placed = meta.join(ranks, ["part", "rem"]).join(fulls, "part").withColumn("rank", F.col("rank_base") + F.col("rem_rank"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("part", "row", "n_tokens", "n_full", "full_before", "full_base", "rem", "rank")}
            doc = batch.column("doc_id")
            crcs = batch.column("crcs").flatten().to_numpy()
            n_pieces = c["n_full"] + (c["rem"] > 0)
            last = np.cumsum(n_pieces) - 1
            row = np.repeat(np.arange(len(n_pieces)), n_pieces)
            nth = np.arange(len(row)) - np.repeat(last + 1 - n_pieces, n_pieces)
            whole = nth < c["n_full"][row]
            seq = c["full_base"][row] + c["full_before"][row] + nth
            off = np.zeros(len(row), np.int64)
            rem, rank = c["rem"][row], c["rank"][row]
            left = ~whole & (rank < plan.planned[rem])
            if left.any():
                s, o = plan.places(rem[left], rank[left])
                seq[left], off[left] = n_full + s, o
            keep = whole | left
            row, nth = row[keep], nth[keep]
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)), pa.array(nth * window), pa.array(np.where(whole[keep], window, rem[keep]).astype(np.int64)), pa.array(crcs[keep]), pa.array(c["n_tokens"][row]), pa.array(seq[keep]), pa.array(off[keep]), pa.array(c["part"][row].astype(np.int64)), pa.array(c["row"][row])],
                schema=PIECES_ARROW,
            )

    pieces = placed.mapInArrow(tidy(places), PIECES)
    planned = F.create_map(*[F.lit(int(x)) for k in np.flatnonzero(plan.planned).tolist() for x in (k, plan.planned[k])]) if plan.planned.any() else None
    beyond = placed.filter(F.col("rem") > 0)
    if planned is not None:
        beyond = beyond.filter(F.col("rank") >= F.coalesce(F.try_element_at(planned, F.col("rem")), F.lit(0)).cast("long"))
    total = int((np.arange(window) * (histogram - plan.planned)).sum())
    if not total:
        return pieces, store
    beyond = stored(beyond.select("part", "row", "rem"), "packing-beyond")
    bases = with_before(beyond.groupBy("part").agg(F.sum("rem").alias("size")), [], "size", "base")
    running = F.sum("rem").over(Window.partitionBy("part").orderBy("row")) - F.col("rem")
    stream = beyond.withColumn("pos", running).join(bases, "part").select("part", "row", (F.col("pos") + F.col("base")).alias("pos"))
    tail, ends = total // window * window, []
    for bit in range(window.bit_length(), -1, -1):
        if total - tail & 1 << bit:
            ends.append((ends[-1] if ends else tail) + (1 << bit))
    first_seq = n_full + plan.sequences

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, row, doc, n, rem, pos, ids in zip(*(batch.column(k).to_pylist() for k in ("part", "row", "doc_id", "n_tokens", "rem", "pos")), batch.column("tokens")):
                ids = np.frombuffer(ids.as_py(), f"<u{width}").astype("<u4")
                at = pos
                while at < pos + rem:
                    if at < tail:
                        seq, begin, stop = at // window, at // window * window, (at // window + 1) * window
                    else:
                        k = int(np.searchsorted(ends, at, side="right"))
                        seq, begin, stop = tail // window + k, ends[k - 1] if k else tail, ends[k]
                    stop = min(stop, pos + rem)
                    rows.append((doc, n - rem + at - pos, stop - at, zlib.crc32(ids[at - pos : stop - pos].tobytes()), n, first_seq + seq, at - begin, part, row))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(PIECES_ARROW))], schema=PIECES_ARROW)

    some = np.flatnonzero(histogram > plan.planned).tolist()  # lengths of which not all are planned: window - 1 at most
    rest = store.filter(F.col("rem").isin(some)).select("part", "row", "doc_id", "n_tokens", "rem", F.expr(f"substring(tokens, cast((n_tokens - rem) * {width} + 1 as int), rem * {width})").alias("tokens")).join(stream.hint("merge"), ["part", "row"])  # alike at every size
    return pieces.unionByName(rest.mapInArrow(tidy(cut), PIECES)), store


def sequences(pieces: DataFrame, store: DataFrame, vocabulary: str) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves; each gathers one window of tokens at most."""
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), f"<u{width}").astype(np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    cut = F.expr(f"substring(tokens, cast(start * {width} + 1 as int), cast(length * {width} as int))").alias("ids")
    parts = pieces.join(store.select("part", "row", "tokens"), ["part", "row"]).select("sequence_id", F.struct("offset", cut).alias("piece"))
    whole = parts.groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"]).alias("ids"))
    return whole.mapInArrow(tidy(run), "sequence_id long, ids array<int>")
