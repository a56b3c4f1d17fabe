"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (3, 4 and 5 bytes, word ends marked), so a misspelling that was never
seen shares most of its word's vectors. A bag is a run of `BAG` words; its mean vector goes through a linear softmax. A
document is as toxic as its most toxic bag: few insults in a long text count as in a short one. Vectors and softmax are trained
together, each document teaching through one bag a round: drawn by the softmax of bags' margins while the rounds cool, as no bag is known to
be the insult at first, then the leading one. The margin is calibrated on a fold kept apart.

Learning uses a sample of labelled rows bounded by `max_rows`, in one task; labels, language, source and doc_id are no inputs. Null or
empty texts get the score of a text without words, the lowest. Labels that are null or have no document are left out; without labels of
both classes, with fewer than 20 labelled rows or none with a word, all scores are 0. Rows that repeat are scored each. Very long texts are scored as a whole. A score of exactly the
threshold counts as toxic. An empty table gives no rows. Further columns are ignored by `score`, and returned as they are by `keep`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEEP, LOWER, M1, M2, U, chunks, flat, gathered, texts_of, tidy, windows8

BITS, ORDERS, BAG, DIM = 17, (3, 4, 5), 3, 12
#: The share of toxic documents at which scores are calibrated: above the corpus's own, as a miss costs more than a false alarm.
PRIOR = 0.25
#: Bags are drawn at this heat at first, at none after this share of the rounds; a round draws about so many bags, if the texts are fewer.
HEAT, HEATED, PULLS = 5.0, 0.7, 1500
#: A-Z in lower case; bytes that are neither letters, digits nor part of a longer character end a word.
FOLD = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        FOLD[_b] = 32


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams from each byte on, by order; starts and ends of words; the first word's number by row (one more at the end)."""
    buf, offsets = flat(pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " "))  # a space after each text
    padded = np.empty(len(buf) + 1, np.uint8)
    padded[0] = 32
    padded[1:] = FOLD[buf]
    offsets = offsets + 1
    n = int(offsets[-1])
    inside = padded[:n] != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    win = windows8(padded)
    buckets = []
    for order in ORDERS:
        h = ((win[:n] & KEEP[order]) + U(order)) * M1
        buckets.append((((h ^ (h >> U(31))) * M2) >> U(64 - BITS)).astype(np.int32))
    return buckets, starts, ends, np.searchsorted(starts, offsets)


def word_scores(scalar: np.ndarray, buckets: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean of its n-grams' scores for each word; an n-gram may take in the space before and after."""
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for order, b in zip(ORDERS, buckets):
        run = np.zeros(len(b) + 1)
        np.cumsum(scalar[b], out=run[1:])
        upto = np.maximum(ends + 2 - order, starts - 1)
        total += run[upto] - run[starts - 1]
        count += upto - (starts - 1)
    return total / np.maximum(count, 1)


def bag_means(scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean over the bag from each word on; it ends with its row. Also each word's row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.arange(len(scores))
    stop = np.minimum(at + BAG, first[1:][row])
    return (run[stop] - run[at]) / BAG, row


@dataclass
class Model:
    scalar: np.ndarray  #: each bucket's vector, seen by the difference of the two softmax rows
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        buckets, starts, ends, first = grams(texts)
        best = np.full(len(first) - 1, -30.0)
        if len(starts):
            bags, row = bag_means(word_scores(self.scalar, buckets, starts, ends), first)
            np.maximum.at(best, row, bags)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))


def fit(texts: pa.Array, y: np.ndarray, share: float, rounds: int = 160, rate: float = 0.05, seed: int = 7) -> Model:
    """Vectors and softmax by Adam on drawn, then on leading bags of each text; every fifth text of a class is kept for the calibration.

    share: of rows with label 1 where the model is to be used.
    """
    _, starts, ends, first = grams(texts)
    flat_text = FOLD[flat(pc.binary_join_element_wise(texts, "", " "))[0]].tobytes()
    words = [flat_text[a - 1 : b - 1] for a, b in zip(starts.tolist(), ends.tolist())]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    word = np.array([ids[w] for w in words], np.int64)
    buckets, s, e, _ = grams(pa.array([" ".join(w.decode("utf-8") for w in ids)]))
    seg = [np.concatenate([b[i : max(j, i)] for b, j in zip(buckets, (x + 2 - np.array(ORDERS)).tolist())]) for i, x in zip((s - 1).tolist(), e)]
    counts = np.array([len(x) for x in seg])
    gram, begin = np.concatenate(seg), np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vec, soft, bias)]
    apart = np.zeros(len(y), bool)
    for kind in (0, 1):
        apart[np.flatnonzero(y == kind)[4::5]] = True
    row_of = np.repeat(np.arange(len(y)), np.diff(first))
    filled = np.flatnonzero(np.diff(first))
    length = np.diff(first)[filled]

    def leading(scalar: np.ndarray, heat: float = 0.0, draws: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Bags of each text and their means: the highest one, or with heat so many, drawn by the softmax of means / heat."""
        bags, _ = bag_means((np.add.reduceat(scalar[gram], begin[:-1]) / counts)[word], first)
        tops = []
        for _ in range(draws):
            order = bags - heat * np.log(rng.exponential(size=len(bags))) if heat else bags
            at = np.flatnonzero(order == np.repeat(np.maximum.reduceat(order, first[filled]), length))
            tops.append(at[np.unique(row_of[at], return_index=True)[1]])
        top = np.concatenate(tops)
        return top, bags[top]

    n_bag, draws = np.arange(BAG), max(round(PULLS / max(len(filled), 1)), 1)
    for t in range(1, rounds + 1):
        heat = max(HEAT * (1 - t / (HEATED * rounds)), 0.0)
        top, _ = leading(vec @ (soft[:, 1] - soft[:, 0]), heat, draws if heat else 1)
        rows = row_of[top]
        use = ~apart[rows] & (rng.random(len(rows)) < 0.7)
        top, rows = top[use], rows[use]
        if t % 3 == 0 or t < 25:  # any bag of a clean text is clean
            more = rng.integers(0, len(word), 2 * len(top))
            more = more[(y[row_of[more]] == 0) & ~apart[row_of[more]]]
            top, rows = np.concatenate([top, more]), np.concatenate([rows, row_of[more]])
        at = top[:, None] + n_bag
        live = at < first[1:][rows][:, None]
        w = word[np.minimum(at, len(word) - 1)][live]
        bag = np.repeat(np.arange(len(top)), BAG).reshape(at.shape)[live]
        n = counts[w]
        place = np.repeat(begin[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g, coef, owner = gram[place], np.repeat(1 / (BAG * n), n).astype(np.float32), np.repeat(bag, n)
        ends_of = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        run = np.add.reduceat(vec[g] * coef[:, None], np.concatenate([[0], ends_of[:-1] + 1]), axis=0)
        z = run @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows].astype(int)] -= 1
        p /= len(rows)
        d_soft, d_bias, d_bag = run.T @ p, p.sum(0), p @ soft.T
        hit, back = np.unique(g, return_inverse=True)
        d_vec = np.zeros((len(hit), DIM), np.float32)
        pull = d_bag[owner] * coef[:, None]
        for k in range(DIM):
            d_vec[:, k] = np.bincount(back, weights=pull[:, k], minlength=len(hit))
        d_vec += 1e-6 * vec[hit]
        for p_, g_, (m1, m2), where in ((vec, d_vec, moments[0], hit), (soft, d_soft, moments[1], slice(None)), (bias, d_bias, moments[2], slice(None))):
            m1[where] = 0.9 * m1[where] + 0.1 * g_
            m2[where] = 0.99 * m2[where] + 0.01 * g_ * g_
            p_[where] -= rate * (m1[where] / (1 - 0.9**t)) / (np.sqrt(m2[where] / (1 - 0.99**t)) + 1e-7)
    met = np.zeros(1 << BITS, bool)
    met[gram] = True
    scalar = np.where(met, vec @ (soft[:, 1] - soft[:, 0]), 0).astype(np.float64)  # unseen n-grams say nothing
    top, best = leading(scalar)
    z = np.full(len(y), best.min())
    z[row_of[top]] = best
    z, label = z[apart], y[apart]
    centre, spread = z.mean(), max(z.std(), 1e-6)
    z = (z - centre) / spread
    odds = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(400):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s_ = odds * (q - label), odds * q * (1 - q) + 1e-6
        grad = np.array([(r * z).mean() + 1e-4 * a, r.mean()])
        hess = np.array([[(s_ * z * z).mean() + 1e-4, (s_ * z).mean()], [(s_ * z).mean(), s_.mean()]])
        step = np.linalg.solve(hess + 1e-4 * np.eye(2), grad)
        a, b = max(a - 0.5 * step[0], 1e-3), b - 0.5 * step[1]  # a higher margin is never a lower score
    return Model(scalar, float(a / spread), float(b - a * centre / spread))


def held_out(doc_id: str | None) -> bool:
    return zlib.crc32(("" if doc_id is None else doc_id).encode()) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> Model | None:
    """Learns from rows whose crc32(doc_id as text) mod 3 isn't 1. max_rows: the most rows that the fit uses, half of each class, in the order of a hash of doc_id."""
    # the rows of the sample, max_rows at most, meet in one task, which fits the model; the driver gets the n-grams' numbers alone
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1) and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) != 1").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    by_hash = F.xxhash64("doc_id")
    sample = known.filter("toxic = 0").orderBy(by_hash).limit(max_rows // 2).unionAll(known.filter("toxic = 1").orderBy(by_hash).limit(max_rows // 2))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        ids = rows["doc_id"].to_numpy()
        order = np.lexsort((ids, [zlib.crc32(b"%d" % i) for i in ids.tolist()]))
        y = rows["toxic"].to_numpy()[order].astype(np.float32)
        texts = rows["text"].combine_chunks().take(pa.array(order))
        if len(set(y.tolist())) < 2 or len(y) < 20 or not len(grams(texts)[1]):
            return
        model = fit(texts, y, PRIOR)
        yield pa.RecordBatch.from_arrays([pa.array([model.scalar], pa.list_(pa.float64())), pa.array([model.slope]), pa.array([model.shift])], names=["scalar", "slope", "shift"])

    once = texts_of(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = once.repartition(1).mapInArrow(tidy(learn), "scalar array<double>, slope double, shift double").collect()
    return Model(np.array(found[0]["scalar"]), found[0]["slope"], found[0]["shift"]) if found else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = np.zeros(batch.num_rows) if model is None else model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, score double")


def keep(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The documents that score below the threshold, with the table's own columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch if model is None else batch.filter(pa.array(model.scores(batch.column("text")) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
