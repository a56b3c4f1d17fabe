"""Quality rules: counts of words, symbols, repeated lines and repeated passages, and a calibrated classifier.

The classifier is a logistic regression on hashed n-grams of the whole text: one and two words, three and four characters. It is trained
on labelled rows (a sample bounded by `max_rows`, the classes in equal parts) in one task, its probability is calibrated on margins of rows
that the fit behind them hasn't seen, with weights that restore the classes' shares, and documents are scored in Arrow batches against fixed thresholds.

Null or empty texts have no words and fail the base rule. Documents without a label are scored like others; labels without a document,
with a null or repeated label are left out of training or count once each. With fewer than LEAST labelled documents of either class every document
that passes the base rule is kept. A probability of exactly the threshold keeps a document. Rows that repeat are scored each. Very long texts are counted
and scored as a whole. An empty table gives no rows. Further columns are ignored by `score`, and returned as they are by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, M3, U, WORD, chunks, flat, gathered, give_back, hash_ranges, mix, texts_of, tidy, word_ranges

#: Hash buckets of each of the four families of n-grams.
BUCKETS, FAMILIES = 1 << 12, 4
#: Variance of the prior of the weights (of rows of length 1) and of the bias.
PRIOR, BIAS_PRIOR = 100.0, 10.0
#: Labelled rows of each class that a classifier needs; with fewer the base rules decide alone.
LEAST = 10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(bounds: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """True for each key that equals another one; the keys' sorted order, and where in it a key equals the one before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out, order, same


def measures(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    rows, size = len(offsets) - 1, int(offsets[-1])
    raw = buf[:size]
    inside = WORD[raw]
    starts, lengths, first = word_ranges(buf, offsets, WORD)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": sums(inside & ((raw & 0xC0) != 0x80), offsets), "n_symbols": sums(SYMBOLS[raw], offsets)}
    # lines: from each text's start or the place after a \n to the next of these
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    cut[1:][raw == 10] = True
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], size)
    begin, stop = begin[begin < size], stop[begin < size]
    words_upto = np.zeros(size + 1, np.int64)
    np.cumsum(inside, out=words_upto[1:])
    some = words_upto[stop] > words_upto[begin]
    begin, stop = begin[some], stop[some]
    stop = stop - (raw[stop - 1] == 10)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    _, order, same = alike(hash_ranges(buf, begin, stop - begin) + doc.astype(np.uint64) * M2)
    out["n_dup_lines"] = np.bincount(doc[order[1:]][same], minlength=rows)
    # windows of five words
    h = hash_ranges(buf, starts, lengths)
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(h) >= 5:
        w = np.zeros(len(h) - 4, np.uint64)
        for k in range(5):
            w = (w ^ h[k : len(h) - 4 + k]) * M1 + U(k)
        doc = row_of(first, len(h))
        at = np.flatnonzero(doc[:-4] == doc[4:])
        twice, _, _ = alike(mix(w[at]) + doc[at].astype(np.uint64) * M3)
        np.add.at(cover, at[twice], 1)
        np.subtract.at(cover, at[twice] + 5, 1)
    out["n_repeat_words"] = sums(np.cumsum(cover[:-1]) > 0, first)
    return out | {"hashes": h, "first": first}


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows, and each row's first one (one more at the end)."""
    raw = buf[: int(offsets[-1])]
    lead = (raw & 0xC0) != 0x80
    if lead.all():
        return raw.astype(np.uint64), offsets
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64), before[offsets]


def families(buf: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of one family after another, its row bounds, and the places of n-grams that would reach over a text's end."""
    shift = U(64 - BUCKETS.bit_length() + 1)

    def over(bounds: np.ndarray, n: int) -> np.ndarray:
        bad = np.unique(np.concatenate([bounds[1:] - k for k in range(1, n)]))
        return bad[bad >= 0]

    yield (hashes * M1 >> shift).astype(np.int64), first, np.zeros(0, np.int64)
    after = np.append(hashes[1:], U(0))[: len(hashes)]
    yield (mix(hashes * M3 ^ after) * M1 >> shift).astype(np.int64), first, over(first, 2)
    chars, bounds = characters(buf, offsets)
    padded = np.append(chars, np.zeros(3, np.uint64))
    n = len(chars)
    three = chars | padded[1 : n + 1] << U(21) | padded[2 : n + 2] << U(42)  # 21 bits hold a code point
    for size, grams in ((3, three * M1), (4, (three * M3 ^ padded[3 : n + 3]) * M1)):
        yield ((grams ^ (grams >> U(29))) * M2 >> shift).astype(np.int64), bounds, over(bounds, size)


@dataclass
class Model:
    """Weights by family and bucket; slope and intercept of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, buf: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        logit = np.full(len(offsets) - 1, self.bias)
        for f, (bucket, bounds, bad) in enumerate(families(buf, offsets, hashes, first)):
            w = self.weights[f][bucket]
            n = np.diff(bounds).astype(float)
            w[bad] = 0
            total = np.zeros(len(w) + 1)
            np.cumsum(w, out=total[1:])
            logit += (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))


def vectors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense rows: shares of each bucket, the families side by side."""
    m = measures(buf, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, FAMILIES * BUCKETS), np.float32)
    for f, (bucket, bounds, bad) in enumerate(families(buf, offsets, m["hashes"], m["first"])):
        weight = np.ones(len(bucket))
        weight[bad] = 0
        n = np.maximum(np.diff(bounds), 1)
        key = row_of(bounds, len(bucket)) * BUCKETS + bucket
        out[:, f * BUCKETS : (f + 1) * BUCKETS] = (np.bincount(key, weights=weight, minlength=rows * BUCKETS).reshape(rows, BUCKETS) / n[:, None]).astype(np.float32)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_loss(z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log loss of margins z against targets t, which may lie between 0 and 1."""
    return float((weight * (np.logaddexp(0, z) - t * z)).sum())


def calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (never negative: a higher margin is never a lower probability) and shift that make margins probabilities.

    share: of label 1 in use; the classes are weighted to it. Margins are standardised, targets are smoothed by a row of each class, the slope
    has a prior around that of the margins themselves, and a Newton step is halved until the loss falls, so it cannot run away.
    """
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    centre, spread = float(z.mean()), float(z.std()) + 1e-9
    x = (z - centre) / spread
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share * len(y) / n1, (1 - share) * len(y) / n0)

    def loss(c: np.ndarray) -> float:
        return log_loss(c[0] * x + c[1], t, weight) + 0.5 * (c[0] - spread) ** 2 / max(spread, 1.0) ** 2

    now = np.array([spread, float(np.log(share / (1 - share)))])
    for _ in range(100):
        p = sigmoid(now[0] * x + now[1])
        r, s = weight * (p - t), weight * p * (1 - p)
        grad = np.array([(r * x).sum() + (now[0] - spread) / max(spread, 1.0) ** 2, r.sum()])
        hess = np.array([[(s * x * x).sum() + 1 / max(spread, 1.0) ** 2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step, was = np.linalg.solve(hess, grad), loss(now)
        size = 1.0
        while size > 1e-6 and not loss(now - size * step) < was:
            size /= 2
        if size <= 1e-6:
            break
        now = now - size * step
    slope = max(float(now[0]), 1e-3) / spread
    return slope, float(now[1]) - slope * centre


def dual_fit(gram: np.ndarray, y: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """Coefficients of the rows and bias of a logistic regression whose weights have a normal prior of variance `prior`.

    gram: the rows' inner products. Newton's method on the rows' coefficients, each step halved until the posterior rises: the
    problem is strictly concave, so every machine ends at the same place.
    """
    k = prior * gram + BIAS_PRIOR
    a, f, best = np.zeros(len(y)), np.zeros(len(y)), -len(y) * np.log(2)
    for _ in range(60):
        p = sigmoid(f)
        root = np.sqrt(np.maximum(p * (1 - p), 1e-10))
        b = root * root * f + y - p
        goal = b - root * np.linalg.solve(np.eye(len(y)) + root[:, None] * k * root, root * (k @ b))
        step, size = goal - a, 1.0
        while size > 1e-4:
            new = a + size * step
            new_f = k @ new
            value = -log_loss(new_f, y, np.ones(len(y))) - 0.5 * float(new @ new_f)
            if value >= best:
                break
            size /= 2
        if size <= 1e-4:
            break
        gain, best, a, f = value - best, value, new, new_f
        if gain < 1e-9 * len(y):
            break
    return prior * a, BIAS_PRIOR * float(a.sum())


def fit(a: np.ndarray, y: np.ndarray, share: float, folds: int = 4) -> Model:
    """Logistic regression on rows `a` with labels `y`, and its calibration on margins of rows that the fit behind them hasn't seen.

    share: of rows with label 1 where the model is to be used. `a` is scaled in place: there is one copy of the rows. The weights'
    prior doesn't depend on the number of rows, so few rows move them little.
    """
    spread = np.einsum("ij,ij->j", a, a) / len(a) - a.mean(0) ** 2
    scale = (1 / (np.sqrt(np.maximum(spread, 0)) + 2e-4)).astype(np.float32)  # common buckets don't drown rare ones
    scale /= np.float32(np.sqrt(np.einsum("ij,j,ij->i", a, scale**2, a).mean() + 1e-12))  # a row's length is about 1
    a *= scale
    centre = a.mean(0)
    a -= centre
    gram = (a @ a.T).astype(np.float64)
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):  # each fold holds its part of each class
        fold[y == label] = np.arange(int((y == label).sum())) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        seen, apart = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        coef, bias = dual_fit(gram[np.ix_(seen, seen)], y[seen])
        margin[apart] = gram[np.ix_(apart, seen)] @ coef + bias
    slope, shift = calibrated(margin, y, share)
    coef, bias = dual_fit(gram, y)
    w = (coef @ a).astype(np.float64)
    return Model((w * scale).reshape(FAMILIES, BUCKETS), float(bias - w @ centre), slope, shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1600) -> Model | None:
    """max_rows: the most labelled rows that the fit uses, half of each class, taken in the order of a hash of doc_id. Of the texts of a repeated doc_id the first in order counts.

    The rows' vectors (bounded by max_rows) meet in one task, which fits the model; the driver gets weights alone.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = dict(known.groupBy("quality").count().collect())
    if min(counts.get(0, 0), counts.get(1, 0)) < LEAST:
        return None
    by_hash = F.xxhash64("doc_id")
    sample = known.filter("quality = 0").orderBy(by_hash).limit(max_rows // 2).unionAll(known.filter("quality = 1").orderBy(by_hash).limit(max_rows // 2))
    share = counts.get(1, 0) / (counts.get(0, 0) + counts.get(1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 300_000):
            x = vectors(*flat(batch.column("text")))
            where = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([i.astype(np.int32) for i in where], pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, where)], pa.list_(pa.float32()))], names=["doc_id", "quality", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        ids = np.sort(rows["doc_id"].to_numpy())
        place = np.empty(len(ids), np.int64)
        place[np.argsort(hash_ranges(np.frombuffer(ids.astype("<i8").tobytes() + b"\0" * 32, np.uint8), 8 * np.arange(len(ids)), np.full(len(ids), 8)))] = np.arange(len(ids))
        x, y = np.zeros((len(ids), FAMILIES * BUCKETS), np.float32), np.zeros(len(ids))
        for batch in rows.to_batches():
            for doc, label, at, value in zip(batch["doc_id"].to_pylist(), batch["quality"].to_pylist(), batch["at"], batch["value"]):
                i = place[np.searchsorted(ids, doc)]
                x[i, at.values.to_numpy()], y[i] = value.values.to_numpy(), label
        del rows, batch, at, value
        give_back()
        if min((y == 0).sum(), (y == 1).sum()) < LEAST:  # labels whose documents aren't there
            return
        model = fit(x, y, share)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.ravel()], pa.list_(pa.float64())), *(pa.array([v], pa.float64()) for v in (model.bias, model.slope, model.shift))], names=["weights", "bias", "slope", "shift"])

    once = texts_of(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = once.mapInArrow(tidy(run), "doc_id long, quality int, at array<int>, value array<float>").repartition(1)  # max_rows at most
    found = rows.mapInArrow(tidy(learn), "weights array<double>, bias double, slope double, shift double").collect()
    return Model(np.array(found[0]["weights"]).reshape(FAMILIES, BUCKETS), *found[0][1:]) if found else None


OUT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]


def judged(batch: pa.RecordBatch, model: Model | None, threshold: float) -> list[np.ndarray]:
    """Counts, base_failed, probability and kept of a batch of texts."""
    buf, offsets = flat(batch.column("text"))
    m = measures(buf, offsets)
    p = np.ones(batch.num_rows) if model is None else model.probability(buf, offsets, m["hashes"], m["first"])
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return [*(m[k].astype(np.int64) for k, _ in OUT), failed, p, ~failed & (p >= threshold)]


def score(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The counts, base_failed, the calibrated probability of good quality and the verdict of every document.

    threshold: the least probability at which a document is kept.
    """
    names = ["doc_id", *(k for k, _ in OUT), "base_failed", "probability", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, judged(batch, model, threshold))], names=names)

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{k} {t}" for k, t in OUT) + ", base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The documents that `score` keeps, with the table's own columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array(judged(batch, model, threshold)[-1]))

    return docs.mapInArrow(tidy(run), docs.schema)
