"""Near-duplicate vectors by a subspace pigeonhole join of pages.

Unit vectors with cosine >= c are at a squared distance of 2 - 2c at most. After a rotation they are split into blocks of a few dimensions; in at
least one block a pair is within that block's proportional share of the squared distance. A k-d tree, learned from a bounded sample, deals
vectors to leaves; a leaf is written in pages of bounded size, one row a page, and every vector lies in one page. Pages whose boxes are
within the whole squared distance meet: a product of the stored table with itself, whose tasks read the pages from the shared folder, so
nothing is shuffled or written for a meeting. There blocks are compared as matrices, and what is within the share of any of them is
verified in double precision on the whole vectors. Tasks give out counts and spanning links, not pairs.

Equal vectors are one vector with a weight. Vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing; so does a null vec_id. Rows that repeat are copies and link with each other. A cosine of exactly the bound is a link. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Vectors of a page, at most; rows of the sample that the tree is learned from, about; spanning links that a task keeps before it reduces them.
LEAF, SAMPLE, CHAIN = 2000, 20_000, 1 << 20


@dataclass
class Tree:
    """A complete k-d tree: the split dimension and place of each inner node, in heap order."""

    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    @staticmethod
    def learn(x: np.ndarray, depth: int) -> Tree:
        dims, cuts = np.zeros(max((1 << depth) - 1, 0), np.int64), np.zeros(max((1 << depth) - 1, 0))
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            for i in range(first, 2 * first + 1):
                some = x[node == i]
                if len(some) < 2:
                    some = x
                dims[i] = int(np.argmax(some.var(0)))
                cuts[i] = np.median(some[:, dims[i]])
            node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
        return Tree(dims, cuts, depth)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dims[node]] > self.cuts[node])
        return node - ((1 << self.depth) - 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose largest component is 1 or -1; equal rows stay equal to the last bit, whatever else is in the batch."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; very large and very small components are no exception."""
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def paged(vectors: DataFrame, size: int) -> DataFrame:
    """vectors (id, embedding), copies included, as stored pages of distinct ones: page, ids, weights, vectors (as bytes), and the box of the unit vectors (lo, hi)."""
    n, kind = vectors.count(), vectors.schema["embedding"].dataType.elementType.simpleString()
    first = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))  # about SAMPLE rows, whatever n
    drawn = vectors.filter(first).select("embedding").limit(2 * SAMPLE).toArrow()["embedding"].to_numpy(zero_copy_only=False)
    sample = np.stack(list(drawn) or list(vectors.select("embedding").limit(1).toArrow()["embedding"].to_numpy(zero_copy_only=False))).astype(float)
    sample = np.unique(scaled(sample), axis=0)
    # leaves of LEAF vectors, as long as the sample tells them apart; beyond that leaves have several pages
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / LEAF))), int(np.log2(max(len(sample), 16) / 16))))
    known = vectors.sparkSession.sparkContext.broadcast(Tree.learn(sample, depth))  # a number a leaf; the sample is bounded

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaf of each vector; a batch's copies are one row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, size) + 0  # no -0.0
            bits = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * size))).ravel()
            _, at, which = np.unique(bits, return_index=True, return_inverse=True)
            ids = batch.column("id").to_numpy()
            least = ids[at]
            np.minimum.at(least, which, ids)
            leaf = known.value.leaf(scaled(x[at].astype(float)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(least), pa.array(np.bincount(which)), batch.column("embedding").take(pa.array(at))], names=["leaf", "id", "weight", "embedding"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of sorted leaves as pages."""
        now, number, held = None, 0, []

        def page() -> pa.RecordBatch:
            ids, weights, x = (np.concatenate(z) for z in zip(*held))
            unit = units(x.astype(float))
            return pa.RecordBatch.from_arrays(
                [pa.array([now << 32 | number]), *(pa.array([z.tobytes()], pa.binary()) for z in (ids, weights, x)), *(pa.array([z.tolist()], pa.list_(pa.float64())) for z in (unit.min(0), unit.max(0)))], names=["page", "ids", "weights", "vectors", "lo", "hi"]
            )

        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, size)
            ids, weights = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            edges = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])).tolist() if batch.num_rows else []
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                if leaf[low] != now:
                    if held:
                        yield page()
                    now, number, held = int(leaf[low]), 0, []
                while low < high:
                    some = min(high, low + LEAF - sum(len(z[0]) for z in held))
                    held.append((ids[low:some], weights[low:some], x[low:some]))
                    low = some
                    if sum(len(z[0]) for z in held) == LEAF:
                        yield page()
                        number, held = number + 1, []
        if held:
            yield page()

    # a leaf's vectors are in one task, so copies meet there without another shuffle; files of a few pages, as many tasks read them later
    placed = vectors.mapInArrow(place, f"leaf long, id long, weight long, embedding array<{kind}>").repartition(max(1, -(-n // (4 * LEAF))), "leaf")
    distinct = placed.groupBy("leaf", "embedding").agg(F.min("id").alias("id"), F.sum("weight").alias("weight"))
    packed = distinct.sortWithinPartitions("leaf").mapInArrow(pack, "page long, ids binary, weights binary, vectors binary, lo array<double>, hi array<double>")
    return stored(packed, "vec-pages")


def linked_vectors(vectors: DataFrame, size: int, cosine: float, blocks: int, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """vectors (id, embedding), copies included: per smallest id of equal vectors the number of other vectors linked with it (id, links), and spanning links (a, b)."""
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    pages = paged(vectors, size)
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    cut = [list(c) for c in np.array_split(np.arange(size), min(blocks, size))]
    budget = 2 - 2 * cosine
    shares = [budget * len(c) / size * (1 + 1e-9) + 1e-12 for c in cut]

    def unpack(ids: bytes, weights: bytes, x: bytes) -> tuple:
        """ids, weights, vectors, their lengths, and turned unit vectors."""
        e = scaled(np.frombuffer(x, kind).reshape(-1, size).astype(float))
        n = np.linalg.norm(e, axis=1)
        return np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64), e, n, (e / n[:, None]) @ turn

    def beside(u: np.ndarray, b: int) -> np.ndarray:
        """Rows whose product with those of `across` is the share less the squared distance in a block."""
        x = u[:, cut[b]]
        return np.column_stack([2 * x, shares[b] + 1e-5 - (x * x).sum(1), np.ones(len(x))]).astype(np.float32)

    def across(u: np.ndarray, b: int) -> np.ndarray:
        y = u[:, cut[b]]
        return np.column_stack([y, np.ones(len(y)), -(y * y).sum(1)]).astype(np.float32).T.copy()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, ids, links, total = {}, [], [], 0  # of this task's pages
        a, b, kept = [], [], 0  # links between its rows that span what it has found
        left = None

        def known(page: int, of: np.ndarray) -> int:
            nonlocal total
            if page not in start:
                start[page] = (len(ids), total)
                ids.append(of)
                links.append(np.zeros(len(of), np.int64))
                total += len(of)
            return start[page][0]

        def reduce() -> None:
            nonlocal a, b, kept
            root = spanning(np.concatenate(a), np.concatenate(b), total)
            tied = np.flatnonzero(root != np.arange(total))
            a, b, kept = [tied], [root[tied]], 0

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                p, q = row["page"].as_py(), row["r_page"].as_py()
                if left is None or left[0] != p:
                    x = unpack(*(row[c].as_buffer() for c in ("ids", "weights", "vectors")))
                    left = p, x, [beside(x[4], k) for k in range(len(cut))]
                x = left[1]
                y = x if p == q else unpack(*(row[c].as_buffer() for c in ("r_ids", "r_weights", "r_vectors")))
                right = [across(y[4], k) for k in range(len(cut))]
                at, to = known(p, x[0]), known(q, y[0])
                for low in range(0, len(x[0]), 256):
                    near = np.zeros((min(256, len(x[0]) - low), len(y[0])), bool)
                    for k, other in enumerate(right):
                        near |= left[2][k][low : low + 256] @ other >= 0
                    found = np.flatnonzero(near)
                    i, j = found // len(y[0]) + low, found % len(y[0])
                    if p == q:
                        i, j = i[i < j], j[i < j]
                    sure = [np.einsum("ij,ij->i", x[2][i[z : z + 20_000]], y[2][j[z : z + 20_000]]) / (x[3][i[z : z + 20_000]] * y[3][j[z : z + 20_000]]) >= cosine for z in range(0, len(i), 20_000)]
                    if not sure or not (ok := np.concatenate(sure)).any():
                        continue
                    i, j = i[ok], j[ok]
                    np.add.at(links[at], i, y[1][j])
                    np.add.at(links[to], j, x[1][i])
                    a.append(i + start[p][1])
                    b.append(j + start[q][1])
                    kept += len(i)
                    if kept > CHAIN:
                        reduce()
        if not a:
            return
        reduce()
        every, counts = np.concatenate(ids), np.concatenate(links)
        on = np.flatnonzero(counts)
        for flag, mine, n, other in ((False, every[on], counts[on], every[on]), (True, every[a[0]], np.zeros(len(a[0]), np.int64), every[b[0]])):
            for low in range(0, len(mine), 100_000):
                some = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(mine[some]), pa.array(n[some]), pa.array(other[some]), pa.array(np.full(len(mine[some]), flag))], names=["id", "links", "other", "is_link"])

    def above(x: Column, y: Column) -> Column:
        return F.greatest(x - y, F.lit(0.0))

    gaps = F.zip_with(F.zip_with("lo", "r_hi", above), F.zip_with("r_lo", "hi", above), lambda x, y: x * x + y * y)  # one of both is 0
    reach = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= budget + 1e-6
    pairs = pages.join(pages.select(*[F.col(c).alias(f"r_{c}") for c in pages.columns]), (F.col("page") <= F.col("r_page")) & reach).drop("lo", "hi", "r_lo", "r_hi")
    met = stored(pairs.mapInArrow(meet, "id long, links long, other long, is_link boolean"), "vec-links")
    return met.filter("not is_link").groupBy("id").agg(F.sum("links").alias("links")), met.filter("is_link").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(table: DataFrame, cosine: float = 0.9, blocks: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of a table with vec_id and embedding."""
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"  # other numbers are doubles
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    size = rows.filter("embedding is not null").groupBy(F.size("embedding").alias("s")).count().orderBy(F.desc("count"), "s").first()
    size = size[0] if size else 0
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == size)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(good & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    able = rows.filter(usable)
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size or able.isEmpty():
        return alone
    links, ties = linked_vectors(able.select(F.col("vec_id").alias("id"), "embedding"), size, cosine, blocks)
    comps = components(ties)
    # vectors are told apart by 128 bits of hashes here, as they needn't travel again for their names
    marked = able.select("vec_id", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g"))
    reps = marked.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    found = stored(
        reps.join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id")),
        "vec-found",
    )
    # vectors that link with nothing take no part in the join, whatever their number
    named = marked.join(found, ["h", "g"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return named.unionByName(alone)
