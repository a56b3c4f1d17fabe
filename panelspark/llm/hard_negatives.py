"""Hard negatives by shared lists of candidates for clusters of anchors.

Directions are told apart by centres learned from bounded samples of rows and of anchors. Candidates belong to the block of their nearest centre, with the smallest
cosine to it and the largest length of the block; anchors of one centre of theirs form clusters of bounded size, each with a mean direction and the largest angle of a member to it.
For a member of a cluster and a row at angle t to the cluster's mean, their inner product is at most the lengths' product times cos(t - the cluster's
angle). So one list, sorted by length times that cosine, serves all members: each walks it until the bound of what comes next is
below the least score it still needs; then what it has is certified. Lists are cut by blocks first (a block's bound comes from
its own cone), so a cluster sees only the blocks that can hold a result for it, and a list is dealt in chunks of blocks of a few thousand rows.
Two searches follow each other, of positives and then of negatives below their scores; each looks first into a cluster's best blocks for a score to beat, and
then into all blocks whose bound reaches it. Scores are whole numbers, sums in double precision where these are exact, else in 64-bit integers.

Rows with a null label, a null vector or a null or non-finite component take no part; nor do rows with a null vec_id, of another length than most,
or with components too large for scores that fit a long (2^20 and more in 64 dimensions). Rows equal in label and scaled vector are one candidate with its smallest ids (as many as a result can
need), and one anchor; results are then dealt to all anchors of it. Ties of scores go to the smaller vec_id, repeated ids count as rows each. An
anchor without others of its label has no rows. An empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block, about; most blocks' centres; rows of the sample that these are learned from, at most; anchors of a cluster, at most.
BLOCK, CENTRES, SAMPLE, CLUSTER = 1000, 1024, 20_000, 128
#: Blocks that the first look takes; blocks of a chunk of a list.
FIRST, CHUNK = 4, 16
#: Rows of a list that members score at a time.
SLAB = 512
#: What rounding may take from a bound, as a share of it.
SLACK = 1e-6


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (zero rows stay zero), and their lengths."""
    n = np.linalg.norm(x, axis=1)
    return x / np.maximum(n, 1e-300)[:, None], n


def learned(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """k centres on the unit sphere, by a few rounds of spherical k-means."""
    x = directions(sample)[0]
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where((np.linalg.norm(total, axis=1) > 0)[:, None], directions(total)[0], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cos = x @ centres.T
    at = cos.argmax(1)
    return at, cos[np.arange(len(x)), at]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers: in doubles where all sums are exact there."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def cleaned(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label (as it comes) and the scaled vector of the rows that take part; the vectors' length."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and label is not null and x is not null")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.filter(finite & (F.size("x") > 0))
    size = rows.groupBy(F.size("x").alias("s")).count().orderBy(F.desc("count"), "s").first()
    size = size["s"] if size else 0
    most = min(2.0**22, float(int((2**62 / max(size, 1)) ** 0.5)) / 256)  # inner products fit a long
    return rows.filter((F.size("x") == size) & F.forall("x", lambda v: F.abs(v) < most)).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * 256).cast("int")).alias("v")), size


def placed(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """Adds each row's block (nearest centre), its cosine to the centre, and its length."""
    known = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, n = directions(matrix(batch.column("v"), size).astype(np.float64))
                at, cos = nearest(x, known.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(cos), pa.array(n)], names=[*batch.schema.names, "centre", "cos", "norm"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", centre int, cos double, norm double")


def clusters(anchors: DataFrame, blocks: list, centres: np.ndarray, size: int) -> DataFrame:
    """cluster, and for every block its bound on the cosine part: what a member of length 1 can score there at most. Sorted lists of blocks.

    blocks: centre, smallest cosine and largest length of each block, CENTRES at most. anchors come with the number of their cluster.
    """
    spark = anchors.sparkSession
    known = spark.sparkContext.broadcast((centres[[b[0] for b in blocks]], np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks]), np.array([b[2] for b in blocks])))
    names = ["cluster", "centre", "bound"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        mean, names_of, least, norm = known.value
        x, n = directions(matrix(table["v"].combine_chunks(), size).astype(np.float64))
        middle = x.sum(0)
        middle = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-9 else middle
        wide = np.arccos(np.clip((x[n > 0] @ middle).min(initial=1.0), -1, 1)) if middle.any() else np.pi
        apart = np.arccos(np.clip(mean @ middle, -1, 1)) - np.arccos(np.clip(least, -1, 1)) - wide
        bound = norm * np.maximum(np.cos(np.clip(apart, 0, np.pi)), 0)  # not below 0, as shorter rows would then score more
        return pa.table([pa.array(np.full(len(names_of), key[0].as_py())), pa.array(names_of.astype(np.int32)), pa.array(bound)], names=names)

    return anchors.groupBy("cluster").applyInArrow(run, "cluster long, centre int, bound double")


def listed(visits: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Chunks of lists: the members of a cluster (part 0), then the candidates of the chunk's blocks (part 1)."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), "centre", "deal")) - 1  # a row a block
    chunks = visits.withColumn("chunk", F.floor(rank / CHUNK)).select("cluster", "chunk", "centre", "deal")
    rows = chunks.join(candidates, ["centre", "deal"]).select("cluster", "chunk", F.lit(1).alias("part"), F.col("rid").alias("id"), "label", "v", "norm", "ids", F.array().cast("array<bigint>").alias("needs"))
    members = chunks.select("cluster", "chunk").distinct().join(anchors, "cluster").select("cluster", "chunk", F.lit(0).alias("part"), F.col("rid").alias("id"), "label", "v", "norm", F.array().cast("array<bigint>").alias("ids"), "needs")
    return members.unionAll(rows).repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "part")


def walked(lists: DataFrame, size: int, find: str, most: int, low: int = 0, high: int = 0) -> DataFrame:
    """Of each chunk: anchor (rid), positive_score, score, vec_id of the best rows that every member finds there.

    find: "positives", the `most` best of the member's own label, scores of at least needs[0]; or "negatives", for each of the scores in needs[1:]
    the `most` best of other labels between `low` and `high` percent of it, each of at least the matching score known before.
    """
    names = ["anchor", "positive_score", "score", "vec_id"]

    def chunk(members: tuple, rows: tuple) -> Iterator[tuple]:
        rid, label, a, norm, needs = members
        other_label, v, length, ids = rows
        x, unit = directions(a.astype(np.float64))[0], directions(v.astype(np.float64))[0]
        middle = x.sum(0)
        middle = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-9 else middle
        wide = np.arccos(np.clip((x[norm > 0] @ middle).min(initial=1.0), -1, 1)) if middle.any() else np.pi
        bound = length * np.cos(np.clip(np.arccos(np.clip(unit @ middle, -1, 1)) - wide, 0, np.pi))
        bound += np.abs(bound) * SLACK + SLACK
        order = np.argsort(-bound, kind="stable")  # the list that all members walk
        bound, v, other_label = bound[order], v[order], other_label[order]
        ids = [ids[i] for i in order]
        # one line a wanted result list: member, reference score, least score that still counts
        lines = [(m, 0, n[0]) for m, n in enumerate(needs)] if find == "positives" else [(m, n[1 + 2 * j], n[2 + 2 * j]) for m, n in enumerate(needs) for j in range(len(n) // 2)]
        if not lines:
            return
        span = [(-(-low * r // 100), high * r // 100) for _, r, _ in lines]
        who, ref, least = (np.array(c, dtype=np.int64) for c in zip(*lines))
        found: list[list[tuple[int, int]]] = [[] for _ in lines]
        for at in range(0, len(v), SLAB):
            going = np.flatnonzero(bound[at] * norm[who] >= least)
            if not len(going):
                break  # certified: no later row reaches what any member still needs
            active, place = np.unique(who[going], return_inverse=True)
            got = scores(a[active], v[at : at + SLAB])
            same = label[active][:, None] == other_label[None, at : at + SLAB]
            for line, m in zip(going.tolist(), place.tolist()):
                s = got[m]
                if find == "positives":
                    ok = same[m] & (s >= least[line])
                else:
                    ok = ~same[m] & (s >= least[line]) & (s >= span[line][0]) & (s <= span[line][1])
                hit = np.flatnonzero(ok)
                if not len(hit):
                    continue
                if len(hit) > most:  # all with the score of the most-th, for ties
                    hit = hit[s[hit] >= np.partition(s[hit], len(hit) - most)[len(hit) - most]]
                new = [(int(s[i]), c) for i in hit.tolist() for c in ids[at + i]]
                merged = sorted(found[line] + new, key=lambda p: (-p[0], p[1]))[:most]
                found[line] = merged
                if len(merged) == most:
                    least[line] = max(least[line], merged[-1][0])
        for line, rows_found in enumerate(found):
            for s, i in rows_found:
                yield int(rid[who[line]]), int(ref[line]), s, i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, rows = None, [], []

        def settle() -> list[tuple]:
            if not members or not rows:
                return []
            m, r = pa.Table.from_batches(members).combine_chunks(), pa.Table.from_batches(rows).combine_chunks()
            vec = lambda t: matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], size)
            return list(chunk((m["id"].to_numpy(), m["label"].to_numpy(), vec(m), m["norm"].to_numpy(), m["needs"].to_pylist()), (r["label"].to_numpy(), vec(r), r["norm"].to_numpy(), r["ids"].to_pylist())))

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], [], []))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            which = [batch.column(c).to_numpy() for c in ("cluster", "chunk", "part")]
            edges = np.flatnonzero(np.append(True, np.any([w[1:] != w[:-1] for w in which], axis=0)))
            for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                now = (int(which[0][begin]), int(which[1][begin]))
                if now != key:
                    yield out(settle())
                    key, members, rows = now, [], []
                (rows if which[2][begin] else members).append(batch.slice(begin, end - begin))
        yield out(settle())

    return lists.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` best of what the chunks have found, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def mined(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    table: vec_id, label, embedding. Anchors are the rows whose vec_id is divisible by `every`; for each of an anchor's `positives` best others of its
    label, the `negatives` best of other labels whose score is between `low` and `high` percent of the positive's.
    """
    rows, size = cleaned(table)
    rows = stored(rows, "scaled-vectors")
    spark = table.sparkSession
    if not size or rows.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    keep = max(positives + 1, negatives)  # a result can need so many of equal rows: the anchor itself may be among them
    nth = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    reps = rows.withColumn("nth", nth).filter(F.col("nth") <= keep).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rid", F.monotonically_increasing_id())
    reps = stored(reps.select("rid", "label", "v", "ids"), "distinct-vectors")
    n = reps.count()

    def drawn(some: DataFrame, n: int) -> np.ndarray:
        """About SAMPLE rows by a hash, twice as many at most."""
        part = F.pmod(F.xxhash64("rid"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))
        found = some.filter(part).select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()
        return matrix(found, size).astype(np.float64) if len(found) else np.zeros((0, size))

    sample = drawn(reps, n)
    centres = learned(sample, max(1, min(CENTRES, n // BLOCK, len(sample)))) if len(sample) else np.ones((1, size))
    dealt = stored(placed(reps, centres, size), "placed-vectors")
    blocks = stored(dealt.groupBy("centre").agg(F.min("cos").alias("cos"), F.max("norm").alias("norm"), F.ceil(F.count("*") / F.lit(2 * BLOCK)).alias("deals")), "vector-blocks")
    known = [(r["centre"], r["cos"], r["norm"], r["deals"]) for r in blocks.orderBy("centre").collect()]  # CENTRES rows at most
    deals = blocks.select("centre", "deals")
    candidates = dealt.join(F.broadcast(deals), "centre").withColumn("deal", F.pmod(F.xxhash64("rid"), F.col("deals")))

    heads = rows.filter(F.col("vec_id") % every == 0)
    owners = stored(heads.join(reps.select("rid", "label", "v"), ["label", "v"]).select(F.col("vec_id").alias("anchor_id"), F.col("rid").alias("anchor")), "anchors-of-vectors")
    queries = stored(reps.drop("ids").join(owners.select(F.col("anchor").alias("rid")).distinct(), "rid"), "anchor-vectors")
    n_anchors = queries.count()
    sample = drawn(queries, n_anchors)
    queries = placed(queries, learned(sample, max(1, min(CENTRES, n_anchors // CLUSTER, len(sample)))) if len(sample) else centres[:1], size)
    sizes = queries.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(CLUSTER)).alias("groups"))
    queries = queries.join(F.broadcast(sizes), "centre").withColumn("cluster", F.col("centre") * F.lit(1 << 32) + F.pmod(F.xxhash64("rid", F.lit(1)), F.col("groups")))
    queries = stored(queries.select("cluster", "rid", "label", "v", "norm"), "anchor-clusters")
    bounds = clusters(queries, known, centres, size).join(F.broadcast(deals), "centre")
    bounds = stored(bounds.select("cluster", "centre", "bound", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")), "cluster-lists")
    look = bounds.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), "centre", "deal"))).filter(F.col("n") <= FIRST).drop("n")

    def search(needs: DataFrame, find: str, most: int, keys: list[str], improve, name: str) -> DataFrame:
        """needs: rid, needs. A look into the best blocks gives scores to beat, then all blocks that can beat them are searched."""
        members = queries.join(needs, "rid")
        seen = first(walked(listed(look, candidates, members), size, find, most, low, high), keys, most)
        members = stored(improve(members, stored(seen, f"{name}-look")), f"{name}-needs")
        least = members.withColumn("least", F.col("needs")[0] / F.greatest("norm", F.lit(1e-300)))
        reach = least.groupBy("cluster").agg(F.min("least").alias("least"))
        visits = bounds.join(reach, "cluster").filter(F.col("bound") * (1 + SLACK) + SLACK >= F.col("least")).drop("least")
        return stored(first(walked(listed(visits, candidates, members), size, find, most, low, high), keys, most), name)

    floor = -(1 << 62)

    def beat(members: DataFrame, seen: DataFrame) -> DataFrame:
        known = seen.groupBy("anchor").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") == positives + 1)
        joined = members.join(known.withColumnRenamed("anchor", "rid"), "rid", "left")
        return joined.select("cluster", "rid", "label", "v", "norm", F.array(F.coalesce("s", F.lit(floor))).alias("needs"))

    everyone = queries.select("rid", F.array(F.lit(floor)).alias("needs"))
    own = search(everyone, "positives", positives + 1, ["anchor"], beat, "positives")
    # an anchor leaves itself out of its vector's list, once
    mine = F.col("vec_id") == F.col("anchor_id")
    per = Window.partitionBy("anchor_id", "anchor", "copy")
    copies = owners.groupBy("anchor_id", "anchor").count()
    listed_own = copies.join(own.select("anchor", "score", "vec_id", "rank"), "anchor").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    self_rank = F.min(F.when(mine, F.col("rank"))).over(per)
    others = listed_own.withColumn("self", self_rank).filter(F.coalesce(F.col("rank") != F.col("self"), F.lit(True)))
    others = others.withColumn("place", F.row_number().over(per.orderBy("rank"))).filter(F.col("place") <= positives)
    chosen = stored(others.select("anchor_id", "anchor", "copy", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives-of-anchors")

    # scores of at least 0 can have negatives: needs are [least of all, score, least score of its negatives, ...]
    refs = chosen.filter("positive_score >= 0").select("anchor", "positive_score").distinct()

    def wants(table: DataFrame) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct("positive_score", "least")))  # positives + 1 at most
        flat_pairs = F.flatten(F.transform("pairs", lambda p: F.array(p["positive_score"], p["least"])))
        return table.groupBy("anchor").agg(pairs.alias("pairs"), F.min("least").alias("all")).select(F.col("anchor").alias("rid"), F.concat(F.array("all"), flat_pairs).alias("needs"))

    low_score = F.expr(f"(cast(positive_score AS decimal(30, 0)) * {low} + 99) div 100")
    start = stored(refs.withColumn("least", low_score), "negative-references")

    def beat_negatives(members: DataFrame, seen: DataFrame) -> DataFrame:
        full = seen.groupBy("anchor", "positive_score").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") == negatives).select("anchor", "positive_score", "s")
        better = start.join(full, ["anchor", "positive_score"], "left").withColumn("least", F.greatest("least", F.coalesce("s", F.col("least")))).drop("s")
        return members.drop("needs").join(wants(better), "rid").select("cluster", "rid", "label", "v", "norm", "needs")

    far = search(wants(start), "negatives", negatives, ["anchor", "positive_score"], beat_negatives, "negatives")
    found = far.select("anchor", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
