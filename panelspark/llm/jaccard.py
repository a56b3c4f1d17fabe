"""Near-duplicate documents by the Jaccard similarity of their word shingles: a token-group matrix over Spark tables.

All links at or above the threshold count, and none below. Steps:

1. Each text becomes its set of distinct shingles (64-bit hashes) and a fingerprint of the set; equal sets are one from here on.
2. Two sets can only be linked if they share one of the first n - ceil(t n) + 1 shingles of each in any common order. Each
   set gives these out; a shingle that only one set gives is dropped at once. The order puts shingles that recur often last. How often
   is counted over all documents, run by run; the order decides how much work is done, never the result.
3. Each set follows the set that comes first among the holders of most of its given-out shingles, or a good part of them, and so on to one that
   follows nobody; crowds then follow crowds. So a crowd of similar sets is one group or few, whether its members are linked or not. Large groups are cut into blocks.
4. Groups that share given-out shingles are counted, group by group, never set by set, nor block by block: with fewer shared ones than the sizes ask
   for, no member of one can be linked with a member of the other. Blocks are paired after that, once for two groups, not once for a shingle.
5. Sets are held against their leaders first; blocks whose members these links tie together are done with.
6. The matrix holds the union of its members' shingles for each block left. A set of another block that may be linked
   is held against the union: if it has fewer than ceil(t n) of its shingles there, the block stays closed. Blocks that qualify are
   opened, and the members compared exactly. What leaves a task are spanning links, not pairs.
7. Components of all links are found by large-star and small-star steps.

Sets are gathered from the text only for documents that may be linked. Null texts and texts without words have an
empty set and are linked with nothing; with fewer words than a shingle the whole sequence is the one shingle. Rows that
repeat are copies of each other. A null doc_id is linked with nothing. Very long texts are sets like others. Similarity of exactly the
threshold is a link. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, M1, M2, M3, U, WORD, chunks, flat, hash_ranges, mix, stored, texts_of, tidy, word_ranges
from .components import components

#: Sets, and shingles, of a block of a group, on average; sets that are held against a block in one task, about.
BLOCK, BLOCK_TOKENS, QUERIES = 128, 400_000, 1024
#: Holders of a common shingle that are dealt out together, about; groups that share a shingle and meet in one task, about.
RUN_OF_HOLDERS, CROWD = 4096, 1024
#: A set follows another that shares at least this part of what it gives out (1 / PART); bits that mark wanted documents.
PART, MARKS = 4, 1 << 24
#: Shingles that are moved to the end of the order, at most (the most frequent ones); others keep the order of their hashes.
LATE = 1 << 19
#: Shingles of one run of documents in which repetition is counted, and the least repetition that counts.
RUN, REPEATED = 3_000_000, 2


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = flat(texts)
    buf = LOWER[buf]
    starts, lengths, first = word_ranges(buf, offsets, WORD)
    h = hash_ranges(buf, starts, lengths)
    s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * M1 + U(i)
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in h[a:b]:
                x = mix((x ^ w) * M2 + U(1))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """64 bits that equal sets share."""
    both = mix(s * M3).sum(keepdims=True) ^ mix(s + M2).sum(keepdims=True) * M1 + U(len(s))
    return int(mix(both).astype(np.int64)[0]) if len(s) else 0


def text_hash() -> Column:
    """64 bits that tell texts apart; no text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def describe(docs: DataFrame, k: int, by_text: bool = False) -> DataFrame:
    """doc_id, n (size of the set), set (its fingerprint); late, late_n: shingles that recur in a run of documents, on one row of each run; by_text: text_hash."""
    more = ["text_hash"] if by_text else []

    def repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(s)))
        return s[at[n >= REPEATED]].astype(np.int64), n[n >= REPEATED].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, met, waiting = [], 0, set(), None

        def made(rows: tuple, late: tuple | None) -> pa.RecordBatch:
            ids, n, fp, *others = rows
            blank = [None] * len(n)
            a, b = (blank, blank) if late is None else ([late[0], *blank[1:]], [late[1], *blank[1:]])
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int32())), *others], names=["doc_id", "n", "set", "late", "late_n", *more])

        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), k)
            fps = [fingerprint(s) for s in sets]
            if waiting is not None:
                full = size > RUN
                yield made(waiting, repeated(held) if full else None)
                if full:
                    held, size, met = [], 0, set()
            for s, fp in zip(sets, fps):
                if len(s) and fp not in met:
                    met.add(fp)
                    held.append(s)
                    size += len(s)
            waiting = (batch.column("doc_id"), [len(s) for s in sets], fps, *(batch.column(c) for c in more))
        if waiting is not None:
            yield made(waiting, repeated(held))

    return texts_of(docs, *(text_hash().alias(c) for c in more)).mapInArrow(tidy(run), "doc_id long, n long, set long, late array<long>, late_n array<int>" + "".join(f", {c} long" for c in more))


def given(n, percent: int):
    """n - ceil(t n) + 1, of a number or a column: of two linked sets, each must share one of so many first shingles with the other."""
    return n - (F.ceil(n * percent / 100) if isinstance(n, Column) else (n * percent + 99) // 100) + 1


def late_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles in ascending order of their counts, LATE at most, and these counts.

    A histogram of the counts (some hundred classes) gives the least count whose shingles still fit; only those come to the driver.
    """
    counted = described.filter("late is not null").select(F.explode(F.arrays_zip("late", "late_n")).alias("x")).groupBy(F.col("x.late").alias("token")).agg(F.sum("x.late_n").alias("c"))
    counted = stored(counted.filter("c > 1").withColumn("level", F.floor(F.log2("c") * 16).cast("int")), "near-counts")
    room, least = LATE, None
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    late = counted.filter(F.col("level") >= least).select("token", "c").toArrow()
    tokens, counts = late["token"].to_numpy(), late["c"].to_numpy()
    order = np.lexsort((tokens, counts))
    return tokens[order].astype(np.uint64), counts[order]


def given_out(docs: DataFrame, k: int, percent: int, late: np.ndarray, counts: np.ndarray) -> DataFrame:
    """token, salt, set: the first shingles of each set in the common order.

    late: shingles that come last, in ascending order of their counts. Holders of a very common shingle are dealt to salts from 1 on.
    """
    sc = docs.sparkSession.sparkContext
    order = np.argsort(late)
    shared = sc.broadcast((late[order], order.astype(np.int32), (-(-counts[order] // RUN_OF_HOLDERS)).astype(np.int32)))  # LATE numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, parts = shared.value
        met: set[int] = set()
        for batch in chunks(batches):
            tokens, owners, sizes, salts = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                fp = fingerprint(s)
                if not len(s) or fp in met:
                    continue
                if len(met) > 200_000:
                    met.clear()
                met.add(fp)
                need = given(len(s), percent)
                salt = np.zeros(len(s), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    last = keys[at] == s
                    at = at[last]
                    at = at[np.argsort(ranks[at])]
                    s = np.concatenate([s[~last], keys[at]])
                    salt[len(s) - len(at) :] = np.where(parts[at] > 1, 1 + (fp >> 8) % parts[at].astype(np.int64), 0)
                tokens.append(s[:need])
                salts.append(salt[:need])
                owners.append(fp)
                sizes.append(need)
            tokens, salts = (np.concatenate(x) if x else np.zeros(0) for x in (tokens, salts))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(salts.astype(np.int32)), pa.array(np.repeat(np.array(owners, np.int64), sizes))], names=["token", "salt", "set"])

    return texts_of(docs).select("text").mapInArrow(tidy(run), "token long, salt int, set long")


def holders(given: DataFrame) -> DataFrame:
    """token, salt, set, head (the first set of those that hold the token with this salt) where several sets hold it, or may do so. Rows come sorted, and stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, head, shown = None, None, False  # the last row so far, its run's head, and whether the run has been given out
        for batch in batches:
            t, x, s = (batch.column(k).to_numpy() for k in ("token", "salt", "set"))
            if not len(t):
                continue
            if open_run is not None:
                t, x, s = (np.append(p, q) for p, q in zip(open_run, (t, x, s)))
            other = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
            new = np.append(True, other | (s[1:] != s[:-1]))
            t, x, s = t[new], x[new], s[new]
            at = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (x[1:] != x[:-1])))
            size = np.diff(np.append(at, len(t)))
            heads = s[at].copy()
            keep = np.repeat((size > 1) | (x[at] > 0), size)
            if open_run is not None:
                heads[0] = head
                keep[0] &= not shown
            yield pa.RecordBatch.from_arrays([pa.array(y[keep]) for y in (t, x, s, np.repeat(heads, size))], names=["token", "salt", "set", "head"])
            shown = bool(size[-1] > 1 or x[-1] > 0 or (len(at) == 1 and shown))
            open_run, head = (t[-1:], x[-1:], s[-1:]), heads[-1]

    return given.repartition("token", "salt").sortWithinPartitions("token", "salt", "set").mapInArrow(tidy(run), "token long, salt int, set long, head long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """set, n, tokens of the documents wanted (doc_id); a set may come several times.

    Hashes of the wanted ids are marked in a bitmap of fixed size, so most other texts stay where they are; a join by doc_id follows.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("int")
    marks = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()  # MARKS / 64 rows at most
    bitmap = np.zeros(MARKS // 64, np.int64)
    bitmap[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))).select(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in chunks(batches):
            rows = []
            for s in shingle_sets(batch.column("text"), k):
                fp = fingerprint(s)
                if fp not in met:
                    if len(met) > 200_000:
                        met.clear()
                    met.add(fp)
                    rows.append((fp, s))
            yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([s.astype(np.int64) for _, s in rows], pa.list_(pa.int64()))], names=["set", "n", "tokens"])

    near = texts_of(docs).filter("doc_id is not null").withColumn("slot", slot).mapInArrow(tidy(marked), "doc_id long, text string")
    return near.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(tidy(run), "set long, n long, tokens array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are at least so similar."""
    a = sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def least_shared(n_a, n_b, percent: int):
    """What two sets of these sizes share if they are linked."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def kept_back(n, percent: int):
    """How many shingles a set of n doesn't give out."""
    return n - given(n, percent)


def voted(votes: DataFrame) -> DataFrame:
    """a, b, c: for each a the b that shares most with it (c)."""
    best = votes.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("x"))
    return best.select("a", (-F.col("x.b")).alias("b"), F.col("x.c").alias("c"))


def followed(leads: DataFrame, jumps: int = 3) -> DataFrame:
    """a, leader: where it gets by following who follows whom (a, b), for 2^jumps steps. Every b is smaller than its a, so there are no rings."""
    known = stored(leads.select("a", "b"), "near-leads")
    for _ in range(jumps):
        known = stored(known.join(known.select(F.col("a").alias("b"), F.col("b").alias("next")), "b", "left").select("a", F.coalesce("next", "b").alias("b")), "near-leads")
    return known.withColumnRenamed("b", "leader")


def spread(held: DataFrame, grouped: DataFrame, unit: str) -> DataFrame:
    """token, the unit (a column of grouped), low, high (sizes of the unit's sets that hold the token), salt (the largest)."""
    rows = held.select("token", "salt", "set").join(grouped.select("set", "n", unit), "set")
    return rows.groupBy("token", unit).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("salt").alias("salt"))


def in_groups(held: DataFrame, size_of: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """set, doc_id, n, group, block of all sets that share a given-out shingle; token, group, low, high, salt of shingles that several groups
    hold; and a, b, c: sets to hold against each other first.

    A set follows the head of most of its given-out shingles, if it heads a good part of them, and so on to one that follows nobody. Such crowds then
    follow each other in the same way, so that a crowd of similar sets is one group however its members' edits split their shingles' heads.
    """
    best = stored(voted(held.filter("set <> head").groupBy(F.col("set").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("c"))), "near-votes")
    leads = best.join(size_of.select(F.col("set").alias("a"), "n"), "a").filter(F.col("c") * PART >= given(F.col("n"), percent))
    crowds = stored(size_of.join(followed(leads).withColumnRenamed("a", "set"), "set", "left").withColumn("leader", F.coalesce("leader", "set")), "near-crowds")
    rows = stored(spread(held, crowds, "leader"), "near-tokens")
    several = rows.groupBy("token").agg(F.min("leader").alias("head"), F.count("*").alias("holders")).filter("holders > 1").drop("holders")
    rows = stored(rows.join(several, "token"), "near-shared")
    met = rows.filter("leader <> head").groupBy(F.col("leader").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("c"), F.min("low").alias("n"))
    closest = stored(voted(met).join(met.select("a", "b", "n"), ["a", "b"]), "near-votes")
    upper = followed(closest.filter(F.col("c") * PART >= given(F.col("n"), percent)))
    grouped = crowds.join(upper.select(F.col("a").alias("leader"), F.col("leader").alias("upper")), "leader", "left").withColumn("group", F.coalesce("upper", "leader"))
    per_group = grouped.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_TOKENS))).alias("parts"))
    block = F.xxhash64("group", F.pmod(F.xxhash64("set"), F.col("parts")))
    grouped = grouped.join(per_group, "group").select("set", "doc_id", "n", "group", block.alias("block"))
    rows = rows.join(upper.select(F.col("a").alias("leader"), F.col("leader").alias("upper")), "leader", "left").groupBy("token", F.coalesce("upper", "leader").alias("group"))
    rows = rows.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("salt").alias("salt"))
    # the heads of a common shingle's salts with the least of them
    salted = held.filter("salt > 0").select("token", "head").distinct()
    heads = salted.join(salted.groupBy("token").agg(F.min("head").alias("b")), "token").filter("head <> b").groupBy(F.col("head").alias("a"), "b").agg(F.count("*").alias("c"))
    return grouped, rows, best.unionByName(closest.select("a", "b", "c")).unionByName(heads)


def may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes (low_a to high_a, low_b to high_b) and count c of shared given-out shingles allow a link.

    What two sets share beyond their given-out shingles is kept back by one of them.
    """
    rest = F.greatest(kept_back(F.col("high_a"), percent), kept_back(F.col("high_b"), percent))
    sizes = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    return pairs.filter(sizes & (F.col("c") + rest >= least_shared(F.col("low_a"), F.col("low_b"), percent)))


def block_pairs(held: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """x, y: blocks, x < y, as `group_pairs` finds them, each block a group."""
    return group_pairs(spread(held, grouped, "block").withColumnRenamed("block", "group"), percent)


def group_pairs(per_group: DataFrame, percent: int) -> DataFrame:
    """x, y: groups, x < y, some members of which share so many given-out shingles that they may be linked. per_group as `in_groups` gives it.

    The groups of a very common shingle are dealt to runs of about CROWD, and each two runs meet in a task of their own.
    """
    per_group = stored(per_group, "near-tokens")
    # only shingles among the last LATE have salts, so there are LATE rows at most
    crowds = stored(per_group.filter("salt > 0").groupBy("token").agg(F.ceil(F.count("*") / F.lit(CROWD)).cast("int").alias("runs")).filter("runs > 1"), "near-crowds")
    if crowds.isEmpty():
        met = meeting(per_group, per_group, ["token"], percent)
    else:
        few = per_group.join(F.broadcast(crowds), "token", "left_anti")
        many = per_group.filter("salt > 0").join(F.broadcast(crowds), "token").withColumn("run", F.pmod(F.xxhash64("group"), F.col("runs")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("runs") - 1))
        first, second = many.withColumn("i", F.col("run")).withColumn("j", every), many.withColumn("j", F.col("run")).withColumn("i", every)
        met = meeting(few, few, ["token"], percent).unionByName(meeting(first, second, ["token", "i", "j"], percent))
    ranges = [f(c).alias(c) for f, c in ((F.min, "low_a"), (F.max, "high_a"), (F.min, "low_b"), (F.max, "high_b"))]
    return may_link(met.groupBy("x", "y").agg(F.count("*").alias("c"), *ranges), percent).select("x", "y")


def meeting(first: DataFrame, second: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """x, y, low_a, high_a, low_b, high_b: a row for each shingle and two groups, x < y, whose sizes allow a link."""
    a, b = (t.select(*keys, F.col("group").alias(to), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")) for t, to, s in ((first, "x", "a"), (second, "y", "b")))
    sizes = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    return a.join(b, keys).filter((F.col("x") < F.col("y")) & sizes).drop(*keys)


def opened(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning links found by opening blocks.

    rows: block, part (tasks of a block's queries), kind (0: a member; 1: a member to be held against the others; 2: a set of another
    block), set, n, tokens. A part's rows come with members first; queries stream through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            if members and block is None and any(kind == 1 for kind, *_ in members):
                yield from made(Block(members, percent))
            elif block is not None:
                yield from made(block)

        def made(done: Block) -> Iterator[pa.RecordBatch]:
            a, b = done.links()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            blocks, parts, kinds, sets, sizes = (batch.column(c).to_pylist() for c in ("block", "part", "kind", "set", "n"))
            tokens = batch.column("tokens")
            offsets, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            for i in range(batch.num_rows):
                if (blocks[i], parts[i]) != key:
                    yield from close()
                    key, members, block = (blocks[i], parts[i]), [], None
                row = (kinds[i], sets[i], sizes[i], np.sort(values[offsets[i] : offsets[i + 1]]))
                if kinds[i] < 2:
                    members.append(row)
                else:
                    if block is None:
                        block = Block(members, percent)
                    block.ask(*row[1:])
        yield from close()

    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(tidy(run), "a long, b long")


class Block:
    """A row of the token-group matrix: the union of the members' shingles, and which members hold each."""

    def __init__(self, members: list[tuple], percent: int):
        self.percent = percent
        self.sets = [m[1] for m in members]
        self.sizes = np.array([m[2] for m in members], np.int64)
        every = np.concatenate([m[3] for m in members]) if members else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        every = every[order]
        self.owner = np.repeat(np.arange(len(members)), [len(m[3]) for m in members])[order]
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        self.union, self.at = every[at], np.append(at, len(every))
        self.label = list(range(len(members)))
        self.outside: list[tuple[int, int]] = []
        for i, m in enumerate(members):
            if m[0] == 1:
                self.join(self.linked(m[2], m[3]) + [i])

    def linked(self, n: int, tokens: np.ndarray) -> list[int]:
        """The members linked with a set."""
        if not len(self.union):
            return []
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        place = place[self.union[place] == tokens]
        if 100 * len(place) < self.percent * n:  # what the union has of it bounds what any member has
            return []
        size = self.at[place + 1] - self.at[place]
        begin = np.repeat(self.at[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(self.owner[begin], minlength=len(self.sets))
        return np.flatnonzero(100 * both >= self.percent * (n + self.sizes - both)).tolist()

    def find(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = i = self.label[self.label[i]]
        return i

    def join(self, found: list[int]) -> None:
        root = self.find(found[0])
        for j in found[1:]:
            self.label[self.find(j)] = root

    def ask(self, query: int, n: int, tokens: np.ndarray) -> None:
        found = self.linked(n, tokens)
        if found:
            self.join(found)
            self.outside.append((query, self.sets[found[0]]))

    def links(self) -> tuple[list[int], list[int]]:
        both = self.outside + [(s, self.sets[self.find(i)]) for i, s in enumerate(self.sets) if self.find(i) != i]
        return [a for a, _ in both], [b for _, b in both]


def roots(links: DataFrame, jumps: int = 2) -> DataFrame:
    """node, comp: for each set a set that it reaches by some of its links. Sets that get the same one are in one component; the reverse is left to `components`."""
    known = stored(links.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "near-roots")
    for _ in range(jumps):
        further = known.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        known = stored(known.join(further, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "near-roots")
    return known


def to_open(pairs: DataFrame, grouped: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """block, part, kind, set: what is to be held against what, as `opened` wants it, where the links known (node, comp) leave it open.

    pairs: x, y, groups that may be linked. Their blocks are paired only where the groups aren't tied together as a whole, and so are those of one group.
    """
    at = grouped.join(known.withColumnRenamed("node", "set"), "set", "left").select("set", "n", "group", "block", F.coalesce("comp", "set").alias("comp"))
    at = stored(at, "near-placed")
    blocks = stored(at.groupBy("block").agg(F.min("group").alias("group"), F.count("*").alias("members"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("n").alias("low"), F.max("n").alias("high")), "near-blocks")
    groups = blocks.groupBy("group").agg(F.count("*").alias("blocks"), F.min("least").alias("least"), F.max("most").alias("most"))
    tied = (F.col("least_x") == F.col("most_x")) & (F.col("least_y") == F.col("most_y")) & (F.col("least_x") == F.col("least_y"))
    first, second = (groups.select(F.col("group").alias(b), *[F.col(c).alias(f"{c}_{b}") for c in ("least", "most")]) for b in ("x", "y"))
    apart = pairs.join(first, "x").join(second, "y").filter(~tied).select(F.col("x").alias("group_x"), F.col("y").alias("group_y"))
    apart = apart.unionAll(groups.filter("blocks > 1 and least <> most").select("group", "group"))
    first, second = (blocks.select(F.col("block").alias(b), *[F.col(c).alias(f"{c}_{b}") for c in ("group", "members", "least", "most", "low", "high")]) for b in ("x", "y"))
    sizes = (F.col("high_x") * 100 >= F.col("low_y") * percent) & (F.col("high_y") * 100 >= F.col("low_x") * percent)
    larger = F.col("members_x") > F.col("members_y")
    left = apart.join(first, "group_x").join(second, "group_y").filter(((F.col("group_x") < F.col("group_y")) | (F.col("x") < F.col("y"))) & sizes & ~tied)
    left = left.select(F.when(larger, F.col("y")).otherwise(F.col("x")).alias("block"), F.when(larger, F.col("x")).otherwise(F.col("y")).alias("to"))
    asked = left.join(at, "block").select(F.col("to").alias("block"), "set", "comp")
    asked = stored(asked.join(blocks.filter("least = most").select("block", F.col("least").alias("comp")), ["block", "comp"], "left_anti").select("block", "set"), "near-asked")
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("parts"))
    queries = asked.join(parts, "block").select("block", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), F.lit(2).alias("kind"), "set")
    mixed = blocks.select("block", (F.col("least") != F.col("most")).alias("mixed")).join(parts, "block", "left").filter("mixed or parts is not null")
    part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    members = at.join(mixed, "block").select("block", part, "mixed", "set").select("block", "part", F.when(F.col("mixed") & (F.col("part") == 0), 1).otherwise(0).alias("kind"), "set")
    return stored(members.unionByName(queries), "near-matrix")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document.

    by_text: also text_hash and component_hash, the smallest text_hash that goes with component_id in the component. Where a doc_id
    repeats with different texts, only both together name one document.
    """
    described = stored(describe(docs, k, by_text), "near-docs")
    late, counts = late_shingles(described)
    first = F.min(F.struct("doc_id", "text_hash")).alias("first") if by_text else F.min("doc_id").alias("doc_id")
    split = ["first.doc_id", "first.text_hash"] if by_text else ["doc_id"]
    sizes = described.filter("n > 0 and doc_id is not null").groupBy("set").agg(first, F.max("n").alias("n"), F.count("*").alias("copies")).select("set", *split, "n", "copies")
    held = stored(holders(given_out(docs.filter("doc_id is not null"), k, percent, late, counts)), "near-holders")
    size_of = stored(held.select("set").distinct().join(sizes, "set").select("set", "doc_id", "n"), "near-sizes")
    grouped, per_group, tries = in_groups(held, size_of, percent)
    grouped = stored(grouped, "near-grouped")
    pairs = stored(group_pairs(per_group, percent), "near-pairs")
    a, b = (size_of.select(F.col("set").alias(s), F.col("n").alias(f"low_{s}"), F.col("n").alias(f"high_{s}")) for s in ("a", "b"))
    tries = stored(may_link(tries.join(a, "a").join(b, "b"), percent).select("a", "b"), "near-tries")
    several = grouped.groupBy("group").agg(F.count("*").alias("c")).filter("c > 1").select("group")
    groups = several.unionAll(pairs.select("x")).unionAll(pairs.select("y")).distinct()
    tried = tries.select(F.col("a").alias("set")).unionAll(tries.select("b")).distinct()
    wanted = grouped.join(groups, "group", "left_semi").select("doc_id").unionAll(grouped.join(tried, "set", "left_semi").select("doc_id"))
    sets = stored(sets_of(docs, wanted.distinct(), k), "near-sets")
    links = stored(linked(tries, sets, percent), "near-links")
    more = stored(opened(to_open(pairs, grouped, roots(links), percent).join(sets, "set"), percent), "near-more")
    classes = stored(components(links.unionAll(more)), "near-classes")
    named = sizes.join(classes.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    least = named.groupBy("comp").agg(first, F.sum("copies").alias("size")).select("comp", *[F.col(c).alias(to) for c, to in zip(split, ("component_id", "component_hash"))], "size")
    shared = stored(named.join(least.filter("size > 1"), "comp").select("set", *least.columns[1:-1]), "near-names")
    more = ["text_hash"] if by_text else []
    # sets that are empty get keys of their own and so spread over all tasks; a key that happens to be a set's is ruled out by `real`
    real = F.col("n_shingles") > 0
    key = F.when(F.col("n") > 0, F.col("set")).otherwise(F.xxhash64("doc_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), key.alias("set"), *more).join(shared, "set", "left")
    out = out.withColumns({c: F.when(real, F.col(c)) for c in shared.columns[1:]})
    hashes = ["text_hash", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_hash", "text_hash")).alias("component_hash")] if by_text else []
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *hashes)
