"""Scores of texts by an n-gram model of the corpus: an Elias-Fano trie in shards, each built and queried in one task.

Texts become blocks of about `BLOCK` tokens. A block deals its distinct words and word pairs, with their counts in training texts, out to
shards by the hash of the word (of the first word for pairs; pairs of very common first words by the second, so no shard gets
a common word's pairs alone). A shard adds up the counts of all blocks, builds its trie in memory-mapped files, answers each
block's pairs with quantised probabilities and its words with their counts. Each block then scores its documents. What moves
are distinct words and pairs by block, never the corpus, its vocabulary or the model as a whole.

Model: P(w | c) = n(c, w) / (n(c) + K) + K / (n(c) + K) * P1(w), with P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), counts from training texts;
the first word follows a mark of its own. P of a text is the product over its tokens, the end included.

Words are told apart by 64-bit hashes, a word's successors by 40 bits of theirs (a word with a million different successors would have one
collision in two corpora). Null or empty texts are the end token alone; very long texts are scored as a whole. Rows that
repeat count and are scored each; a null doc_id counts as an empty id. Without training texts all counts are 0. An empty table gives no rows.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, M1, M2, U, WORD, chunks, flat, hash_ranges, mix, stored, texts_of, word_ranges
from .elias_fano import Trie, dequantise

BLOCK, K = 2_000_000, 10.0
END, START = 0x9D5C0F3B7A1E2468, 0x3141592653589793
#: Words that make up at least this share of the training tokens of some run of documents may count as common; so many at most.
COMMON_SHARE, COMMON = 0.002, 250


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % folds == 1


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text, and tokens by text."""
    buf, offsets = flat(batch.column("text"))
    buf = LOWER[buf]
    starts, lengths, first = word_ranges(buf, offsets, WORD)
    return np.insert(hash_ranges(buf, starts, lengths), first[1:], np.uint64(END)), np.diff(first) + 1


def pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True) if len(a) else b""


def pack_ranks(rank: np.ndarray) -> bytes:
    """Byte by byte of all ranks, as bytes of the same place compress together."""
    return pack(np.ascontiguousarray(rank.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def unpack_ranks(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, 4 * n, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int32)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def survey(docs: DataFrame, folds: int) -> DataFrame:
    """word, n: training counts of words that are common in some run of documents, and (word null) all training tokens; all tokens; training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4_000_000):
            t, lens = tokens(batch)
            train = np.array([not held_out(i, folds) for i in batch.column("doc_id").to_pylist()])
            some = t[np.repeat(train, lens)]
            words, n = np.unique(some, return_counts=True)
            keep = (n >= COMMON_SHARE * len(some)) & (words != np.uint64(END))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *words[keep].astype(np.int64).tolist()], pa.int64()), pa.array([len(some), *n[keep].tolist()], pa.int64()), pa.array([len(t), *[0] * int(keep.sum())], pa.int64()), pa.array([int(train.sum()), *[0] * int(keep.sum())], pa.int64())],
                names=["word", "n", "tokens", "texts"],
            )

    return texts_of(docs).mapInArrow(run, "word long, n long, tokens long, texts long")


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hashes * M1 + M2) % U(shards)).astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct values, and each value's place among them in four bytes."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1], new[1:] = True, ordered[1:] != ordered[:-1]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def pair_order(context: np.ndarray, token: np.ndarray, common: np.ndarray, shard: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by shard, then context and token rank: their keys, shards, and for each token its pair's place. `start`: the rank of the text's start."""
    keys, inverse = distinct(context.astype(np.int64) << 32 | token)
    c, w = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
    spread = (c == start) | common[np.minimum(c, len(common) - 1)]
    to = np.where(spread, shard[w], shard[np.minimum(c, len(shard) - 1)])
    order = np.argsort(to, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return keys[order], to[order], place[inverse]


def contexts_of(rank: np.ndarray, lens: np.ndarray, start: int) -> np.ndarray:
    out = np.empty(len(rank), np.int32)
    out[1:] = rank[:-1]
    out[np.cumsum(lens) - lens] = start
    return out


#: Bytes of a successor's hash that move and are kept.
WIDTH = 5


def successors_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(64 - 8 * WIDTH)


def pack_wide(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpack_wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


BLOCKS = "block long, shard int, n_words int, words binary, counts binary, n_contexts int, contexts binary, is_context binary, n_next binary, n_pairs int, successors binary, pair_counts binary, docs binary, lens binary, ranks binary, sizes binary, common binary"


def blocks(docs: DataFrame, folds: int, shards: int, common: list[int]) -> DataFrame:
    """One row for each block and shard (its words and pairs), and one with shard -1 for the block itself (its texts as ranks of words)."""
    common_hashes = np.array(sorted(common), np.uint64)

    def rows(number: int, ids: list, t: np.ndarray, lens: np.ndarray) -> Iterator[dict]:
        words, rank = distinct(t)
        n_tokens = len(t)
        del t
        shard = shard_of(words, shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words, shard, rank = words[order], shard[order].astype(np.int32), place[rank]
        train = np.repeat(np.array([not held_out(i, folds) for i in ids]), lens)
        counts = np.bincount(rank[train], minlength=len(words)).astype(np.uint32)
        is_common = np.isin(words, common_hashes)
        start = len(words)
        keys, to, at = pair_order(contexts_of(rank, lens, start), rank, is_common, shard, start)
        pair_counts = np.bincount(at[train], minlength=len(keys)).astype(np.uint32)
        del at, train
        word_cut, pair_cut = np.searchsorted(shard, np.arange(shards + 1)), np.searchsorted(to, np.arange(shards + 1))
        known = np.array([i is not None for i in ids])
        yield {"block": number, "shard": -1, "n_words": len(words), "n_pairs": n_tokens, "n_contexts": len(ids), "docs": pack(np.array([i or 0 for i in ids], np.int64)), "lens": pack(lens.astype(np.uint32)), "ranks": pack_ranks(rank), "sizes": pack(np.diff(word_cut).astype(np.uint32)), "common": pack(np.flatnonzero(is_common).astype(np.uint32)), "contexts": pack(known.astype(np.uint8)), "n_next": b"%d" % int(is_common.sum())}
        del rank
        hashes = np.append(words, np.uint64(START))
        for s in range(shards):
            a, b, p, q = word_cut[s], word_cut[s + 1], pair_cut[s], pair_cut[s + 1]
            if a == b and p == q:
                continue
            c, w = keys[p:q] >> 32, keys[p:q] & 0xFFFFFFFF
            lead = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if q > p else np.zeros(0, np.int64)
            owners = c[lead]
            own = (owners >= a) & (owners < b)  # the others are common words and the start: some come before these, some after
            is_context = np.zeros(b - a, bool)
            is_context[owners[own] - a] = True
            low = int((owners < a).sum())
            yield {"block": number, "shard": s, "n_words": b - a, "words": pack(words[a:b]), "counts": pack(counts[a:b]), "n_contexts": low, "contexts": hashes[owners[~own]].tobytes(), "is_context": np.packbits(is_context).tobytes(), "n_next": pack(np.diff(np.append(lead, q - p)).astype(np.uint32)), "n_pairs": q - p, "successors": pack_wide(successors_of(words[w])), "pair_counts": pack(pair_counts[p:q])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, held, lens, size = [], [], [], 0
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in BLOCKS.split(", "))])

        def flush() -> Iterator[pa.RecordBatch]:
            for r in rows(part << 24 | nth, ids, np.concatenate(held), np.concatenate(lens)):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name)], f.type) for f in schema], schema=schema)

        for batch in chunks(batches):
            t, n = tokens(batch)
            ids, size = ids + batch.column("doc_id").to_pylist(), size + len(t)
            held.append(t)
            lens.append(n)
            if size >= BLOCK:
                yield from flush()
                ids, held, lens, size, nth = [], [], [], 0, nth + 1
        if ids:
            yield from flush()

    return texts_of(docs).mapInArrow(run, BLOCKS)


def asked_by(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a block's pairs, how many successors each has, and these."""
    words, others = unpack(row["words"], row["n_words"], np.uint64), np.frombuffer(row["contexts"], np.uint64)
    own = words[np.unpackbits(np.frombuffer(row["is_context"], np.uint8), count=row["n_words"]).astype(bool)]
    contexts = np.concatenate([others[: row["n_contexts"]], own, others[row["n_contexts"] :]])
    return contexts, unpack(row["n_next"], len(contexts), np.uint32).astype(np.int64), unpack_wide(row["successors"])


def answers(dealt: DataFrame, common: dict[int, int]) -> DataFrame:
    """block, shard, counts of the block's words, codes of its pairs; distinct: training words of the shard, on one of its rows.

    A shard's rows are its share of every block's distinct words and pairs; `shards` grows with the corpus, so that share doesn't.
    """

    def shard(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = np.concatenate([unpack(r["words"], r["n_words"], np.uint64) for r in rows])
        counts = np.concatenate([unpack(r["counts"], r["n_words"], np.uint32) for r in rows])
        vocabulary, rank = distinct(words)
        total = np.bincount(rank, weights=counts, minlength=len(vocabulary)).astype(np.int64)
        asked = [asked_by(r) for r in rows]
        pair_counts = np.concatenate([unpack(r["pair_counts"], r["n_pairs"], np.uint32) for r in rows])
        contexts, owner = distinct(np.concatenate([a[0] for a in asked]))
        owner = np.repeat(owner, np.concatenate([a[1] for a in asked]))
        keys, at = distinct(owner.astype(np.uint64) << U(8 * WIDTH) | np.concatenate([a[2] for a in asked]))
        n = np.bincount(at, weights=pair_counts, minlength=len(keys))
        base = np.zeros(len(contexts))
        if len(vocabulary):
            near = np.minimum(np.searchsorted(vocabulary, contexts), len(vocabulary) - 1)
            base = np.where(vocabulary[near] == contexts, total[near], 0).astype(float)
        for i, c in enumerate(contexts.tolist()):
            if c in common:
                base[i] = common[c]
        keys, n = keys[n > 0], n[n > 0]  # pairs of training texts
        own = (keys >> U(8 * WIDTH)).astype(np.int64)
        folder = tempfile.mkdtemp(prefix="trie-")
        try:
            trie = Trie(folder, contexts, own, keys & U((1 << 8 * WIDTH) - 1), n / (base[own] + K))
            codes = [trie.query(*a) for a in asked]
            del trie
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        cut = np.cumsum([r["n_words"] for r in rows])[:-1]
        found = np.split(total[rank].astype(np.uint32), cut)
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()), "counts": [pack(x) for x in found], "codes": [pack(x) for x in codes], "n_words": pa.array([r["n_words"] for r in rows], pa.int32()), "n_pairs": pa.array([r["n_pairs"] for r in rows], pa.int32()), "distinct": pa.array([int((total > 0).sum()), *[0] * (len(rows) - 1)], pa.int64())})

    need = dealt.filter("shard >= 0").select("block", "shard", "n_words", "words", "counts", "n_contexts", "contexts", "is_context", "n_next", "n_pairs", "successors", "pair_counts")
    return need.groupBy("shard").applyInArrow(shard, "block long, shard int, counts binary, codes binary, n_words int, n_pairs int, distinct long")


def score(docs: DataFrame, folds: int = 5, tokens_a_shard: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from texts whose crc32(doc_id as text) mod folds isn't 1.
    """
    seen = survey(docs, folds).groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"))
    seen = stored(seen, "lm-survey")
    whole = seen.filter("word is null").first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if whole is None:
        return docs.sparkSession.createDataFrame([], schema)
    n_train, n_texts = int(whole["n"]), int(whole["texts"])
    listed = [int(np.int64(r[0]).astype(np.uint64)) for r in seen.filter("word is not null").orderBy(F.desc("n"), "word").limit(COMMON).select("word").collect()]
    shards = max(12, -(-int(whole["tokens"]) // tokens_a_shard))
    every = stored(blocks(docs, folds, shards, listed), "lm-blocks")
    # full counts of the common words come from the blocks, as runs in which a word was rare told nothing
    full = common_counts(every, listed)
    found = stored(answers(every, full | {START: n_texts}), "lm-answers")
    n_distinct = int(found.agg(F.sum("distinct")).first()[0] or 0)
    floor = n_train + 0.5 * (n_distinct + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = left.to_pylist()[0]
        n_docs = b["n_contexts"]
        ids, lens = unpack(b["docs"], n_docs, np.int64), unpack(b["lens"], n_docs, np.uint32).astype(np.int64)
        known_id = unpack(b["contexts"], n_docs, np.uint8)
        rank = unpack_ranks(b["ranks"], b["n_pairs"])
        sizes = unpack(b["sizes"], shards, np.uint32)
        shard = np.repeat(np.arange(shards), sizes)
        is_common = np.zeros(b["n_words"], bool)
        is_common[unpack(b["common"], int(b["n_next"]), np.uint32)] = True
        got = sorted(right.to_pylist(), key=lambda r: r["shard"])
        counts = np.concatenate([unpack(r["counts"], r["n_words"], np.uint32) for r in got]).astype(float)
        codes = np.concatenate([unpack(r["codes"], r["n_pairs"], np.uint16) for r in got])
        start = b["n_words"]
        context = contexts_of(rank, lens, start)
        _, _, at = pair_order(context, rank, is_common, shard, start)
        p1 = (counts + 0.5) / floor
        n_context = np.append(counts, n_texts)[context]
        p = dequantise(codes[at]) + K / (n_context + K) * p1[rank]
        cut = np.cumsum(lens) - lens
        names = [int(i) if k else None for i, k in zip(ids.tolist(), known_id.tolist())]
        return pa.table(
            {
                "doc_id": pa.array(names, pa.int64()),
                "held_out": pa.array([held_out(i, folds) for i in names], pa.bool_()),
                "n_tokens": pa.array(lens),
                "n_known": pa.array(np.add.reduceat((counts[rank] > 0).astype(np.int64), cut)),
                "train_tokens": pa.array(np.full(n_docs, n_train, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(p1)[rank], cut)),
                "score": pa.array(np.add.reduceat(np.log10(p), cut)),
            }
        )

    own = every.filter("shard < 0").select("block", "n_words", "n_pairs", "n_contexts", "contexts", "n_next", "docs", "lens", "ranks", "sizes", "common")
    return own.groupBy("block").cogroup(found.drop("distinct").groupBy("block")).applyInArrow(finish, schema)


def common_counts(every: DataFrame, listed: list[int]) -> dict[int, int]:
    """Training counts of the common words (COMMON at most), from the blocks' rows."""
    if not listed:
        return {}
    wanted = np.array(sorted(listed), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for r in batch.to_pylist():
                words = unpack(r["words"], r["n_words"], np.uint64)
                at = np.minimum(np.searchsorted(words, wanted), max(len(words) - 1, 0))
                hit = np.flatnonzero(words[at] == wanted) if len(words) else []
                counts = unpack(r["counts"], r["n_words"], np.uint32)
                for i in hit:
                    out[int(wanted[i])] = out.get(int(wanted[i]), 0) + int(counts[at[i]])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out), np.uint64).astype(np.int64)), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

    rows = every.filter("shard >= 0").select("n_words", "words", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    return {int(np.int64(w).astype(np.uint64)): int(n) for w, n in rows}
