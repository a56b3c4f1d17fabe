"""Mixing, the trie of conversations and hard negatives against brute force, on odd rows too."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversations, hard_negatives, mixing, sql

WORDS = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def level_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """The excess of those above their limit goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in full)
        level = (left - sum(most * sizes[s] for s in full)) / free if free else 0
        new = {s for s in sizes if s not in full and level * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= new


@pytest.fixture(scope="module")
def odd_mix(spark, odd_docs):
    more = spark.range(400).select((F.col("id") + 100).alias("doc_id"), F.concat_ws(" ", F.lit("words of"), "id", F.lit("é中 x")).alias("text"), F.when(F.col("id") % 7 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    docs = odd_docs.withColumn("source", F.when(F.col("doc_id") < 4, F.lit("Ä")).when(F.col("doc_id") < 9, F.lit("")))  # others have none
    return docs.unionByName(more, allowMissingColumns=True).unionByName(spark.createDataFrame([(900, None, "nothing"), (901, "  ", "nothing")], "doc_id long, text string, source string"), allowMissingColumns=True)


@pytest.mark.parametrize("which", ["odd_mix", "docs"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.copies(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, WORDS(r.text)) for r in df.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
    want = level_targets(dict(sizes))
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in rows:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert int(rate + 1e-9) <= r.copies <= int(rate + 1e-9) + 1 or r.copies == 2 and rate == pytest.approx(2)
        assert r.copies <= 2
    off = sum(abs(taken[s] - want[s]) for s in want)
    assert off < 0.12 * sum(want.values())
    assert Counter(mixing.copies(df.repartition(3)).collect()) == Counter(rows)  # reruns agree


def test_mixed_corpus(spark, odd_mix):
    copies = {(r.doc_id, r.source): r.copies for r in mixing.copies(odd_mix).collect() if r.doc_id is not None and r.doc_id >= 100}
    out = mixing.emit(odd_mix)
    assert out.columns == odd_mix.columns
    got = Counter((r.doc_id, r.source) for r in out.collect() if r.doc_id is not None and r.doc_id >= 100)
    assert got == Counter({k: n for k, n in copies.items() if n})
    assert {r.n for r in out.filter("n is not null").select("n").distinct().collect()} == {"clash"}


def test_mixing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.copies(none).count() == 0 and mixing.emit(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.copies(blank).collect()] == [(0, 0.0, 0)] * 2


# conversations

def trie(df):
    conv = F.col("conv_id")
    return conversations.trie(df, base=conv - conv % 20, head=F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4)).cast("int"), longest=3)


def brute_trie(rows: list) -> Counter:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            signed = [int(digest[i : i + 16], 16) for i in range(0, 64, 16)]
            own[conv].append((turn is not None, turn or 0, role, [d - (1 << 64) if d >> 63 else d for d in signed], text))
    seq = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = sorted(own.get(c - c % 20, []))[:h]
        seq[c] = [(t[2], t[4]) for t in base + sorted(turns)[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * (WORDS(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


def found_trie(df) -> Counter:
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie(df).collect())


def test_trie_of_odd_conversations(spark):
    say = lambda i: f"turn {i} of ten words é"
    rows = [(c, t, "user" if t % 2 else None, say(t) if t < 3 or c % 3 else None) for c in range(0, 64) if c not in (20, 41) for t in range(c % 7)]
    rows += [(1, None, "late", "first of all"), (1, None, "", "second"), (2, 1, "user", say(1)), (2, 1, "user", say(1)), (2, 1, "bot", "a tie")]  # null turns, repeats, ties
    rows += [(None, 1, "user", "nobody"), (5, 9, "", ""), (6, 9, "user", "x " * 60000), (7, 9, "us", "er" + say(1)), (7, 10, "user", say(1)), (-3, 1, "user", say(0)), (10**15, 1, "user", say(0)), (43, 1, "user", say(0))]
    rows += [(60, t, "user", f"long {t % 5}") for t in range(10, 700)]  # one holds most turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("depth", "pos", "n", "words", "d0", "head")})
    assert found_trie(df) == brute_trie(rows)
    assert found_trie(df.repartition(5)) == brute_trie(rows)
    assert trie(df.limit(0)).count() == 0


def test_trie_with_conversations_over_several_ranges(spark, monkeypatch):
    from panelspark.operators import prefix

    monkeypatch.setattr(conversations, "ranged", lambda df, keys, order, name: prefix.ranged(df, keys, order, name, ranges=6))
    rows = [(c, t, "user", f"text {t % 3} {c % 2 if t > 100 else 0}") for c in (0, 1, 2, 3, 21) for t in range(300)]
    assert found_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute_trie(rows)


def test_trie_checks_what_it_merges(spark, monkeypatch):
    one = spark.createDataFrame([(1, 1, 1, 1, "a", "x"), (1, 1, 1, 1, "a", "y")], "d0 long, d1 long, d2 long, d3 long, role string, text string")
    with pytest.raises(ValueError):
        conversations.verified(one)
    assert all(p % d for p in conversations.PRIMES for d in range(2, 46341))
    rows = [(c, t, "user", f"text {c} {t}") for c in range(40) for t in range(4)]
    monkeypatch.setattr(conversations, "PRIMES", (2, 3, 2))
    monkeypatch.setattr(conversations, "BASES", (1, 1, 1))
    with pytest.raises(Exception, match="same fingerprint"):
        found_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_ends_are_streamed(monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 3)
    ids = {0: list(range(10)), 1: [5], 2: list(range(7, 30, 2))}
    rows = [(1, k, 0, 0, i) for k, v in ids.items() for i in v]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 8])], names=[*conversations.KEY, "conv_id"]) for a in range(0, len(rows), 8)]
    runs = [r for b in conversations.pieces(iter(batches)) for r in b.to_pylist()]
    assert max(r["ids"].count(",") for r in runs) == 2
    back = pa.RecordBatch.from_pylist(runs)
    got = {r["f0"]: r["ends_sha256"] for b in conversations.hashed(iter([back.slice(0, 4), back.slice(4)])) for r in b.to_pylist()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}


# vectors


def brute_negatives(rows: list, size: int) -> Counter:
    able = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and max(map(abs, v)) < 2**20]
    out: Counter = Counter()
    for n, (a, lab, v) in enumerate(able):
        if a % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, other == lab) for m, (i, other, w) in enumerate(able) if m != n))
        for s, i, _ in [x for x in scored if x[2]][:5]:
            near = [(-t, j) for t, j, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out.update((a, i, r + 1, j, -s, t) for r, (t, j) in enumerate(near))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many blocks, clusters, chunks and slabs
        for name, value in {"BLOCK": 15, "CLUSTER": 2, "FIRST": 2, "CHUNK": 2, "SLAB": 4}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 4)), (middle[i % 6] + 0.4 * rng.normal(size=8)).round(2).tolist()) for i in range(400)]
    hot = [0.5] * 8
    rows += [(1000 + i, i % 2, hot) for i in range(0, 120)]  # a third of all, anchors among them
    rows += [(2000 + 50 * i, 1, [0.0] * 8) for i in range(3)] + [(2001, 2, [0.0] * 8), (2002, 1, [-1.0] * 8), (2100, 3, [-2.0] * 8)]
    rows += [(50, 2, rows[3][2]), (100, rows[100][1], rows[100][2]), (7, 1, hot)]  # repeated ids
    rows += [(3000, None, hot), (3050, 1, None), (3100, 1, [None] * 8), (3150, 1, [float("nan")] * 8), (3200, 1, [float("inf")] + [0.0] * 7), (3250, 1, [1.0, 2.0]), (3300, 0, [1e30] * 8), (None, 1, hot), (3350, 77, hot), (3400, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("clash") for c in ("rid", "v", "norm", "cluster", "rank", "score")})
    got = Counter(tuple(r) for r in hard_negatives.mined(df.repartition(3)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows, 8)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(50, 1, None)], [(1, 1, [1.0, 2.0])], [(50, 1, [0.0])]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        assert hard_negatives.mined(df).count() == 0


def test_sql_agrees_with_brute_force(spark):
    """The SQL that queries are held against gives what the loops here give."""
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    cols = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert Counter(con.execute(f"SELECT {cols} FROM ({sql.TRIE})").fetchall()) == brute_trie(rows)
