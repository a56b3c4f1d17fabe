import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from panelspark.llm import bpe, packing, token_store
from panelspark.llm.common import shared_path

tokenizers, tiktoken = pytest.importorskip("tokenizers"), pytest.importorskip("tiktoken")


def library(name):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def order(rows):
    """By doc_id, null first, then by Spark's hash of the text."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_token_store(spark, request, which):
    df, ids = request.getfixturevalue(which), library("byte_bpe_50k.json")
    path = shared_path(spark, "t")
    token_store.write_tokens(df, path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    start, want = 0, []
    for doc, text in order(df.select("doc_id", "text").collect()):
        x = np.array([*ids(text), 2], "<u4")
        want.append((doc, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    got = [tuple(r) for r in token_store.checksums(spark, path).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    some = token_store.read_tokens(spark, path, 4, 6)
    assert {r.doc_id for r in some.collect()} <= {4, 5, 6}
    assert "GreaterThanOrEqual(doc_id,4)" in some._jdf.queryExecution().toString()


def test_store_is_dictionary_and_delta_coded(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "s")
    token_store.write_tokens(docs, "file://" + path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    meta = pq.ParquetFile(glob.glob(path + "/*.parquet")[0]).metadata
    cols = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in cols["tokens.list.element"].encodings and "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
    assert cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_bpe(request, which):
    df, path = request.getfixturevalue(which), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in df.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe.round_trip(df, path).collect()), key=key) == sorted(want, key=key)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        assert bytes(r.bytes).decode() == text[r.doc_id]


def test_bpe_on_unlisted_characters():
    """Characters of all planes, whose classes differ between Unicode versions, next to apostrophes, spaces and digits."""
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    points = [c for c in rng.integers(0, 0x110000, 40000).tolist() if not 0xD800 <= c < 0xE000]
    near = ["'", "'s", " ", "a", "7", "\n", "\u3000", "\ud55c", "\U00010EE4", "\u0378"]
    texts = ["".join(chr(points[(7 * i + k) % len(points)]) + near[int(rng.integers(len(near)))] for k in range(4)) for i in range(5000)]
    ids, place = bpe.bpe(path).encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(place[:-1], place[1:])] == [own.encode_ordinary(t) for t in texts]


def test_store_of_no_documents(spark, no_docs):
    path = shared_path(spark, "t")
    token_store.write_tokens(no_docs, path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    assert token_store.checksums(spark, path).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_packing(request, which):
    df, ids = request.getfixturevalue(which), library("word_bpe_49k.json")
    pieces, store = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), end=1, window=256)
    rows = pieces.collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append(np.array([*ids(r.text), 1], "<u4"))
    total = sum(len(x) for xs in want.values() for x in xs)
    assert sum(r.length for r in rows) == total
    for r in rows:
        x = next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    by_seq, padded = {}, 0
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padded += 0 if at & (at - 1) == 0 else 256 - at
    assert padded <= 0.02 * total + 256
    if which == "docs":
        made = {r.sequence_id: r.ids for r in packing.sequences(pieces, store, public_tokenizers.path("word_bpe_49k.json")).collect()}
        assert {k: len(v) for k, v in made.items()} == {k: sum(n for _, n in v) for k, v in by_seq.items()}


def test_packed_sequences_hold_null_and_repeated_ids(spark):
    long = " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([(None, "no id here"), (None, long), (1, "one text"), (1, "another text of the same id"), (1, long[::-1]), (2, "")], "doc_id long, text string")
    pieces, store = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), end=1, window=256)
    made = {r.sequence_id: np.array(r.ids, "<u4") for r in packing.sequences(pieces, store, public_tokenizers.path("word_bpe_49k.json")).collect()}
    rows = pieces.collect()
    assert sum(map(len, made.values())) == sum(r.length for r in rows)
    assert all(zlib.crc32(made[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32 for r in rows)


def test_plan_stays_within_supply():
    h = np.zeros(2048, np.int64)
    h[[1500, 548, 274, 1024]] = [1000, 300, 500, 7]
    plan = packing.Plan(h, 2048)
    assert (plan.planned <= h).all() and plan.planned[1500] == 550 and plan.planned[1024] == 6
    lengths, ranks = np.repeat([548, 274], [300, 500]), np.concatenate([np.arange(300), np.arange(500)])
    seq, off = plan.places(lengths, ranks)
    assert len(set(zip(seq.tolist(), off.tolist()))) == 800
