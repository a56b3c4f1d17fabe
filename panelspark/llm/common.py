"""What the operators share: the shared folder, Arrow batches as flat bytes, hashing of byte ranges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time.
CHUNK_BYTES = 800_000

U = np.uint64
#: Odd 64-bit multipliers for mixing.
M1, M2, M3, M4 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)
#: Masks that keep the first n of 8 little-endian bytes.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); a local folder where that is unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `size` bytes of text each, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def give_back() -> None:
    """Hands memory that is free, but kept by the allocators of this Python worker, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run: Callable) -> Callable:
    """The same function of a task's batches, before and after which the worker gives free memory back: workers live on, and serve other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task, where these are a bounded sample; None if there are none."""
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some) if some else None


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as bytes and offsets; the bytes are followed by 32 zeros, so windows may reach over the end."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    buf = np.zeros(len(raw) + 32, np.uint8)
    buf[: len(raw)] = raw
    return buf, offsets - offsets[0]


def windows8(buf: np.ndarray) -> np.ndarray:
    """Every 8 bytes from each position on, as little-endian integers."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * M4
    h = (h ^ (h >> U(29))) * M2
    return h ^ (h >> U(32))


def hash_ranges(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal bytes give equal hashes, in every task and on every machine."""
    win, last = windows8(buf), len(buf) - 8
    h = lengths.astype(np.uint64) * M3
    live, k = np.arange(len(starts)), 0
    while len(live):
        at = np.minimum(starts[live] + 8 * k, last)
        word = win[at] & KEEP[np.minimum(lengths[live] - 8 * k, 8)]
        h[live] = mix((h[live] ^ word) * M1 + U(k + 1))
        k += 1
        live = live[lengths[live] > 8 * k]
    return h


#: True for the white space that bounds words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_ranges(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of all rows, and the first word's number by row (with one more at the end)."""
    n = int(offsets[-1])
    inside = is_word[buf[:n]]
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


WORD = ~SPACE
