"""Token-ID output: token ids of every document in Parquet list columns, in ascending doc_id order.

File format. One row a document, sorted within each file and from file to file: doc_id, part (the file's rank), local_start (ids
before the document in its file), n_tokens, tokens (list of ids). Token ids are dictionary-encoded (a vocabulary
fits in a dictionary page, so an id takes about 2 bytes); the numbers beside them are delta-encoded (data pages v2).
Row groups are small and pages have a bounded number of rows; Parquet's page indexes on the sorted doc_id let a reader open
the pages of a few documents, and column chunks let it read lengths without tokens.

Null or empty texts give the end id alone. Rows that repeat a doc_id are kept, in the order of xxhash64 of their text. A null doc_id sorts first.
Very long texts are rows like others. Special strings of the vocabulary in a text are read as the library reads them by default. An
empty table gives an empty store. Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, texts_of
from .encoders import encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int, row_group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """Encodes all texts and writes the store.

    One shuffle: the texts are dealt out by ranges of doc_id and a hash of the text, so that each task writes a file whose documents follow
    those of the file before. A range is a run of documents, whatever their source; a doc_id with very many texts has several.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, encode_batch = 0, TaskContext.get().partitionId(), encoder(vocabulary, "spaced")
        for batch in chunks(batches):
            ids, place = encode_batch(batch.column("text"), end)
            n = np.diff(place)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + place[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(ids.astype(np.int32)))], schema=ARROW)
            at += int(place[-1])

    (
        texts_of(docs)
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .drop("h")
        .mapInArrow(encode, SCHEMA)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def starts(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Puts start (ids of all documents before) in the place of part and local_start; `store` gives the lengths of all documents."""
    sums = store.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("part", "local_start", "before")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens, start (ids of all documents before it) of the documents with first <= doc_id <= last.

    Only the columns asked for are read; the bounds reach the scan, where page indexes leave out other pages. `start` needs the
    lengths of all documents, not their tokens: one sum a file, then a running sum over files.
    """
    store = spark.read.schema(SCHEMA).parquet(path)
    rows = store
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return starts(store, rows)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: unsigned crc32 of the ids read, as little-endian unsigned 32-bit integers.

    The ids become checksums where they are read; only numbers go on to the join.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offs = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            view = memoryview(raw).cast("B")
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "part", "local_start")), pa.array(np.diff(offs).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    store = spark.read.schema(SCHEMA).parquet(path)
    rows = store.drop("n_tokens").mapInArrow(crc, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return starts(store, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
