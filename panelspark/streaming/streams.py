"""Streaming forms of the causal batch rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_trailing(df: DataFrame, unit: str, ts: str, length: str, lateness: str, aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates of each unit's readings by window; readings later than the lateness are left out. Works on tables too."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = timed.groupBy(unit, w).agg(*aggs)
    return out.select(unit, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c not in (unit, "window")])


def stream_dedupe(df: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """The first arrival of each key within the lateness."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def stream_complete_periods(df: DataFrame, unit: str, ts: str, length: str, lag: str, expected: int) -> DataFrame:
    """Windows that have all their days; the watermark is the release lag, so nothing comes out before it has passed.

    Days are counted exactly: as the bits of their numbers within a window (`length` of 60 days at most).
    """
    day = F.pmod(F.unix_date(F.to_date(ts)), F.lit(60)).cast("int")
    days = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), day))).cast("bigint")
    out = stream_trailing(df, unit, ts, length, lag, [days.alias("n_days")])
    return out.filter(F.col("n_days") >= expected)


def arrivals(batches: list[DataFrame], path: str, files: int = 4, first: int = 0) -> int:
    """Writes batches of rows (the first has the number `first`), one after the other, as files of a folder that a stream reads; gives how many files each batch has.

    Each batch is dealt evenly to `files` files (of a batch with fewer rows some may be missing: then the next batch moves up).
    """
    for i, rows in enumerate(batches, first):
        rows.repartition(files).write.parquet(f"{path}/arrival={i}")
    return files


def landed(spark, source: str, schema, job, sink: str, files: int | None = None) -> tuple[DataFrame, int]:
    """Runs a streaming job over all files that are there, in the order of their arrival, to its end; the sink's rows, and how many groups came too late.

    job: from the streaming rows to the rows of the sink (append). files: how many a micro-batch takes. The folder `sink` holds the rows
    and the checkpoint, so a run that was cut off goes on where it was, and one that is over adds only what has arrived since.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or 1_000).parquet(source)
    out = job(rows)
    query = out.writeStream.format("parquet").outputMode("append").option("path", f"{sink}/rows").option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(out.schema).parquet(f"{sink}/rows"), late
