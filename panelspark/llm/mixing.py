"""Mixing sources to target weights: how often each document is to be repeated, and the mixed corpus.

A pass adds up the sizes (words) by source. Sources in code point order, NULL last, get weights in turn; targets share a multiple of all
sizes by weight and stop at a multiple of their own source's size, what is above going to the others. A source's rate is its target by its size: each document
is taken floor(rate) times, and once more where a number in [0, 1) from a seeded hash lies below the rate's fraction. DRAWS seeds are tried
in one more pass over sizes and hashes (not texts), and each source uses the one whose words come nearest its target: a few long documents
don't throw a small source off. All of it is DataFrame expressions.

A null text is empty; a document without words has size 0 and is taken like others of its source (which takes no words). A source without
words has rate 0. A null doc_id counts as an id of its own; rows that repeat both doc_id and text share their fate. Ties between seeds go to the first. An
empty table gives no rows. Further columns are ignored by `copies`, and returned as they are by `emit`. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.prefix import RANGE, ranged, running

from .common import stored

#: Seeds of which each source uses one; 8 hex digits of an md5 are a draw, so an md5 has four.
DRAWS = 16
#: A run of anything but white space is a word.
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> list[Column]:
    """doc_id, source, size and the md5 of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("digest")]


def draw(number: Column) -> Column:
    """The number in [0, 1) that a document has under the seed of this number."""
    name = F.concat_ws(":", F.floor(number / 4).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    digits = F.substr(F.md5(name.cast("binary")), F.pmod(number, F.lit(4)).cast("int") * 8 + 1, F.lit(8))
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target of a table of source and source_size; any number of sources.

    The level (target by unit of weight) is raised, a scan at a time, by what the sources above their limit can't take, until none is above.
    """
    order = [F.col("source").asc_nulls_last()]
    placed = running(ranged(sizes, [], order, "mix-order"), [], order, {"place": F.lit(1)})
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(placed.select("source", "source_size", turn.cast("double").alias("weight")), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, None
    while held is None or total:
        full = F.col("source_size") * most <= level * F.col("weight")  # at level 0: sources without words
        n, size, free = weighed.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not free:
            break
        level, held = (share * total - most * size) / free, n
    target = F.least(F.lit(level) * F.col("weight"), most * F.col("source_size").cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, whole (copies of every document), part (chance of one more), seed, taken_size; a row a source."""
    sizes = stored(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = stored(targets(sizes, weights, share, most).withColumn("rate", rate).withColumns({"whole": F.floor("rate"), "part": F.col("rate") - F.floor("rate")}).drop("rate"), "mix-rates")
    more = [F.sum(F.when(draw(F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"more_{k}") for k in range(DRAWS)]
    tried = beside(slim, rates).groupBy("source").agg(*more).withColumnRenamed("source", "of")
    found = rates.join(tried, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sums = [F.col("whole") * F.col("source_size") + F.col(f"more_{k}") for k in range(DRAWS)]
    off = F.array(*[F.abs(s - F.col("target")) for s in sums])
    seed = F.array_position(off, F.array_min(off)).cast("int") - 1
    taken = F.element_at(F.array(*sums), seed + 1)
    return stored(found.select("source", "source_size", "target", "whole", "part", seed.alias("seed"), taken.alias("taken_size")), "mix-plan")


def beside(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Each row beside its source's; Spark broadcasts the sources if they are few, and splits the rows of a large one if not."""
    return rows.join(by_source.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document. options: those of `plan`."""
    slim = stored(docs.select(*measured(docs)), "mix-documents")
    rows = beside(slim, plan(slim, **options))
    once_more = (draw(F.col("seed")) < F.col("part")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + once_more).alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the table's rows with their own columns, each as often as it is taken."""
    rows = docs.select(F.struct("*").alias("row"), *measured(docs))
    slim = stored(rows.drop("row"), "mix-documents")
    mixed = beside(rows, plan(slim, **options)).withColumn("copies", F.col("whole") + (draw(F.col("seed")) < F.col("part")).cast("long"))
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
