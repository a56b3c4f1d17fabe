"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Up to so many links (16 bytes each) a task can take those of one node whole.
MANY = 1 << 23


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node that a link (a, b) names.

    Minima are pre-aggregated and joined back. Beyond MANY links they are written first: both sides of the join are then shuffles of
    stored rows, so Spark's adaptive plan splits the links of a node that has very many over several tasks. Every step is written to the
    shared folder, which cuts the lineage. The number of steps grows with the logarithm of the longest chain.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before, count = None, edges.count()
    while True:
        settled = (lambda t: stored(t, "cc-least")) if count > MANY else (lambda t: t)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = settled(least)
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settled(large)
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_000_007))).first()
        if now == before:
            break
        before, count = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
