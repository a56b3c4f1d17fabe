"""Exact quantiles of very many values: a few scans that count, no sort, no task that holds a column's distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes into which each open interval is counted in one scan.
CLASSES = 1024


def exact_quantiles(rows: DataFrame, key: str, value: str, probs: list[float]) -> dict[str, list[float]]:
    """For each key (few: columns, bands, report groups) the quantiles of its values, linear between neighbours as `percentile` has them.

    Each scan counts the values of an interval in classes and keeps the class that holds the wanted rank, until it holds one value.
    NULL and NaN don't count; a key without values isn't in the result.
    """
    rows = rows.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v")).filter("k is not null and v is not null and not isnan(v)")
    ends = {r["k"]: r for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    state = {}  # key, rank -> low, high, rows before low
    for k, r in ends.items():
        for p in probs:
            at = p * (r["n"] - 1)
            for rank in {int(at), min(int(at) + 1, r["n"] - 1)}:
                state[k, rank] = (r["low"], r["high"], 0)
    while wanted := sorted({(k, low, high) for (k, _), (low, high, _) in state.items() if low < high}):
        number = {w: i for i, w in enumerate(wanted)}
        spans = rows.sparkSession.createDataFrame([(i, *w) for w, i in number.items()], "i int, k string, low double, high double")
        step = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * CLASSES)
        inside = rows.join(F.broadcast(spans), "k").filter("v between low and high").withColumn("c", F.when(F.col("v") == F.col("high"), CLASSES).otherwise(F.least(step, F.lit(CLASSES - 1))))  # a row for each key and wanted rank
        counted: dict[int, list] = {}
        for r in inside.groupBy("i", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            counted.setdefault(r["i"], []).append((r["c"], r["n"], r["low"], r["high"]))
        for (k, rank), (low, high, before) in state.items():
            if low < high:
                for _, n, a, b in sorted(counted[number[k, low, high]]):
                    if before + n > rank:
                        state[k, rank] = (a, b, before)
                        break
                    before += n
    out = {}
    for k, r in ends.items():
        found = []
        for p in probs:
            at = p * (r["n"] - 1)
            a, b = state[k, int(at)][0], state[k, min(int(at) + 1, r["n"] - 1)][0]
            found.append(a + (b - a) * (at - int(at)))
        out[k] = found
    return out
