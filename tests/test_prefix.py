"""Running sums, ranks and quantiles by ranges, and the interval join by bins, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import joins, prefix, windows


def test_running_sums_cross_ranges(spark):
    rows = [(k, i, (i * 7 + len(str(k))) % 5) for k in (None, "a", "b", "c") for i in range(900 if k == "b" else 3)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    dealt = prefix.ranged(df, ["k"], ["i"], ranges=5)
    assert dealt.filter("k = 'b'").select(prefix.RANGE).distinct().count() > 1  # the large key covers several ranges
    got = {(r.k, r.i): (r.s, r.n) for r in prefix.running(dealt, ["k"], ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    want, at = {}, {}
    for k, i, v in rows:
        s, n = at.get(k, (0, 0))
        want[k, i], at[k] = (s, n), (s + v, n + 1)
    assert got == want


def test_running_without_keys_and_rows(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 3)
    got = prefix.running(prefix.ranged(df, [], ["id"], ranges=7), [], ["id"], {"s": F.col("v")}).collect()
    assert {r.id: r.s for r in got} == {i: sum(j % 3 for j in range(i)) for i in range(1000)}
    assert prefix.running(prefix.ranged(df.limit(0), [], ["id"]), [], ["id"], {"s": F.col("v")}).count() == 0


def test_average_ranks_of_one_group(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"g": "all", "v": np.where(rng.random(3000) < 0.3, 5.0, rng.integers(0, 700, 3000).astype(float))})
    got = windows.avg_rank(spark.createDataFrame(x), ["g"], "v").toPandas()
    want = x.v.rank().sort_values().tolist()
    assert sorted(got["rank"].tolist()) == want
    plan = windows.avg_rank(spark.createDataFrame(x), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(3)
    x = pd.concat([pd.DataFrame({"g": g, "v": rng.normal(size=n).round(1)}) for g, n in enumerate([1, 2, 5, 40, 3000])])
    df = spark.createDataFrame(x).unionByName(spark.createDataFrame([(9, None), (3, float("nan"))], "g int, v double").withColumn("g", F.col("g").cast("long")))
    got = {r.g: (r.a, r.b, r.c) for r in prefix.grouped_quantiles(df, ["g"], F.col("v"), {"a": 0.0, "b": 0.31, "c": 1.0}).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    for g, part in x.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.v, [0.0, 0.31, 1.0]).tolist())


def test_contained_periods_by_bins(spark):
    rng = np.random.default_rng(4)
    day = lambda n: (pd.Timestamp("2020-01-01") + pd.to_timedelta(n, "D")).date
    s, i = rng.integers(0, 900, 60), rng.integers(0, 900, 300)
    outer = pd.DataFrame({"period": np.arange(60), "start": day(s), "end": day(s + rng.integers(0, 60, 60)), "forecast": day(s + rng.integers(0, 80, 60))})
    inner = pd.DataFrame({"i_start": day(i), "i_end": day(i + rng.integers(0, 9, 300)), "i_available": day(i + rng.integers(0, 20, 300))})
    inner = pd.concat([inner, inner.head(20)])  # repeated rows count each
    for width in (None, 1, 7, 400):
        got = {r.period: r.n_found for r in joins.contained_periods(spark.createDataFrame(outer), spark.createDataFrame(inner), width=width).collect()}
        want = {o.period: sum(o.start < o.end and n.i_start >= o.start and n.i_end <= o.end and n.i_available <= o.forecast for n in inner.itertuples()) for o in outer.itertuples()}
        assert got == want
