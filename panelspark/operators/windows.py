"""Window operators over panels: what a row may know is what lies before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import tied_ranks


def by(keys: list[str], *order: Column | str):
    return Window.partitionBy(*keys).orderBy(*order)


def prior_mean(df: DataFrame, keys: list[str], order: str, value: str, to: str, least: int = 3) -> DataFrame:
    """The mean of all earlier rows, where at least `least` have a value."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(to, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def anomalies(df: DataFrame, keys: list[str], order: str, value: str, to: str = "anomaly", least: int = 3) -> DataFrame:
    """The value less the mean of earlier rows."""
    return prior_mean(df, keys, order, value, "__m", least).withColumn(to, F.col(value) - F.col("__m")).drop("__m")


def prior_k_mean(df: DataFrame, keys: list[str], order: str, value: str, k: int, to: str) -> DataFrame:
    """The mean of the k rows before, all of which must have a value."""
    w = by(keys, order).rowsBetween(-k, -1)
    return df.withColumn(to, F.when(F.count(value).over(w) == k, F.avg(value).over(w)))


def causal_trend(df: DataFrame, keys: list[str], year: str, value: str, least: int = 3) -> DataFrame:
    """A line through the earlier years' values, taken to the row's own year: trend, trend_n, trend_slope, trend_intercept, trend_first, trend_last.

    Years are centred on their mean, so that large years cost no digits.
    """
    w = by(keys, year).rangeBetween(Window.unboundedPreceding, -1)
    x, y = F.col(year).cast("double"), F.col(value)
    seen = F.when(y.isNotNull(), x)
    df = df.withColumns({"trend_n": F.count(value).over(w), "__mx": F.avg(seen).over(w), "__my": F.avg(y).over(w), "__s": F.regr_slope(y, x).over(w), "trend_first": F.min(F.when(y.isNotNull(), F.col(year))).over(w), "trend_last": F.max(F.when(y.isNotNull(), F.col(year))).over(w)})
    ok = F.col("trend_n") >= least
    df = df.withColumns({"trend": F.when(ok, F.col("__my") + F.col("__s") * (x - F.col("__mx"))), "trend_slope": F.when(ok, F.col("__s")), "trend_intercept": F.when(ok, F.col("__my") - F.col("__s") * F.col("__mx"))})
    return df.drop("__mx", "__my", "__s")


def rolling_sum(df: DataFrame, keys: list[str], order: str, value: str, rows: int, to: str) -> DataFrame:
    return df.withColumn(to, F.sum(value).over(by(keys, order).rowsBetween(1 - rows, 0)))


def season_cumsum(df: DataFrame, keys: list[str], order: str, value: str, to: str) -> DataFrame:
    """The running sum; NULL where the row's own value is missing."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.when(F.col(value).isNotNull(), F.sum(value).over(w)))


def season_mean(df: DataFrame, keys: list[str], order: str, value: str, to: str) -> DataFrame:
    return df.withColumn(to, F.avg(value).over(by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def season_weather(df: DataFrame, keys: list[str], order: str, sums: list[str], mean: str, recent: str) -> DataFrame:
    """The compact weather block: running sums, a running mean and the sum of the last two rows, in one pass over one window."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = {f"season_{c}": F.when(F.col(c).isNotNull(), F.sum(c).over(w)) for c in sums}
    return df.withColumns(out | {f"season_{mean}_mean": F.avg(mean).over(w), f"recent_{recent}": F.sum(recent).over(by(keys, order).rowsBetween(-1, 0))})


def pct_change(df: DataFrame, keys: list[str], order: str, value: str, to: str = "pct_change") -> DataFrame:
    before = F.lag(value).over(by(keys, order))
    return df.withColumn(to, 100 * F.try_divide(F.col(value) - before, before))


def holm(df: DataFrame, p: str, family: list[str], ties: list[str], to: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family; missing ones stay missing and don't count. `ties` orders equal values."""
    w = Window.partitionBy(*family, F.col(p).isNull()).orderBy(p, *ties)
    m = F.count(p).over(Window.partitionBy(*family))
    df = df.withColumn("__r", F.row_number().over(w)).withColumn("__x", F.col(p) * (m - F.col("__r") + 1))
    return df.withColumn(to, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__x").over(w.rowsBetween(Window.unboundedPreceding, 0))))).drop("__r", "__x")


def avg_rank(df: DataFrame, keys: list[str], value: Column | str, to: str = "rank") -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs (NULLs come first). Ranks are counted over ranges of values, so a key may hold all rows."""
    c = F.col(value) if isinstance(value, str) else value
    ranks = tied_ranks(df, keys, c, "__rank").select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("value").alias("__value"), "__rank")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], F.col("__v").eqNullSafe(F.col("__value")))
    out = df.withColumn("__v", c).join(ranks, same, "left").withColumn(to, F.col("__rank"))
    return out.drop("__v", "__rank", "__value", *[f"__key_{k}" for k in keys])


def share_within(df: DataFrame, keys: list[str], value: str, to: str = "share") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(to, F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value), total)))


def best_scene(scenes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first scene of each key by the order given; one aggregate, no sort of all rows."""
    rest = [c for c in scenes.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("b")
    return scenes.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*order, *rest)])


def latest_status(ledger: DataFrame, keys: list[str], status: str = "status", seq: str = "seq") -> DataFrame:
    return ledger.groupBy(*keys).agg(F.max_by(status, seq).alias(status))


def alternating(hist: DataFrame, keys: list[str], order: str, value: str, to: str = "alternates") -> DataFrame:
    """Whether each value differs from the one before it, all along."""
    d = hist.withColumn("__p", F.lag(value).over(by(keys, order)))
    return d.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(F.col("__p").isNotNull(), F.col("__p") != F.col(value))), F.lit(False)).alias(to))


def portable_draw(*parts: Column | str) -> Column:
    """A number that any engine gets from the same parts: the first 8 hex digits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int, ties: list[str] | None = None, keyless_last: bool = False) -> DataFrame:
    """Up to n rows of each class without replacement, by a seeded hash of the key; `keyless_last`: rows without a key come after all others.

    Where keys repeat, `ties` say which rows come first; without them Spark may take any.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary"))
    w = Window.partitionBy(label).orderBy(*([F.col(key).isNull()] if keyless_last else []), draw, F.col(key).asc_nulls_last(), *(ties or []))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
