"""Running sums, ranks and quantiles by key where one key may hold any share of the rows.

A window by key sorts all rows of a key in one task. Here rows are dealt by ranges of (key, order), so a large key covers many ranges; sums run
within each range, and the sums of a key's earlier ranges are added. Only keys that cross a range's end need that, two a range at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.shared import written

RANGE = "__range"


def ranged(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "ranges", ranges: int | None = None) -> DataFrame:
    """The rows dealt by ranges of (keys, order) and written down with their range's number. Rows that are equal in all of these share a range.

    ranges: how many; else as many as the rows' volume asks for.
    """
    dealt = df.repartitionByRange(ranges, *keys, *order) if ranges else df.repartitionByRange(*keys, *order)
    return written(dealt.withColumn(RANGE, F.spark_partition_id()), name)


def running(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds to rows of `ranged` the sums over all earlier rows of the key (0 for its first). `order` must tell a key's rows apart.

    NULL keys are a key like others; NULL summands count as 0.
    """
    within = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({c: F.coalesce(F.sum(v).over(within), F.lit(0)) for c, v in sums.items()})
    total = {c: f"__total_{c}" for c in sums}
    totals = rows.groupBy(RANGE, *keys).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(total[c]) for c, v in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.withColumns({t: F.sum(t).over(earlier) for t in total.values()}).filter(F.col(next(iter(total.values()))).isNotNull())
    named = {k: f"__key_{k}" for k in (RANGE, *keys)}
    ahead = F.broadcast(ahead.withColumnsRenamed(named))  # a row a range at most: all other keys end where they begin
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    found = local.join(ahead, same, "left")
    return found.withColumns({c: F.col(c) + F.coalesce(t, F.lit(0)) for c, t in total.items()}).drop(*named.values(), *total.values())


def tied_ranks(df: DataFrame, keys: list[str], value: Column, rank: str = "rank", counts: dict[str, Column] | None = None) -> DataFrame:
    """A row for each key and value: value, n, rank (from 1; equal values share the mean of theirs) and the sums named in `counts`.

    Equal values are one row before anything is dealt out, so a value that many rows share is no task's work either.
    """
    per = df.withColumn("value", value).groupBy(*keys, "value").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (counts or {}).items()])
    out = running(ranged(per, keys, ["value"], "ranks"), keys, ["value"], {"__before": F.col("n")})
    return out.withColumn(rank, F.col("__before") + (F.col("n") + 1) / 2).drop("__before", RANGE)


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of every group, linear between neighbours as `percentile` has them; any number of groups of any size.

    NULL and NaN don't count; a group without values has no row. Nothing but the plan passes through the driver.
    """
    v = value.cast("double")
    known = df.withColumn("value", v).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    per = known.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    at = running(ranged(per, keys, ["value"], "quantiles"), keys, ["value"], {"__before": F.col("n")})
    total = written(at.groupBy(*keys).agg(F.sum("n").alias("__total")), "quantile-totals")
    named = {k: f"__key_{k}" for k in keys}
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()], F.lit(True))
    rows = at.join(total.withColumnsRenamed(named), same)
    holds = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("n"))
    picks = []
    for c, p in probs.items():
        place = F.lit(p) * (F.col("__total") - 1)
        low = F.floor(place)
        high = F.least(low + 1, F.col("__total") - 1)
        picks += [F.max(F.when(holds(low), F.col("value"))).alias(f"__low_{c}"), F.max(F.when(holds(high), F.col("value"))).alias(f"__high_{c}"), F.max(place - low).alias(f"__part_{c}")]
    out = rows.groupBy(*keys).agg(*picks)
    return out.select(*keys, *[(F.col(f"__low_{c}") + (F.col(f"__high_{c}") - F.col(f"__low_{c}")) * F.col(f"__part_{c}")).alias(c) for c in probs])
