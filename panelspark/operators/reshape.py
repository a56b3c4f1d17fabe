"""Panels between long, wide and packed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_obs(obs: DataFrame, keys: list[str], grid: list[int], values: list[str], doy: str = "doy", digits: int | None = None) -> DataFrame:
    """One row a key, columns `{value}_DOY_{d}` for every day of the grid; absent cells are NULL, repeated cells their mean (rounded to so many digits).

    Cells are summed before the shuffle; then a key's cells, one a day, meet and take their columns. Days off the grid are one cell.
    """
    mean = F.avg if digits is None else lambda v: F.round(F.avg(v), digits)
    day = F.when(F.col(doy).isin(grid), F.col(doy)).alias("__d")
    cells = obs.groupBy(*keys, day).agg(*[mean(v).alias(f"__{i}") for i, v in enumerate(values)])
    return cells.repartition(*keys).groupBy(*keys).agg(*[F.max(F.when(F.col("__d") == d, F.col(f"__{i}"))).alias(f"{v}_DOY_{d}") for i, v in enumerate(values) for d in grid])


WIDE = r"^(.*)_DOY_(\d+)$"


def unpivot_wide(df: DataFrame, keys: list[str], pattern: str = WIDE) -> DataFrame:
    """Long form of wide columns: keys, variable, doy, value. Names are literals, so Spark extracts variable and day from them once, as it plans."""
    import re

    wide = [c for c in df.columns if re.match(pattern, c)]
    cells = [(F.regexp_extract(F.lit(c), pattern, 1), F.regexp_extract(F.lit(c), pattern, 2).cast("int"), F.col(c).cast("double")) for c in wide]
    return df.select(*keys, F.stack(F.lit(len(wide)), *[x for cell in cells for x in cell]).alias("variable", "doy", "value"))


def unpivot_weather(df: DataFrame, keys: list[str], variables: list[str], pattern: str = WIDE) -> DataFrame:
    """One row a key and day, a column for each variable; where a variable has no column for a day it is NULL.

    The unpivoted cells of a day are pivoted by variable where they are stacked: a wide row holds them all, so no row is grouped, sorted or shuffled.
    """
    import re

    days = {}
    for c in df.columns:
        if m := re.match(pattern, c):
            days.setdefault(int(m[2]), {})[m[1]] = c
    rows = [(F.regexp_extract(F.lit(next(iter(day.values()))), pattern, 2).cast("int"), *[(F.col(day[v]) if v in day else F.lit(None)).cast("double") for v in variables]) for day in days.values()]
    return df.select(*keys, F.stack(F.lit(len(rows)), *[x for row in rows for x in row]).alias("doy", *variables))


def complete_panel(df: DataFrame, unit: str, year: str = "year") -> DataFrame:
    """Every unit in every year from the panel's first to its last; what wasn't there is NULL."""
    span = df.agg(F.min(year).alias("__a"), F.max(year).alias("__b"))
    cells = df.select(unit).distinct().crossJoin(F.broadcast(span.filter("__a is not null")))  # one row
    return cells.select(unit, F.explode(F.sequence("__a", "__b")).alias(year)).join(df, [unit, year], "left")


def on_grid(df: DataFrame, keys: list[str], grid: list[int], doy: str = "doy") -> DataFrame:
    """Every key at every day of the grid; absent cells are NULL, days off the grid are left out.

    One shuffle by the keys: a key's rows (a season's, so few) are laid out on the grid where they meet, and stay there for what follows.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    days = rows.withColumn("__d", F.explode(F.array(*[F.lit(d) for d in grid])))
    cells = days.select(*keys, "__d", F.explode_outer(F.filter("__rows", lambda x: x[doy] == F.col("__d"))).alias("__x"))
    return cells.select(*keys, F.col("__d").alias(doy), *[F.col(f"__x.{c}").alias(c) for c in rest if c != doy])


canonical_grid = pad_checkpoints = on_grid


def pack_series(obs: DataFrame, keys: list[str], grid: list[int], value: str, doy: str = "doy", name: str = "series") -> DataFrame:
    """The series of each key as one array aligned to the grid."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(doy), F.col(value))))
    days = F.array(*[F.lit(d) for d in grid])
    once = obs.groupBy(*keys, doy).agg(F.avg(value).alias(value))
    return once.groupBy(*keys).agg(pairs.alias("__m")).select(*keys, F.transform(days, lambda d: F.try_element_at("__m", d)).alias(name))


def pivot_metric(m: DataFrame, rows: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """A metric as a table: rows by keys, one column for each scenario."""
    return m.groupBy(*rows).pivot(column, names).agg(F.first(value))


def importance_matrix(imp: DataFrame, fit: list[str], feature: str = "feature", share: str = "share") -> DataFrame:
    """Every fit with every feature; a feature that a fit doesn't use has the share 0."""
    fits, features = imp.select(*fit).distinct(), imp.select(feature).distinct()
    return fits.crossJoin(features).join(imp.select(*fit, feature, share), [*fit, feature], "left").withColumn(share, F.coalesce(share, F.lit(0.0)))  # fits and features are report-sized


def score_rows(counts: DataFrame, keys: list[str], sets: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Wide count bands as rows: name, tp, fp, fn, tn."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), *[F.col(c).cast("long").alias(n) for c, n in zip(v, ("tp", "fp", "fn", "tn"))]) for k, v in sets.items()])
    return counts.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def long_importance(df: DataFrame, keys: list[str], names: list[str], values: Column | str) -> DataFrame:
    """feature and share of each place of an array."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode(values)).select(*keys, F.get(labels, "pos").alias("feature"), F.col("col").alias("share"))


def split_list(df: DataFrame, c: str, by: str = ";") -> DataFrame:
    """A row for each item of a list in text."""
    return df.withColumn(c, F.explode(F.split(c, f"\\Q{by}\\E"))).withColumn(c, F.trim(c)).filter(F.col(c) != "")


def join_list(df: DataFrame, keys: list[str], c: str, by: str = ";") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(c)), by).alias(c))


def union_all(*frames: DataFrame) -> DataFrame:
    out, *more = frames
    for f in more:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that every frame has."""
    tagged = union_all(*[f.select(*keys).distinct().withColumn("__f", F.lit(i)) for i, f in enumerate(frames)])
    return tagged.groupBy(*keys).agg(F.count_distinct("__f").alias("__n")).filter(F.col("__n") == len(frames)).drop("__n")


def except_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(actual.select(*keys), keys, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that only one side has."""
    x = a.select(*keys).distinct().withColumn("__a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("__b", F.lit(1))
    return x.join(y, keys, "full").agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"))


def sort_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A fixed order for output: by the keys, then by the other columns that can be ordered."""
    rest = [c for c, t in df.dtypes if c not in keys and not t.startswith("map")]
    return df.orderBy(*keys, *rest)


def largest_first(df: DataFrame, size: str, ties: list[str]) -> DataFrame:
    """The order in which work is handed out: largest first, equal ones by `ties`."""
    return df.orderBy(F.desc(size), *ties)


def order_by_rank(df: DataFrame, c: str, order: list[str]) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
