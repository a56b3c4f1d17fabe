"""Joins with contracts, cohorts, as-of and interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that fails where the declared side repeats a key: one_to_one, one_to_many or many_to_one.

    The check is part of the plan: a count over the join's own keys, which needs no shuffle beyond the join's, and an error where it passes 1.
    """

    def once(side: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*on))
        named = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
        error = F.raise_error(F.lit(f"join on {on} isn't {validate}")).cast("boolean")
        return side.withColumn("__n", n).filter(F.when(named & (F.col("__n") > 1), error).otherwise(F.lit(True))).drop("__n")

    left = once(left) if validate.startswith("one_to") else left
    right = once(right) if validate.endswith("to_one") else right
    return left.join(right, on, how)


def attach_at(rows: DataFrame, env: DataFrame, on: list[str], doy: int) -> DataFrame:
    """Values of one checkpoint for each row."""
    return rows.join(env.filter(F.col("doy") == doy).drop("doy"), on, "left")


def common_cohort(df: DataFrame, keys: list[str], scenario: str) -> DataFrame:
    """Keys that every scenario has."""
    n = df.agg(F.count_distinct(scenario).alias("__n"))
    return df.groupBy(*keys).agg(F.count_distinct(scenario).alias("__k")).join(F.broadcast(n)).filter("__k = __n").select(*keys)  # one row


def restrict(df: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(cohort.select(*keys), keys, "left_semi")


def match_histories(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)


def missing_cells(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(actual.select(*keys), keys, "left_anti")


def expected_grid(*axes: DataFrame) -> DataFrame:
    """All combinations of small axes (years, days, scenarios)."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def versus(m: DataFrame, keys: list[str], scenario: str, a: str, b: str, values: list[str]) -> DataFrame:
    """a's values beside b's with the same keys, and their difference a - b."""
    x = m.filter(F.col(scenario) == a).select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    y = m.filter(F.col(scenario) == b).select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    return x.join(y, keys).withColumns({f"{v}_delta": F.col(f"{v}_a") - F.col(f"{v}_b") for v in values})


metric_delta = pair_runs = pair_counties = versus


def vs_control(m: DataFrame, keys: list[str], scenario: str, control: str, values: list[str]) -> DataFrame:
    """Each candidate against the control with the same keys."""
    y = m.filter(F.col(scenario) == control).select(*keys, *[F.col(v).alias(f"{v}_control") for v in values])
    return m.filter(F.col(scenario) != control).join(y, keys).withColumns({f"{v}_delta": F.col(v) - F.col(f"{v}_control") for v in values})


def paired_scores(scores: DataFrame, keys: list[str], mask: str, pairs: list[tuple[str, str]], values: list[str], bias: str | None = None) -> DataFrame:
    """All listed pairs of masks in one self-join: differences, and that of the biases' sizes."""
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("mask_a"), F.lit(b).alias("mask_b")) for a, b in pairs]))
    x = scores.select(*keys, F.col(mask).alias("mask_a"), *[F.col(v).alias(f"{v}_a") for v in values]).withColumn("p", named).filter("p.mask_a = mask_a").withColumn("mask_b", F.col("p.mask_b")).drop("p")
    y = scores.select(*keys, F.col(mask).alias("mask_b"), *[F.col(v).alias(f"{v}_b") for v in values])
    out = x.join(y, [*keys, "mask_b"]).withColumns({f"{v}_delta": F.col(f"{v}_a") - F.col(f"{v}_b") for v in values})
    return out.withColumn("abs_bias_delta", F.abs(f"{bias}_a") - F.abs(f"{bias}_b")) if bias else out


def asof(left: DataFrame, right: DataFrame, at: str, when: str, by: list[str], take: list[str], within: int | None = None) -> DataFrame:
    """For each left row the latest right row with when <= at (and no more than `within` days before), by equal keys.

    Both sides go into one sorted window by key, so no pair of rows is built.
    """
    from pyspark.sql import Window

    cols = [*by, *[c for c in left.columns if c not in by]]
    x = left.select(*cols, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__r"))
    y = right.select(*by, *[F.lit(None).alias(c) for c in cols if c not in by], F.col(when).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(when).alias("__when"), *take).alias("__r"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = x.unionByName(y).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    if within is not None:
        out = out.withColumn("__r", F.when(F.date_diff("__t", "__r.__when") <= within, F.col("__r")))
    return out.select(*cols, *[F.col(f"__r.{c}").alias(c) for c in take])


def contained_periods(outer: DataFrame, inner: DataFrame, days: int = 8, width: int | None = None) -> DataFrame:
    """Inner periods that lie within each outer one and are available by its forecast: n_found, n_expected, complete.

    outer: period, start, end, forecast; inner: i_start, i_end, i_available. The timeline is cut into bins of `width` days (else of the mean length of the outer
    periods). An inner period is in the bin of its start alone, an outer one in every bin that it touches: each contained pair meets once,
    and a bin holds few pairs that aren't hits. Inner periods that are equal, and outer ones of equal dates, count as one row with a number.
    """
    if width is None:
        mean = outer.agg(F.avg(F.date_diff("end", "start"))).first()[0]
        width = max(1, int(mean or 1))
    day = lambda c: F.unix_date(F.to_date(c))
    span = outer.select("start", "end", "forecast").distinct().filter("end > start")
    x = span.withColumn("__bin", F.explode(F.sequence(F.floor(day("start") / width), F.floor(day("end") / width))))
    y = inner.groupBy("i_start", "i_end", "i_available").agg(F.count("*").alias("__n")).withColumn("__bin", F.floor(day("i_start") / width))
    hit = (F.col("i_start") >= F.col("start")) & (F.col("i_end") <= F.col("end")) & (F.col("i_available") <= F.col("forecast"))
    found = x.join(y, "__bin").filter(hit).groupBy("start", "end", "forecast").agg(F.sum("__n").alias("n_found"))
    expected = F.ceil(F.date_diff("end", "start") / days)
    out = outer.join(found, ["start", "end", "forecast"], "left").withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("n_expected", expected)
    return out.withColumn("complete", F.col("n_found") == F.col("n_expected"))


def align_history(test: DataFrame, means: DataFrame, keys: list[str], values: str, prior: str, to: str = "anomaly") -> DataFrame:
    """Arrays of a season beside the unit's arrays of prior means, and their difference, place by place; NULL where either is."""
    rows = test.join(means.select(*keys, prior), keys, "left")
    return rows.withColumn(to, F.when(F.col(prior).isNotNull(), F.zip_with(values, prior, lambda a, b: a - b)))


def lag_mask(imagery: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """Imagery of a year with the map of the year before."""
    return imagery.join(masks.withColumn("year", F.col("mask_year") + 1), [*on, "year"])


def assign_zone(pix: DataFrame, bridge: DataFrame, cell: str = "cell_id") -> DataFrame:
    return pix.join(bridge, cell)


def with_names(df: DataFrame, dim: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """A name for each key, or the default."""
    return df.join(dim.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), default))


def unmatched_examples(left: DataFrame, right: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti").select(*keys).orderBy(*keys).limit(n)


def same_targets(a: DataFrame, b: DataFrame, keys: list[str], target: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: how many shared keys have other targets."""
    pairs = a.select(*keys, F.col(target).alias("__a")).join(b.select(*keys, F.col(target).alias("__b")), keys)
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("__a") - F.col("__b")) > tolerance).alias("differing"))
