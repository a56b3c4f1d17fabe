"""Data-quality operators: each gives rows or counts of what is wrong, in one aggregate where that is possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import expected_grid, missing_cells
from .metrics import duplicate_keys


def timing_audit(obs: DataFrame, keys: list[str], date: str, start: str, end: str, latest: str, lag: Column, usable: Column) -> DataFrame:
    """Violations by rule among usable rows: period order, latest observation, and release before the boundary."""
    boundary = F.date_add(date, 1)
    rules = {"bad_period": F.col(start) >= F.col(end), "latest_outside": (F.col(latest) < F.col(start)) | (F.col(latest) >= F.col(end)), "latest_after": F.col(latest) > F.col(date), "not_released": F.date_add(F.col(end), lag) > boundary}
    return obs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(usable).alias("n_usable"), *[F.count_if(usable & F.coalesce(r, F.lit(True))).alias(k) for k, r in rules.items()])


def file_key_audit(obs: DataFrame, keys: list[str], file_year: str, file_month: str, year: str, month: str, date: str, doy: str) -> DataFrame:
    """Rows whose file's year or month isn't the row's own, and whose date isn't the checkpoint's day of the year."""
    differ = lambda a, b: ~F.coalesce(F.col(a).eqNullSafe(F.col(b)), F.lit(False))
    day = F.date_add(F.make_date(F.col(year), F.lit(1), F.lit(1)), F.col(doy).cast("int") - 1)
    return obs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(differ(file_year, year)).alias("wrong_year"), F.count_if(differ(file_month, month)).alias("wrong_month"), F.count_if(~F.coalesce(F.to_date(date) == day, F.lit(False))).alias("wrong_date"))


def period_signatures(obs: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return obs.groupBy(*keys).agg(F.count_distinct(F.struct(*cols)).alias("n_signatures")).withColumn("single", F.col("n_signatures") == 1)


def mask_audit(obs: DataFrame, keys: list[str], year: str, mask_year: str, final: Column, available: str) -> DataFrame:
    ok = F.col(mask_year) == F.when(final, F.col(year)).otherwise(F.col(year) - 1)
    return obs.groupBy(*keys).agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("wrong_year"), F.max(available).alias("latest_available"))


def leakage_audit(df: DataFrame, last_used: str, year: str) -> DataFrame:
    """One row: rows that used their own year or a later one."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(last_used) >= F.col(year)).alias("leaks"))


def grid_check(df: DataFrame, keys: list[str], doy: str, grid: list[int], variables: list[str] | None = None) -> DataFrame:
    """Whether each key has exactly the grid's days; with `variables`, also how many days lack a value of one of them."""
    have = F.array_sort(F.collect_set(doy))
    more = [F.count_if(reduce(Column.__or__, [F.col(v).isNull() for v in variables])).alias("n_incomplete_days")] if variables else []
    return df.groupBy(*keys).agg(F.count_distinct(doy).alias("n_doys"), (have == F.array(*[F.lit(g) for g in grid])).alias("complete"), *more)


def availability(required: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    have = files.select(*keys).distinct().withColumn("__h", F.lit(True))
    return required.join(have, keys, "left").withColumn("available", F.coalesce("__h", F.lit(False))).drop("__h")


def blocking(ledger: DataFrame, annual: DataFrame, test_years: DataFrame, year: str = "year", least: int = 3) -> DataFrame:
    """reason, year: what keeps a run from starting: required inputs that aren't there, and test years with too few earlier annual files.

    ledger: availability's rows with year; annual: the years of annual files; test_years: the years to be tested.
    """
    gone = ledger.filter(~F.col("available")).select(F.lit("missing input").alias("reason"), F.col(year).alias("year")).distinct()
    years = annual.select(F.col(year).alias("__y")).distinct()
    earlier = test_years.select(F.col(year).alias("year")).distinct().join(years, F.col("__y") < F.col("year"), "left").groupBy("year").agg(F.count("__y").alias("k"))
    return gone.unionByName(earlier.filter(F.col("k") < least).select(F.lit("too few earlier years").alias("reason"), "year"))


def validate_results(metrics: DataFrame, predictions: DataFrame, keys: list[str], unit: str, axes: list[DataFrame]) -> DataFrame:
    """One row: duplicate metric keys, missing cells, cells whose n isn't the number of predictions, keys with several targets."""
    dup = duplicate_keys(metrics, keys).agg(F.count("*").alias("duplicates"))
    gone = missing_cells(expected_grid(*axes), metrics, keys).agg(F.count("*").alias("missing"))
    n = predictions.groupBy(*keys).agg(F.count("*").alias("__n"))
    off = metrics.join(n, keys, "left").agg(F.count_if(F.coalesce(F.col("__n"), F.lit(0)) != F.col("n")).alias("wrong_n"))
    targets = predictions.groupBy(unit, "year").agg((F.max("actual") - F.min("actual")).alias("d")).agg(F.count_if(F.col("d") > 1e-9).alias("unstable_targets"))
    return reduce(lambda a, b: a.crossJoin(b), [dup, gone, off, targets])  # one row each


def validate_counts(counts: DataFrame, groups: dict[str, tuple[str, ...]], subsets: list[tuple[str, str]]) -> DataFrame:
    """One row: negative counts, groups whose cells don't add up to their total, and counts over those that hold them."""
    cols = sorted({c for t, parts in groups.items() for c in (t, *parts)} | {c for s in subsets for c in s})
    aggs = [F.count_if(reduce(Column.__or__, [F.col(c) < 0 for c in cols])).alias("negative")]
    aggs += [F.count_if(reduce(Column.__add__, [F.col(p) for p in parts]) != F.col(t)).alias(f"{t}_mismatch") for t, parts in groups.items()]
    aggs += [F.count_if(F.col(a) > F.col(b)).alias(f"{a}_over_{b}") for a, b in subsets]
    return counts.agg(*aggs)


def validate_inventory(counts: DataFrame, zone: list[str], period: list[str], inventory: str, reference: str) -> DataFrame:
    """One row: repeated keys, counts that aren't whole, zones whose inventory of pixels or whose reference differs between periods, zones that some period lacks."""
    keys = [*zone, *period]
    dup = duplicate_keys(counts, keys).agg(F.count("*").alias("duplicates"))
    whole = counts.agg(F.count_if((F.col(inventory) % 1 != 0) | (F.col(reference) % 1 != 0)).alias("not_whole"), F.count_distinct(F.struct(*period)).alias("__periods"))
    by_zone = counts.groupBy(*zone).agg((F.max(inventory) != F.min(inventory)).alias("i"), (F.max(reference) != F.min(reference)).alias("r"), F.count_distinct(F.struct(*period)).alias("k"))
    moved = by_zone.crossJoin(F.broadcast(whole)).agg(F.count_if("i").alias("inventory_changes"), F.count_if("r").alias("reference_changes"), F.count_if(F.col("k") < F.col("__periods")).alias("zones_lacking_periods"))  # one row
    return dup.crossJoin(whole.drop("__periods")).crossJoin(moved)  # one row each


def coverage_flags(scores: DataFrame, keys: list[str], flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """keys, flag, value for every condition that holds."""
    items = F.array(*[F.struct(F.lit(k).alias("flag"), v.cast("double").alias("value"), F.coalesce(c, F.lit(False)).alias("on")) for k, (c, v) in flags.items()])
    return scores.select(*keys, F.explode(F.filter(items, lambda x: x["on"])).alias("x")).select(*keys, "x.flag", "x.value")


def provenance(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def scenario_status(grid: DataFrame, metrics: DataFrame, skipped: DataFrame, keys: list[str]) -> DataFrame:
    """evaluated, or why not."""
    why = skipped.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("__why"))
    done = metrics.select(*keys).distinct().withColumn("__d", F.lit("evaluated"))
    return grid.join(done, keys, "left").join(why, keys, "left").select(*keys, F.coalesce("__d", "__why", F.lit("missing")).alias("status"))


def cohort_audit(eligible: DataFrame, common: DataFrame, by: list[str], scenario: str) -> DataFrame:
    n = common.groupBy(*by).agg(F.count("*").alias("common_units"))
    return eligible.groupBy(*by, scenario).agg(F.count("*").alias("eligible_units")).join(n, by, "left").withColumn("common_units", F.coalesce("common_units", F.lit(0))).withColumn("small_cohort", F.col("common_units") < 30)


def row_eligibility(obs: DataFrame, date: str, mask_available: str, feature_available: str) -> DataFrame:
    on = F.greatest(mask_available, feature_available)
    return obs.withColumns({"mask_eligible": F.col(mask_available) <= F.col(date), "available_on": on, "eligible": on <= F.col(date)})


def assert_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"{c}_bad") for c in cols])


def single_value(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) == 1).alias(f"{c}_single") for c in cols])


def reconcile(scores: DataFrame, by: list[str], cols: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Whether fields that must not differ within a group don't."""
    return scores.groupBy(*by).agg(*[(F.max(c) - F.min(c) <= tolerance).alias(f"{c}_agrees") for c in cols])


def reconcile_bias(scores: DataFrame, stored: str, tp: str = "tp", fp: str = "fp", fn: str = "fn", tolerance: float = 1e-9) -> DataFrame:
    """The stored area bias beside the one recomputed from the counts, and whether they agree (both missing is agreement)."""
    again = 100 * F.try_divide((F.col(fp) - F.col(fn)).cast("double"), (F.col(tp) + F.col(fn)).cast("double"))
    agrees = F.coalesce(F.abs(F.col(stored) - again) <= tolerance, F.col(stored).isNull() & again.isNull())
    return scores.withColumns({"bias_again": again, "bias_agrees": agrees})


def spec_check(levels: DataFrame, mape: float = 10.0, r2: float = 0.60) -> DataFrame:
    """mape_ok and r2_ok of each level; where min_predicted is there, whether any prediction is negative."""
    out = levels.withColumns({"mape_ok": F.col("mape") <= mape, "r2_ok": F.col("r2") > r2})
    return out.withColumn("negative_predictions", F.col("min_predicted") < 0) if "min_predicted" in levels.columns else out


def negative_predictions(pred: DataFrame, by: list[str], predicted: str = "predicted") -> DataFrame:
    return pred.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(predicted) < 0).alias("n_negative"))


def pending(expected: DataFrame, done: DataFrame, ledger: DataFrame, scenes: DataFrame, keys: list[str], terminal: tuple[str, ...]) -> DataFrame:
    """What is still to do, and what can't be done, with the reason."""
    out = missing_cells(expected, done, keys).join(ledger, keys, "left").join(scenes.select(*keys).distinct().withColumn("__s", F.lit(True)), keys, "left")
    why = F.when(F.col("status").isin(*terminal), F.concat(F.lit("terminal: "), "status")).when(F.col("__s").isNull(), "no scenes").otherwise("to do")
    return out.select(*keys, why.alias("reason"))


def require_runs(df: DataFrame, keys: list[str], run: str, n: int) -> DataFrame:
    """One row: keys, and keys that don't have exactly n runs."""
    return df.groupBy(*keys).agg(F.count_distinct(run).alias("k")).agg(F.count("*").alias("n_keys"), F.count_if(F.col("k") != n).alias("n_wrong"))


def temporal_audit(periods: DataFrame, by: list[str]) -> DataFrame:
    return periods.groupBy(*by).agg(F.count("*").alias("n_periods"), F.count_if("complete").alias("n_complete"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
