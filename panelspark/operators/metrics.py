"""Scores of forecasts at any level, run sweeps, ensembles, importance and report tables: conditional aggregates, one scan each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import versus


def r2(actual: Column, predicted: Column) -> Column:
    """1 - SSE/SST; NULL with fewer than two rows or a constant target."""
    sst = F.var_pop(actual) * F.count(actual)
    return F.when((F.count(actual) >= 2) & (F.max(actual) > F.min(actual)), 1 - F.try_divide(F.sum((actual - predicted) * (actual - predicted)), sst))


def metric_columns(actual: str = "actual", predicted: str = "predicted", trend: str | None = "trend") -> list[Column]:
    a, p = F.col(actual), F.col(predicted)
    out = [F.count("*").alias("n"), r2(a, p).alias("r2"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"), (F.count("*") < 30).alias("small_cohort")]
    if trend:
        t = F.col(trend)
        out += [r2(a - t, p - t).alias("anomaly_r2"), F.sqrt(F.avg((a - t) * (a - t))).alias("trend_baseline_rmse"), (1 - F.try_divide(F.avg((a - p) * (a - p)), F.avg((a - t) * (a - t)))).alias("mse_skill_vs_trend")]
    return out


def percent_columns(actual: str = "actual", predicted: str = "predicted", trend: str = "trend") -> list[Column]:
    a, p, t = F.col(actual), F.col(predicted), F.col(trend)
    return [F.avg(100 * F.try_divide(F.abs(a - p), F.abs(a))).alias("mape"), F.avg(100 * F.try_divide(F.abs(a - t), F.abs(a))).alias("trend_mape"), F.avg(p - a).alias("bias"), F.min(a).alias("min_actual"), F.max(a).alias("max_actual"), F.min(p).alias("min_predicted"), F.max(p).alias("max_predicted")]


def forecast_metrics(pred: DataFrame, by: list[str], **names: str) -> DataFrame:
    return pred.groupBy(*by).agg(*metric_columns(**names))


def percent_metrics(pred: DataFrame, by: list[str], **names: str) -> DataFrame:
    return pred.groupBy(*by).agg(*percent_columns(**names))


def metrics_levels(pred: DataFrame, sets: list[list[str]], **names: str) -> DataFrame:
    """The same scores at several levels, in one pass of grouping sets; keys that a level doesn't have are NULL."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return pred.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("level"), *metric_columns(**names), *percent_columns(**names))


def run_summary(m: DataFrame, by: list[str], metrics: list[str], run: str = "seed") -> DataFrame:
    """Mean, sample deviation and number of runs of each metric."""
    aggs = [f(c).alias(f"{c}_{n}") for c in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    return m.groupBy(*by).agg(F.count_distinct(run).alias("n_runs"), *aggs)


def run_summary_overall(m: DataFrame, scenario: list[str], metrics: list[str], run: str = "seed") -> DataFrame:
    """First the mean of each run over its cells, then mean and deviation over runs."""
    per_run = m.groupBy(*scenario, run).agg(*[F.avg(c).alias(c) for c in metrics])
    return run_summary(per_run, scenario, metrics, run)


def run_counts(m: DataFrame, by: list[str], n: str = "n", run: str = "seed") -> DataFrame:
    return m.groupBy(*by).agg(F.count_distinct(run).alias("n_runs"), F.min(n).alias("min_n"), F.max(n).alias("max_n"), (F.min(n) != F.max(n)).alias("differs"))


def ensemble(pred: DataFrame, keys: list[str], predicted: str = "predicted", actual: str = "actual", run: str = "seed") -> DataFrame:
    """Mean prediction over runs, its spread (0 for one run), runs, and how far targets differ between runs."""
    return pred.groupBy(*keys).agg(F.avg(predicted).alias(predicted), F.coalesce(F.stddev_samp(predicted), F.lit(0.0)).alias("sd"), F.count_distinct(run).alias("n_runs"), F.avg(actual).alias(actual), (F.max(actual) - F.min(actual)).alias("target_range"))


def importance_summary(imp: DataFrame, by: list[str], share: str = "share") -> DataFrame:
    return imp.groupBy(*by).agg((F.avg(share) * 100).alias("mean_pct"), (F.coalesce(F.stddev_samp(share), F.lit(0.0)) * 100).alias("sd_pct"))


def importance_mean(imp: DataFrame, fits: list[str], by: list[str], share: str = "share") -> DataFrame:
    """Mean share over all fits of a group (by feature, or summed by feature group); what a fit doesn't use counts as 0 there. No zero rows are built."""
    group = [k for k in by if k in fits]
    n = imp.select(*dict.fromkeys([*group, *fits])).distinct().groupBy(*group).agg(F.count("*").alias("__n"))
    sums = imp.groupBy(*by).agg(F.sum(share).alias("__s"))
    out = sums.join(n, group) if group else sums.crossJoin(F.broadcast(n))  # one row
    return out.select(*by, (F.col("__s") / F.col("__n")).alias("mean_share"))


def gain_share(imp: DataFrame, fit: list[str], gain: str = "gain") -> DataFrame:
    from .windows import share_within

    return share_within(imp, fit, gain, "gain_share")


def period_summary(m: DataFrame, scenario: list[str], value: str) -> DataFrame:
    """Mean, deviation (0 for one), periods and years of each scenario."""
    return m.groupBy(*scenario).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count("*").alias("n_periods"), F.count_distinct("year").alias("n_years"))


def period_delta(m: DataFrame, keys: list[str], scenario: str, a: str, b: str, value: str) -> DataFrame:
    d = versus(m, keys, scenario, a, b, [value])
    return d.agg(F.avg(f"{value}_delta").alias("mean_delta"), F.coalesce(F.stddev_samp(f"{value}_delta"), F.lit(0.0)).alias("sd_delta"), F.count("*").alias("n"))


def seasonal_profile(m: DataFrame, by: list[str], value: str) -> DataFrame:
    return m.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def late_season(m: DataFrame, scenario: str, names: list[str], value: str, doy: str = "doy") -> DataFrame:
    """The last checkpoint's values, a row a year and a column a scenario."""
    last = m.agg(F.max(doy).alias("__d"))
    return m.join(F.broadcast(last)).filter(F.col(doy) == F.col("__d")).groupBy("year").pivot(scenario, names).agg(F.first(value))  # one row


def map_table(ens: DataFrame, by: list[str]) -> DataFrame:
    return ens.groupBy(*by).agg(F.avg("predicted").alias("predicted"), F.avg("actual").alias("actual"), F.avg(F.col("predicted") - F.col("actual")).alias("difference"))


def colour_limits(maps: DataFrame, by: list[str], value: str = "difference") -> DataFrame:
    """low and high of the shown value, and a limit that is symmetric around 0."""
    return maps.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.abs(value)).alias("limit"))


def class_counts(labels: DataFrame, by: list[str], label: str, sampled: DataFrame | None = None) -> DataFrame:
    """Rows of each class; with a sample, also how many of them it took."""
    out = labels.groupBy(*by, label).agg(F.count("*").alias("n"))
    if sampled is None:
        return out
    took = sampled.groupBy(*by, label).agg(F.count("*").alias("n_sampled")).withColumnsRenamed({c: f"__key_{c}" for c in (*by, label)})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in (*by, label)])  # a missing class is one, too
    return out.join(took, same, "left").select(*by, label, "n", F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"))


def dashboard_kpis(rec: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Counts, errors and exact quartiles of the error by report group: any number of groups of any size."""
    from .prefix import grouped_quantiles

    e = F.col("predicted") - F.col("actual")
    quartiles = grouped_quantiles(rec.select(*by, e.alias("__e")), by, F.col("__e"), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = rec.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(unit).alias("n_units"), F.avg("actual").alias("mean_actual"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    right = quartiles.withColumnsRenamed({c: f"__key_{c}" for c in by})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in by])
    return out.join(right, same, "left").drop(*[f"__key_{c}" for c in by])


def tree_curve(m: DataFrame, trees: str, value: str) -> DataFrame:
    return m.groupBy(trees).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def reasons(df: DataFrame, by: list[str], c: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(c))


def fixed_season(pred: DataFrame, keys: list[str], doy: str = "doy", year: str = "year") -> DataFrame:
    """Rows of units that are there at every checkpoint of their year."""
    total = pred.groupBy(year).agg(F.count_distinct(doy).alias("__t"))
    have = pred.groupBy(year, *keys).agg(F.count_distinct(doy).alias("__k")).join(total, year).filter("__k = __t")
    return pred.join(have.select(year, *keys), [year, *keys], "left_semi")


def skill_curve(pred: DataFrame, by: list[str]) -> DataFrame:
    a, p, t = F.col("actual"), F.col("predicted"), F.col("trend")
    return pred.groupBy(*by).agg((100 * (1 - F.try_divide(F.avg((a - p) * (a - p)), F.avg((a - t) * (a - t))))).alias("skill_pct"))


def verify_metrics(pred: DataFrame, stored: DataFrame, by: list[str], metrics: list[str], tolerance: float = 1e-11) -> DataFrame:
    """Stored metrics beside recomputed ones: relative discrepancy and whether it is within the tolerance."""
    again = forecast_metrics(pred, by).select(*by, *[F.col(m).alias(f"{m}_again") for m in metrics])
    out = stored.join(again, by)
    diff = {m: F.try_divide(F.abs(F.col(m) - F.col(f"{m}_again")), F.greatest(F.abs(F.col(m)), F.abs(F.col(f"{m}_again")))) for m in metrics}
    return out.select(*by, *[d.alias(f"{m}_rel") for m, d in diff.items()], reduce(Column.__and__, [F.coalesce(d, F.lit(0.0)) <= tolerance for d in diff.values()]).alias("agrees"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def average_duplicates(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def conflicts(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Keys with more than one value; a missing value is one."""
    n = F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0")))
    return df.groupBy(*keys).agg(n.alias("n_values")).filter("n_values > 1")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*order, *rest)])


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def training_audit(train: DataFrame, by: list[str], year: str = "year", least_years: int = 3, least_rows: int = 20, features: list[str] | None = None) -> DataFrame:
    """Rows, years, first and last year, whether they are enough; with `features`: how many of them have any value."""
    if features:
        some = [F.max(F.col(c).isNotNull().cast("int")).alias(f"__{i}") for i, c in enumerate(features)]
        used = train.groupBy(*by).agg(*some).select(*by, sum((F.col(f"__{i}") for i in range(len(features))), F.lit(0)).cast("bigint").alias("n_features"))
        return training_audit(train, by, year, least_years, least_rows).join(used, by)
    out = train.groupBy(*by).agg(F.count("*").alias("n_train"), F.count_distinct(year).alias("n_years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return out.withColumn("enough", (F.col("n_years") >= least_years) & (F.col("n_train") >= least_rows))


def train_medians(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row: exact medians; columns without any value are NULL."""
    from .quantiles import exact_quantiles

    found = exact_quantiles(train.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "k", "v"), "k", "v", [0.5])
    return train.sparkSession.createDataFrame([tuple(found.get(c, [None])[0] for c in cols)], ", ".join(f"`{c}` double" for c in cols))


def cell_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, share of rows with a value, whether it is all missing."""
    one = df.agg(*[(F.count(c) / F.count("*")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "share").withColumn("all_missing", F.col("share") == 0)


def history_means(hist: DataFrame, keys: list[str], year: int, cols: list[str], least: int = 3) -> DataFrame:
    """Means of the years before, where enough of them have a value."""
    return hist.filter(F.col("year") < year).groupBy(*keys).agg(*[F.when(F.count(c) >= least, F.avg(c)).alias(f"{c}_prior") for c in cols])
