"""All queries by name, and their SQL. Each applies an operator to whole tables; doubles are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import cleaning as cl
from panelspark.functions import scalar as sc
from panelspark.operators import audits, joins, maps, metrics, models, reshape, series, stats, windows
from panelspark.streaming import streams

from .bindings import DAILY, PANEL, PIXELS, RUNS, SEASON, SPARSE, TRENDED, daily, panel, pixels, rounded, runs, season, season_lines, sparse, table, trended

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GRID = sc.GRID
WINDOW_ENDS = [5, 10, 15, 20, 25, 30]


def query(sql: str | None = None, digits: int = 6, exact: tuple[str, ...] = ()):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits, exact)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FORECAST = """count(*) AS n, CASE WHEN count(actual) >= 2 AND max(actual) > min(actual) THEN round(1 - sum((actual - predicted)^2) / (var_pop(actual) * count(actual)), 6) END AS r2,
  round(sqrt(avg((actual - predicted)^2)), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, count(*) < 30 AS small_cohort,
  CASE WHEN max(actual - trend) > min(actual - trend) THEN round(1 - sum((actual - predicted)^2) / (var_pop(actual - trend) * count(actual)), 6) END AS anomaly_r2,
  round(sqrt(avg((actual - trend)^2)), 6) AS trend_baseline_rmse, round(1 - avg((actual - predicted)^2) / nullif(avg((actual - trend)^2), 0), 6) AS mse_skill_vs_trend"""


@query(f"WITH {TRENDED} SELECT year, count(*) AS n, round(sqrt(avg((y - trend)^2)), 6) AS rmse, round(avg(abs(y - trend)), 6) AS mae, round(1 - sum((y - trend)^2) / (var_pop(y) * count(y)), 6) AS r2, count(*) < 30 AS small_cohort FROM trended WHERE trend IS NOT NULL GROUP BY year")
def trend_baseline_metrics(spark, sf_dir):
    rows = trended(spark, sf_dir).filter("trend is not null").select("unit", "year", F.col("y").alias("actual"), F.col("trend").alias("predicted"))
    return metrics.forecast_metrics(rows, ["year"], trend=None)


@query(f"WITH {TRENDED} SELECT unit, year, round(y, 4) AS y, trend_n, trend_first, trend_last, round(trend, 4) AS trend, round(trend_slope, 4) AS trend_slope FROM trended", digits=4)
def causal_trend(spark, sf_dir):
    return trended(spark, sf_dir).drop("trend_intercept")


@query(f"WITH {SPARSE} SELECT unit, year, round(y, 6) AS y, CASE WHEN count(y) OVER w = 5 THEN round(avg(y) OVER w, 6) END AS prior_5 FROM sparse WINDOW w AS (PARTITION BY unit ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def prior_mean_5(spark, sf_dir):
    return windows.prior_k_mean(sparse(spark, sf_dir), ["unit"], "year", "y", 5, "prior_5")


@query(f"WITH {SPARSE}, years AS (SELECT unnest(range((SELECT min(year) FROM sparse), (SELECT max(year) FROM sparse) + 1)) AS year), units AS (SELECT DISTINCT unit FROM sparse) SELECT unit, year, round(y, 6) AS y FROM units CROSS JOIN years LEFT JOIN sparse USING (unit, year)")
def calendar_panel(spark, sf_dir):
    return reshape.complete_panel(sparse(spark, sf_dir), "unit")


@query(f"WITH {SPARSE} SELECT unit, year, round(y, 6) AS y, round(y - CASE WHEN count(y) OVER w >= 3 THEN avg(y) OVER w END, 6) AS anomaly FROM sparse WINDOW w AS (PARTITION BY unit ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def anomalies_expanding(spark, sf_dir):
    return windows.anomalies(sparse(spark, sf_dir), ["unit"], "year", "y")


@query(f"WITH {DAILY} SELECT unit, date, round(tmax, 6) AS tmax, n, CASE WHEN tmax IS NOT NULL THEN round(sum(tmax) OVER w, 6) END AS season_tmax, CASE WHEN n IS NOT NULL THEN sum(n) OVER w::BIGINT END AS season_n, round(avg(tmax) OVER w, 6) AS season_tmax_mean, sum(n) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS recent_n FROM daily WINDOW w AS (PARTITION BY unit ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT").replace("CURRENT ROW)::BIGINT", "CURRENT ROW)::BIGINT"))
def season_weather(spark, sf_dir):
    return windows.season_weather(daily(spark, sf_dir), ["unit"], "date", ["tmax", "n"], "tmax", "n")


@query(f"WITH {DAILY}, ends AS (SELECT unnest([5, 10, 15, 20, 25, 30]) AS doy) SELECT unit, year(date)::BIGINT AS year, doy::BIGINT AS doy, round(avg(tmax), 6) AS tmax, sum(n)::BIGINT AS n, count(DISTINCT date) AS n_days FROM daily JOIN ends ON dayofyear(date) BETWEEN doy - 4 AND doy GROUP BY 1, 2, 3")
def trailing_windows(spark, sf_dir):
    return maps.trailing_window(daily(spark, sf_dir), ["unit"], "date", WINDOW_ENDS, 5, ["tmax"], ["n"])


FULL_SEASON = SEASON + ", cells AS (SELECT DISTINCT unit, year FROM season WHERE doy <= {cut}), grid AS (SELECT unit, year, doy FROM cells, (SELECT unnest(range(65, {cut} + 1, 16)) AS doy)), full_season AS (SELECT unit, year, doy::BIGINT AS doy, value FROM grid LEFT JOIN season USING (unit, year, doy))"
FILLED = """, looked AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN value IS NOT NULL THEN doy END IGNORE NULLS) OVER b AS d0, first_value(CASE WHEN value IS NOT NULL THEN doy END IGNORE NULLS) OVER a AS d1 FROM full_season
  WINDOW b AS (PARTITION BY unit, year ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY unit, year ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT unit, year, doy, value, coalesce(value, v0 + (v1 - v0) * (doy - d0)::DOUBLE / nullif(d1 - d0, 0)) AS filled, coalesce(value, v0 + (v1 - v0) * (doy - d0)::DOUBLE / nullif(d1 - d0, 0), v0, v1) AS clamped FROM looked)"""


def full_season(spark, sf_dir, cut: int) -> tuple[DataFrame, list[int]]:
    """Each unit's season as an array, straight from the order lines: one shuffle."""
    days = [g for g in GRID if g <= cut]
    return series.pack(series.upto(season_lines(spark, sf_dir, GRID), cut), ["unit", "year"], days, ["value"], digits=9), days


def filled_at(cut: int, edges: str = "null"):
    def f(spark, sf_dir):
        packed, days = full_season(spark, sf_dir, cut)
        return series.unpack(series.interpolate(packed, ["value"], days, edges, to={"value": "filled"}), ["unit", "year"], days, ["value", "filled"])

    f.__name__ = f"interpolate_cut_{cut}"
    return f


for _cut in (113, 193, 273):
    query(f"WITH {FULL_SEASON.format(cut=_cut)}{FILLED} SELECT unit, year, doy, round(value, 6) AS value, round(filled, 6) AS filled FROM filled")(filled_at(_cut))


@query(f"WITH {FULL_SEASON.format(cut=273)}{FILLED} SELECT unit, year, doy, round(value, 6) AS value, round(clamped, 6) AS filled FROM filled")
def interpolate_clamped(spark, sf_dir):
    return filled_at(273, "clamp")(spark, sf_dir)


FEATURES = """, vals AS (SELECT unit, year, doy, filled AS v FROM filled), laid AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN doy END IGNORE NULLS) OVER p AS pd FROM vals WINDOW p AS (PARTITION BY unit, year ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT unit, year, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(min(v), 6) AS min, round(stddev_pop(v), 5) AS std, round(max(CASE WHEN doy = 193 THEN v END), 6) AS last, CASE WHEN count(v) >= 2 THEN round(sum((v + pv) / 2 * (doy - pd)), 5) END AS auc,
  CASE WHEN count(v) FILTER (WHERE doy BETWEEN 60 AND 120) >= 2 THEN round(regr_slope(v, doy) FILTER (WHERE doy BETWEEN 60 AND 120), 9) END AS greenup, round(avg(CASE WHEN doy <= 97 THEN v END), 6) AS early_mean,
  round((max(CASE WHEN doy = 193 THEN v END) - max(CASE WHEN doy = 177 THEN v END)) / 16, 6) AS last_slope, min(doy) FILTER (WHERE v = top)::BIGINT AS peak_doy
FROM (SELECT *, max(v) OVER (PARTITION BY unit, year) AS top FROM laid) GROUP BY unit, year"""


@query(f"WITH {FULL_SEASON.format(cut=193)}{FILLED}{FEATURES}", exact=("greenup",))
def series_features(spark, sf_dir):
    packed, days = full_season(spark, sf_dir, 193)
    out = series.season_features(packed, ["unit", "year"], ["value"], days, cells=False)
    out = out.withColumnsRenamed({f"value_{c}": c for c in series.STATS})
    return out.withColumns({"std": F.round("std", 5), "auc": F.round("auc", 5), "greenup": F.round("greenup", 9)})


@query(f"WITH {SEASON} SELECT unit, year, " + ", ".join(f"round(avg(CASE WHEN doy = {g} THEN value END), 6) AS \"value_DOY_{g}\"" for g in GRID) + " FROM season GROUP BY unit, year")
def pivot_grid(spark, sf_dir):
    return reshape.pivot_obs(season_lines(spark, sf_dir, GRID), ["unit", "year"], GRID, ["value"], digits=9)


@query(f"WITH {SEASON}, keys AS (SELECT DISTINCT unit, year FROM season), grid AS (SELECT unit, year, doy FROM keys, (SELECT unnest(range(65, 274, 16)) AS doy)) SELECT unit, year, 'value' AS variable, doy::BIGINT AS doy, round(value, 6) AS value FROM grid LEFT JOIN season USING (unit, year, doy)")
def unpivot_weather(spark, sf_dir):
    """Wide to a row a day with its variables; these as rows, as the SQL has them."""
    wide = reshape.pivot_obs(season_lines(spark, sf_dir, GRID), ["unit", "year"], GRID, ["value"], digits=9)
    days = reshape.unpivot_weather(wide, ["unit", "year"], ["value"])
    return days.unpivot(["unit", "year", "doy"], ["value"], "variable", "value").select("unit", "year", "variable", "doy", "value")


@query(f"WITH {SEASON} SELECT unit, year, list_aggregate([" + ", ".join(f"coalesce(max(CASE WHEN doy = {g} THEN value END)::VARCHAR, '-')" for g in GRID) + "], 'string_agg', ';') AS series FROM season GROUP BY 1, 2")
def pack_series(spark, sf_dir):
    packed = reshape.pack_series(season(spark, sf_dir, GRID), ["unit", "year"], GRID, "value")
    return packed.withColumn("series", F.array_join(F.transform("series", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ";"))


COHORT = "present AS (SELECT DISTINCT l_suppkey AS unit, year(l_shipdate)::BIGINT AS year, l_returnflag AS scenario, l_partkey AS part FROM lineitem)"


@query(f"WITH {COHORT} SELECT part, year FROM present GROUP BY 1, 2 HAVING count(DISTINCT scenario) = (SELECT count(DISTINCT scenario) FROM present)")
def common_cohort(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.year("l_shipdate").cast("bigint").alias("year"), F.col("l_returnflag").alias("scenario")).distinct()
    return joins.common_cohort(rows, ["part", "year"], "scenario")


@query(f"WITH {SPARSE} SELECT count(*) AS n, count(DISTINCT unit) AS n_units, round(sum(y), 4) AS total FROM sparse WHERE unit IN (SELECT unit FROM sparse GROUP BY unit HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM sparse))", digits=4)
def fixed_season_units(spark, sf_dir):
    rows = sparse(spark, sf_dir).withColumn("one", F.lit(1))
    return metrics.fixed_season(rows, ["unit"], doy="year", year="one").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("n_units"), F.sum("y").alias("total"))


@query(f"WITH {RUNS} SELECT seed, year, {FORECAST} FROM runs GROUP BY seed, year")
def forecast_metrics(spark, sf_dir):
    return metrics.forecast_metrics(runs(spark, sf_dir), ["seed", "year"])


@query(f"WITH {RUNS} SELECT seed, year, grouping(seed, year)::BIGINT AS level, {FORECAST}, round(avg(100 * abs(actual - predicted) / nullif(abs(actual), 0)), 6) AS mape, round(avg(100 * abs(actual - trend) / nullif(abs(actual), 0)), 6) AS trend_mape, round(avg(predicted - actual), 6) AS bias, round(min(actual), 6) AS min_actual, round(max(actual), 6) AS max_actual, min(predicted) AS min_predicted, max(predicted) AS max_predicted FROM runs GROUP BY GROUPING SETS ((seed, year), (year), (seed), ())")
def metrics_levels(spark, sf_dir):
    return metrics.metrics_levels(runs(spark, sf_dir), [["seed", "year"], ["year"], ["seed"], []])


CELLS = RUNS + f", cells AS (SELECT seed, year, {FORECAST} FROM runs GROUP BY seed, year)"


def cells(spark, sf_dir) -> DataFrame:
    return rounded(metrics.forecast_metrics(runs(spark, sf_dir), ["seed", "year"]))


@query(f"WITH {CELLS} SELECT a.year, a.seed, a.rmse, c.rmse AS rmse_control, round(a.rmse - c.rmse, 6) AS rmse_delta FROM cells a JOIN cells c ON c.seed = 1 AND c.year = a.year WHERE a.seed <> 1")
def vs_control_delta(spark, sf_dir):
    return joins.vs_control(cells(spark, sf_dir).select("seed", "year", "rmse"), ["year"], "seed", 1, ["rmse"])


@query(f"WITH {CELLS} SELECT year, count(DISTINCT seed) AS n_runs, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_sd FROM cells GROUP BY year")
def run_summary(spark, sf_dir):
    return metrics.run_summary(cells(spark, sf_dir), ["year"], ["rmse", "mae"])


@query(f"WITH {CELLS}, per_run AS (SELECT 'all' AS scenario, seed, avg(rmse) AS rmse FROM cells GROUP BY seed) SELECT scenario, count(DISTINCT seed) AS n_runs, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd FROM per_run GROUP BY scenario")
def run_summary_overall(spark, sf_dir):
    return metrics.run_summary_overall(cells(spark, sf_dir).withColumn("scenario", F.lit("all")), ["scenario"], ["rmse"])


@query(f"WITH {CELLS} SELECT year, count(DISTINCT seed) AS n_runs, min(n) AS min_n, max(n) AS max_n, min(n) <> max(n) AS differs FROM cells GROUP BY year")
def run_counts(spark, sf_dir):
    return metrics.run_counts(cells(spark, sf_dir), ["year"])


@query(f"WITH {RUNS} SELECT unit, year, round(avg(predicted), 6) AS predicted, round(coalesce(stddev_samp(predicted), 0), 6) AS sd, count(DISTINCT seed) AS n_runs, round(avg(actual), 6) AS actual, round(max(actual) - min(actual), 6) AS target_range FROM runs GROUP BY 1, 2")
def ensemble_spread(spark, sf_dir):
    return metrics.ensemble(runs(spark, sf_dir), ["unit", "year"])


GAINS = "gains AS (SELECT year(l_shipdate)::BIGINT AS fit, p_brand AS feature, sum(l_quantity) AS gain FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), shares AS (SELECT *, gain / sum(gain) OVER (PARTITION BY fit) AS share FROM gains)"


def shares(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.year("l_shipdate").cast("bigint").alias("fit"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("gain"))
    return metrics.gain_share(rows, ["fit"]).withColumnRenamed("gain_share", "share")


@query(f"WITH {GAINS}, ranked AS (SELECT fit, feature, round(share, 6) AS share, row_number() OVER (PARTITION BY fit ORDER BY round(share, 6) DESC, feature) AS rank FROM shares) SELECT * FROM ranked WHERE rank <= 8")
def importance_topk(spark, sf_dir):
    return reshape.top_k(shares(spark, sf_dir).select("fit", "feature", F.round("share", 6).alias("share")), ["fit"], [F.desc("share"), F.asc("feature")], 8)


@query(f"WITH {GAINS} SELECT feature, round(sum(share) / (SELECT count(DISTINCT fit) FROM shares), 6) AS mean_share FROM shares GROUP BY feature")
def importance_mean(spark, sf_dir):
    return metrics.importance_mean(shares(spark, sf_dir), ["fit"], ["feature"])


PAIRS = RUNS + ", pairs AS (SELECT a.unit, a.nation, a.year, a.actual, a.trend, a.predicted AS pa, b.predicted AS pb FROM runs a JOIN runs b ON a.unit = b.unit AND a.year = b.year AND a.seed = 1 AND b.seed = 2)"


def pairs(spark, sf_dir) -> DataFrame:
    r = runs(spark, sf_dir, 2)
    b = r.filter("seed = 2").select("unit", "year", F.col("predicted").alias("pb"))
    return r.filter("seed = 1").withColumnRenamed("predicted", "pa").join(b, ["unit", "year"])


ABS = ", errs AS (SELECT *, round(abs(actual - pa), 6) AS ea, round(abs(actual - pb), 6) AS eb FROM pairs)"


def errs(spark, sf_dir) -> DataFrame:
    return pairs(spark, sf_dir).withColumns({"ea": F.round(F.abs(F.col("actual") - F.col("pa")), 6), "eb": F.round(F.abs(F.col("actual") - F.col("pb")), 6)})


@query(f"WITH {PAIRS}{ABS} SELECT year, round(avg(ea), 6) AS mean_a, round(avg(eb), 6) AS mean_b, round(avg(ea - eb), 6) AS mean_diff, round(stddev_samp(ea - eb), 6) AS sd_diff, count(*) AS n, round(avg(ea - eb) / (stddev_samp(ea - eb) / sqrt(count(*))), 6) AS t FROM errs GROUP BY year")
def paired_t(spark, sf_dir):
    return stats.paired_t(errs(spark, sf_dir), ["year"], "ea", "eb").drop("p")


@query(f"WITH {PAIRS}{ABS}, d AS (SELECT year, round(ea - eb, 6) AS d FROM errs WHERE round(ea - eb, 6) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY abs(d)) + (count(*) OVER (PARTITION BY year, abs(d)) - 1) / 2.0 AS r FROM d) SELECT year, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN d < 0 THEN r ELSE 0 END), 6) AS w_minus, count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 6) AS w FROM r GROUP BY year")
def wilcoxon_w(spark, sf_dir):
    rows = errs(spark, sf_dir).withColumn("d", F.round(F.col("ea") - F.col("eb"), 6)).withColumn("zero", F.lit(0.0))
    return stats.wilcoxon(rows, ["year"], "d", "zero").drop("z", "p")


@query(f"WITH {PAIRS}, d AS (SELECT year, (actual - pa)^2 - (actual - pb)^2 AS d FROM pairs) SELECT year, round(avg(d), 5) AS mean_loss_diff, round(var_pop(d), 2) AS var, count(*) AS n, round(avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1.0) / count(*)), 5) AS dm FROM d GROUP BY year", digits=5)
def dm_stat(spark, sf_dir):
    return stats.dm_test(pairs(spark, sf_dir), ["year"], "actual", "pa", "pb").withColumn("var", F.round("var", 2)).drop("p", "verdict")


@query(
    f"""WITH {PAIRS}, m AS (SELECT year, count(*) AS n, var_pop(pa) AS xx, var_pop(pb) AS zz, var_pop(actual) AS yy, covar_pop(pa, pb) AS xz, covar_pop(pa, actual) AS xy, covar_pop(pb, actual) AS zy FROM pairs GROUP BY year),
c AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS ba, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bb FROM m), s AS (SELECT *, (yy - ba * xy - bb * zy) * n / (n - 3) AS s2 FROM c)
SELECT year, n, round(ba, 4) AS coef_a, round(bb, 4) AS coef_b, round(ba / sqrt(s2 * zz / (det * n)), 4) AS t_a, round(bb / sqrt(s2 * xx / (det * n)), 4) AS t_b FROM s""",
    digits=4,
)
def j_test(spark, sf_dir):
    return stats.j_test(pairs(spark, sf_dir), ["year"], "actual", "pa", "pb").drop("p_a", "p_b")


@query(f"WITH {PANEL}, p AS (SELECT year, unit, CASE WHEN unit % 7 <> 0 THEN (('0x' || substr(md5(concat_ws('|', unit, year)), 1, 8))::BIGINT % 100000) / 100000.0::DOUBLE END AS p FROM panel), r AS (SELECT *, row_number() OVER (PARTITION BY year, p IS NULL ORDER BY p, unit) AS r, count(p) OVER (PARTITION BY year) AS m FROM p) SELECT year, unit, p, CASE WHEN p IS NOT NULL THEN round(least(1, max(p * (m - r + 1)) OVER (PARTITION BY year, p IS NULL ORDER BY p, unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) END AS p_holm FROM r")
def holm(spark, sf_dir):
    p = (windows.portable_draw(F.col("unit").cast("string"), F.col("year").cast("string")) % 100000) / F.lit(100000.0)
    rows = panel(spark, sf_dir).select("year", "unit", F.when(F.col("unit") % 7 != 0, p).alias("p"))  # every seventh p-value is missing; no row is left out
    return windows.holm(rows, "p", ["year"], ["unit"])


STATISTICS = {"rmse_gap": "sqrt(sum(sa) / sum(n)) - sqrt(sum(sb) / sum(n))", "mae_gap": "sum(aa) / sum(n) - sum(ab) / sum(n)", "skill_a": "1 - sum(sa) / nullif(sum(st), 0)", "skill_b": "1 - sum(sb) / nullif(sum(st), 0)"}
BOOTSTRAP = f"""{PAIRS}, sums AS (SELECT year, nation, count(*) AS n, sum((actual - pa)^2) AS sa, sum((actual - pb)^2) AS sb, sum(abs(actual - pa)) AS aa, sum(abs(actual - pb)) AS ab, sum((actual - trend)^2) AS st, row_number() OVER (PARTITION BY year ORDER BY nation) - 1 AS i FROM pairs GROUP BY year, nation),
cell AS (SELECT year, {", ".join(f"{v} AS {k}" for k, v in STATISTICS.items())}, count(*) AS k FROM sums GROUP BY year), slots AS (SELECT year, k, draw, unnest(range(1, k + 1)) AS slot FROM cell, (SELECT unnest(range(1, 2001)) AS draw)),
picked AS (SELECT year, draw, ('0x' || substr(md5(concat_ws('|', 42, year, draw, slot)), 1, 8))::BIGINT % k AS i FROM slots), draws AS (SELECT year, draw, {", ".join(f"{v} AS {k}" for k, v in STATISTICS.items())} FROM picked JOIN sums USING (year, i) GROUP BY year, draw),
boot AS ({" UNION ALL ".join(f"SELECT cell.year, '{k}' AS statistic, round(any_value(cell.{k}), 5) AS point, CASE WHEN any_value(k) >= 2 THEN round(quantile_cont(draws.{k}, 0.025), 5) END AS low, CASE WHEN any_value(k) >= 2 THEN round(quantile_cont(draws.{k}, 0.975), 5) END AS high, any_value(k) AS n_clusters FROM cell JOIN draws USING (year) GROUP BY cell.year" for k in STATISTICS)})"""


@query(f"WITH {BOOTSTRAP} SELECT * FROM boot", digits=5)
def cluster_bootstrap(spark, sf_dir):
    return stats.cluster_bootstrap(pairs(spark, sf_dir), ["year"], "nation", "actual", "pa", "pb", 2000, 42)


@query(f"WITH {PAIRS} SELECT nation, round(1 - sum((actual - pa)^2) / nullif(sum((actual - trend)^2), 0), 6) AS skill_pa, round(avg(pa - actual), 6) AS bias_pa, round(1 - sum((actual - pb)^2) / nullif(sum((actual - trend)^2), 0), 6) AS skill_pb, round(avg(pb - actual), 6) AS bias_pb FROM pairs GROUP BY nation")
def skill_bias(spark, sf_dir):
    return stats.skill_bias(pairs(spark, sf_dir), ["nation"], "actual", "trend", "pa", "pb")


def confusion_sql() -> str:
    cells_ = {"tp": "{m} AND truth", "fp": "{m} AND NOT truth", "fn": "NOT {m} AND truth", "tn": "NOT {m} AND NOT truth"}
    out = ["count(*) FILTER (WHERE truth_valid) AS reference_n", "count(*) FILTER (WHERE truth_valid AND truth) AS reference_true", "count(*) FILTER (WHERE truth_valid AND a_valid AND b_valid) AS common_n", "count(*) FILTER (WHERE truth_valid AND a_valid AND b_valid AND truth) AS common_true"]
    for m in "ab":
        for domain, on in (("pair", f"truth_valid AND {m}_valid"), ("common", "truth_valid AND a_valid AND b_valid")):
            out += [f"count(*) FILTER (WHERE {on} AND {c.format(m=m)}) AS {domain}_{m}_{k}" for k, c in cells_.items()]
    return ", ".join(out)


def counts_by(spark, sf_dir, keys: list[str]) -> DataFrame:
    p = pixels(spark, sf_dir)
    return maps.confusion_counts(p, keys, F.col("truth"), F.col("truth_valid"), {m: (F.col(m), F.col(f"{m}_valid")) for m in "ab"})


@query(f"WITH {PIXELS} SELECT zone, year, {confusion_sql()} FROM pixels GROUP BY zone, year")
def confusion_counts(spark, sf_dir):
    return counts_by(spark, sf_dir, ["zone", "year"])


SETS = {f"{d}_{m}": tuple(f"{d}_{m}_{c}" for c in ("tp", "fp", "fn", "tn")) for d in ("pair", "common") for m in "ab"}
SCORES = f"{PIXELS}, counts AS (SELECT zone, year, {confusion_sql()} FROM pixels GROUP BY zone, year), rolled AS (SELECT year, " + ", ".join(f"sum({c})::BIGINT AS {c}" for s in SETS.values() for c in s) + " FROM counts GROUP BY year), listed AS (" + " UNION ALL ".join(f"SELECT year, '{k}' AS name, {a} AS tp, {b} AS fp, {c} AS fn, {d} AS tn FROM rolled" for k, (a, b, c, d) in SETS.items()) + "), scores AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp / nullif(tp + fp + fn, 0)::DOUBLE AS iou, (tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS accuracy, tn / nullif(tn + fp, 0)::DOUBLE AS specificity, (tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2 AS balanced_accuracy, (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc, fn / nullif(tp + fn, 0)::DOUBLE AS omission, fp / nullif(tp + fp, 0)::DOUBLE AS commission, 100 * (fp - fn) / nullif(tp + fn, 0)::DOUBLE AS area_bias_pct, (tp + fp) * 0.0009::DOUBLE AS area_km2, (tp + fn) * 0.0009::DOUBLE AS reference_km2, (tp + fp + fn + tn)::DOUBLE AS n FROM listed)"
SCORE_NAMES = ["precision", "recall", "f1", "iou", "accuracy", "specificity", "balanced_accuracy", "mcc", "omission", "commission", "area_bias_pct", "area_km2", "reference_km2", "n"]


def scored(spark, sf_dir) -> DataFrame:
    rolled = maps.rollup_counts(counts_by(spark, sf_dir, ["zone", "year"]), ["year"], [c for s in SETS.values() for c in s])
    return maps.with_scores(reshape.score_rows(rolled, ["year"], SETS))


@query(f"WITH {SCORES} SELECT year, name, tp, fp, fn, tn, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_NAMES) + " FROM scores")
def score_rows(spark, sf_dir):
    return scored(spark, sf_dir)


@query(f"WITH {SCORES} SELECT x.year, x.name AS mask_a, z.name AS mask_b, round(x.f1, 6) AS f1_a, round(z.f1, 6) AS f1_b, round(x.area_bias_pct, 6) AS area_bias_pct_a, round(z.area_bias_pct, 6) AS area_bias_pct_b, round(x.f1 - z.f1, 6) AS f1_delta, round(x.area_bias_pct - z.area_bias_pct, 6) AS area_bias_pct_delta, round(abs(x.area_bias_pct) - abs(z.area_bias_pct), 6) AS abs_bias_delta FROM scores x JOIN scores z ON x.year = z.year AND ((x.name = 'pair_a' AND z.name = 'pair_b') OR (x.name = 'common_a' AND z.name = 'common_b'))")
def paired_scores(spark, sf_dir):
    return joins.paired_scores(scored(spark, sf_dir), ["year"], "name", [("pair_a", "pair_b"), ("common_a", "common_b")], ["f1", "area_bias_pct"], "area_bias_pct")


@query(f"WITH {PIXELS}, z AS (SELECT zone, year, count(*) FILTER (WHERE truth_valid AND a_valid AND a) * 0.0009::DOUBLE AS p, count(*) FILTER (WHERE truth_valid AND a_valid AND truth) * 0.0009::DOUBLE AS a FROM pixels GROUP BY 1, 2) SELECT year, count(*) AS n_zones, round(1 - sum((a - p)^2) / (var_pop(a) * count(a)), 6) AS skill, round(sqrt(avg((a - p)^2)), 6) AS rmse, round(avg(abs(a - p)), 6) AS mae FROM z GROUP BY year")
def area_skill(spark, sf_dir):
    zones = maps.with_scores(reshape.score_rows(counts_by(spark, sf_dir, ["zone", "year"]), ["zone", "year"], {"pair_a": SETS["pair_a"]}))
    return maps.area_skill(zones, ["year"])


@query(f"WITH {SCORES}, c AS (SELECT * FROM scores WHERE name LIKE 'common%') SELECT year, name, round(area_km2, 6) AS area_km2 FROM c UNION ALL SELECT year, 'REFERENCE', round(max(reference_km2), 6) FROM c GROUP BY year")
def monthly_area(spark, sf_dir):
    return maps.monthly_area(scored(spark, sf_dir).filter(F.col("name").startswith("common")), ["year"])


SOURCES = "sources AS (SELECT l_partkey AS cell, l_suppkey AS source, min(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS class, max(l_quantity) > 10 AS ok FROM lineitem GROUP BY 1, 2)"


def sources(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("source")).agg(F.min(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).cast("bigint").alias("class"), (F.max("l_quantity") > 10).alias("ok"))


@query(f"WITH {SOURCES} SELECT cell, arg_min(class, source) AS class FROM sources WHERE ok GROUP BY cell")
def mosaic_first(spark, sf_dir):
    return maps.mosaic(sources(spark, sf_dir), ["cell"], "source", "class", F.col("ok"))


@query(f"WITH {SOURCES}, one AS (SELECT cell, min(class) AS class, count(DISTINCT class) > 1 AS c FROM sources GROUP BY cell) SELECT class, count(*) AS n_cells, count(*) FILTER (WHERE c) AS n_conflicts FROM one GROUP BY class")
def mosaic_summary(spark, sf_dir):
    return maps.mosaic_summary(sources(spark, sf_dir), ["cell"], "class")


@query("WITH s AS (SELECT user_id, ts::DATE AS date, value, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value, event_id) AS r FROM events) SELECT user_id, date, round(value, 6) AS value, event_id FROM s WHERE r = 1")
def best_scene(spark, sf_dir):
    return windows.best_scene(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "value", "event_id"), ["user_id", "date"], ["value", "event_id"])


HIST = "hist AS (SELECT l_partkey AS cell, year(l_shipdate)::BIGINT AS year, CASE WHEN sum(l_quantity) % 2 = 0 THEN 1 ELSE 5 END::BIGINT AS class FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {HIST}, d AS (SELECT *, lag(class) OVER (PARTITION BY cell ORDER BY year) AS p FROM hist), o AS (SELECT cell, min(class) AS lo, max(class) AS hi, arg_max(class, year) AS last, count(DISTINCT class) AS k, bool_and(CASE WHEN p IS NOT NULL THEN p <> class END) AS alt FROM d GROUP BY cell) SELECT cell, CASE WHEN lo = hi THEN lo WHEN k = 2 AND lo = 1 AND hi = 5 AND alt THEN CASE WHEN last = 1 THEN 5 ELSE 1 END ELSE 0 END::BIGINT AS label FROM o")
def trusted_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    hist = li.groupBy(F.col("l_partkey").alias("cell"), F.year("l_shipdate").cast("bigint").alias("year")).agg(F.when(F.sum("l_quantity") % 2 == 0, 1).otherwise(5).cast("bigint").alias("class"))
    return maps.trusted_labels(hist, ["cell"], "year", "class")


@query("SELECT o.o_orderkey AS okey, o.o_custkey AS cust, o.o_orderdate::DATE AS date, arg_max(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) AS before FROM orders o LEFT JOIN (SELECT o_custkey, o_orderdate::DATE AS d, max(o_orderkey) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1, 2) p ON p.o_custkey = o.o_custkey AND p.d < o.o_orderdate::DATE AND o.o_orderdate::DATE - p.d <= 64 GROUP BY 1, 2, 3".replace("(p.o_orderdate, p.o_orderkey)", "p.d"))
def asof_period(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("date"))
    right = o.groupBy("cust", "date").agg(F.max("okey").alias("before"))
    left = o.withColumn("until", F.date_sub("date", 1))
    return joins.asof(left, right.withColumnRenamed("date", "when"), "until", "when", ["cust"], ["before"], within=63).select("okey", "cust", "date", "before")


@query("WITH days AS (SELECT DISTINCT o_orderdate::DATE AS start FROM orders), outer_p AS (SELECT start AS period, start, start + 16 AS end_, start + 20 AS forecast FROM days), inner_p AS (SELECT start AS i_start, start + 8 AS i_end, start + 12 AS i_available FROM days), f AS (SELECT period, count(*) AS n_found FROM outer_p JOIN inner_p ON i_start >= start AND i_end <= end_ AND i_available <= forecast GROUP BY period) SELECT period, coalesce(n_found, 0) AS n_found, 2::BIGINT AS n_expected, coalesce(n_found, 0) = 2 AS complete FROM outer_p LEFT JOIN f USING (period)")
def contained_periods(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("start")).distinct()
    outer = days.select(F.col("start").alias("period"), "start", F.date_add("start", 16).alias("end"), F.date_add("start", 20).alias("forecast"))
    inner = days.select(F.col("start").alias("i_start"), F.date_add("start", 8).alias("i_end"), F.date_add("start", 12).alias("i_available"))
    return joins.contained_periods(outer, inner).select("period", "n_found", "n_expected", "complete")


@query("WITH o AS (SELECT year(o_orderdate)::BIGINT AS year, o_orderdate::DATE AS date, (o_orderdate::DATE - (o_custkey % 40)::INT) AS start, (o_orderdate::DATE - (o_custkey % 10)::INT) AS end_, (o_orderdate::DATE - (o_custkey % 12)::INT) AS latest, o_totalprice > 1000 AS usable FROM orders) SELECT year, count(*) AS n, count(*) FILTER (WHERE usable) AS n_usable, count(*) FILTER (WHERE usable AND start >= end_) AS bad_period, count(*) FILTER (WHERE usable AND (latest < start OR latest >= end_)) AS latest_outside, count(*) FILTER (WHERE usable AND latest > date) AS latest_after, count(*) FILTER (WHERE usable AND end_ + 4 > date + 1) AS not_released FROM o GROUP BY year")
def timing_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), F.to_date("o_orderdate").alias("date"), "o_custkey", (F.col("o_totalprice") > 1000).alias("usable"))
    back = lambda n: F.date_sub("date", (F.col("o_custkey") % n).cast("int"))
    return audits.timing_audit(o.withColumns({"start": back(40), "end": back(10), "latest": back(12)}), ["year"], "date", "start", "end", "latest", F.lit(4), F.col("usable"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return metrics.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def average_duplicates(spark, sf_dir):
    return metrics.average_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def conflicts(spark, sf_dir):
    return metrics.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(f"WITH {SPARSE} SELECT u.unit, v.year FROM (SELECT DISTINCT unit FROM sparse) u CROSS JOIN (SELECT DISTINCT year FROM sparse) v ANTI JOIN sparse s ON s.unit = u.unit AND s.year = v.year")
def missing_cells(spark, sf_dir):
    rows = sparse(spark, sf_dir)
    return joins.missing_cells(joins.expected_grid(rows.select("unit").distinct(), F.broadcast(rows.select("year").distinct())), rows, ["unit", "year"])  # a row a year


@query(f"WITH {SCORES} SELECT year, name, 'biased' AS flag, round(area_bias_pct, 6) AS value FROM scores WHERE abs(area_bias_pct) > 20 UNION ALL SELECT year, name, 'weak', round(f1, 6) FROM scores WHERE f1 < 0.5")
def coverage_flags(spark, sf_dir):
    s = scored(spark, sf_dir)
    return audits.coverage_flags(s, ["year", "name"], {"biased": (F.abs("area_bias_pct") > 20, F.col("area_bias_pct")), "weak": (F.col("f1") < 0.5, F.col("f1"))})


@query("SELECT user_id, event_type, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY 1, 2")
def latest_status(spark, sf_dir):
    return windows.latest_status(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', '42', event_id)), event_id) AS r FROM events) SELECT event_type, event_id FROM r WHERE r <= 100")
def balanced_sample(spark, sf_dir):
    return windows.balanced_sample(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 100, 42)


@query("WITH i AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_partkey % 4 WHEN 0 THEN ' ' || l_partkey || '.0' WHEN 1 THEN l_suppkey::VARCHAR WHEN 2 THEN 'x' || l_suppkey ELSE (l_suppkey * 1000)::VARCHAR END AS raw FROM lineitem), s AS (SELECT *, regexp_replace(trim(raw), '\\.0*$', '') AS t FROM i), p AS (SELECT *, lpad(t, 5, '0') AS p FROM s) SELECT l_orderkey, l_linenumber, raw, CASE WHEN regexp_matches(t, '^[0-9]{1,5}$') AND NOT starts_with(p, '00') AND NOT ends_with(p, '000') THEN p END AS fips FROM p")
def clean_fips(spark, sf_dir):
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(".0"))).when(k == 1, F.col("l_suppkey").cast("string")).when(k == 2, F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))).otherwise((F.col("l_suppkey") * 1000).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("raw"))
    return rows.withColumn("fips", cl.clean_fips("raw"))


@query(f"WITH {SEASON}, z AS (SELECT DISTINCT l_partkey AS unit FROM lineitem) SELECT z.unit, round(avg(value), 6) AS value, count(value) AS value_count FROM z LEFT JOIN season USING (unit) GROUP BY z.unit")
def zonal_mean(spark, sf_dir):
    zones = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"))
    return maps.zonal_mean(season(spark, sf_dir, GRID), zones, ["unit"], ["value"])


@query(f"WITH {SEASON} SELECT unit, doy, round(median(value), 6) AS value, count(*) AS n_images FROM season GROUP BY unit, doy")
def median_composite(spark, sf_dir):
    return maps.median_composite(season(spark, sf_dir, GRID), ["unit", "doy"], ["value"])


@query(f"WITH {RUNS} SELECT year, count(*) AS n, count(DISTINCT unit) AS n_units, round(avg(actual), 6) AS mean_actual, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg((predicted - actual)^2)), 6) AS rmse, round(quantile_cont(predicted - actual, 0.25), 6) AS q25, round(quantile_cont(predicted - actual, 0.5), 6) AS q50, round(quantile_cont(predicted - actual, 0.75), 6) AS q75 FROM runs GROUP BY year")
def dashboard_kpis(spark, sf_dir):
    return metrics.dashboard_kpis(runs(spark, sf_dir), ["year"], "unit")


@query(f"WITH {CELLS} SELECT seed AS trees, round(avg(rmse), 5) AS mean, round(stddev_samp(rmse) / sqrt(count(rmse)), 5) AS se FROM cells GROUP BY seed", digits=5)
def tree_curve(spark, sf_dir):
    return metrics.tree_curve(cells(spark, sf_dir).withColumnRenamed("seed", "trees"), "trees", "rmse")


@query(f"WITH {CELLS} SELECT seed, year, rmse, round(100 * (rmse - lag(rmse) OVER w) / nullif(lag(rmse) OVER w, 0), 6) AS pct_change FROM cells WINDOW w AS (PARTITION BY year ORDER BY seed)")
def pct_change(spark, sf_dir):
    return windows.pct_change(cells(spark, sf_dir).select("seed", "year", "rmse"), ["year"], "seed", "rmse")


@query(f"WITH {TRENDED} SELECT count(*) AS n, count(*) FILTER (WHERE trend_last >= year) AS leaks FROM trended")
def leakage_audit(spark, sf_dir):
    return audits.leakage_audit(trended(spark, sf_dir), "trend_last", "year")


@query(f"WITH {SEASON} SELECT unit, year, count(DISTINCT doy) AS n_doys, count(DISTINCT doy) = 14 AS complete FROM season GROUP BY unit, year")
def grid_check(spark, sf_dir):
    rows = season(spark, sf_dir, GRID).withColumn("doy", F.col("doy").cast("int"))
    return audits.grid_check(rows, ["unit", "year"], "doy", GRID)


@query(f"WITH {SPARSE} SELECT year, count(*) AS n FROM sparse GROUP BY year")
def coverage(spark, sf_dir):
    return metrics.coverage(sparse(spark, sf_dir), ["year"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey::INT & 3 IN (0, 3) AND (l_partkey::INT >> 2) & 1 = 0 AND (l_partkey::INT >> 10) & 1 = 0 AND (l_partkey::INT >> 12) & 1 = 0 AS ok FROM lineitem".replace("l_partkey::INT & 3 IN", "(l_partkey::INT & 3) IN").replace("(l_partkey::INT >> 2) & 1 = 0", "((l_partkey::INT >> 2) & 1) = 0").replace("(l_partkey::INT >> 10) & 1 = 0", "((l_partkey::INT >> 10) & 1) = 0").replace("(l_partkey::INT >> 12) & 1 = 0", "((l_partkey::INT >> 12) & 1) = 0"))
def qa_bits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sc.qa_ok("l_partkey").alias("ok"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((n - r) / nullif(n + r, 0), 6) AS \"NDVI\", round(2.5 * (n - r) / nullif(n + 2.4 * r + 1, 0), 6) AS \"EVI2\", round((n - s) / nullif(n + s, 0), 6) AS \"NDMI\", round((g - n) / nullif(g + n, 0), 6) AS \"NDWI\", round(n / nullif(g, 0) - 1, 6) AS \"GCI\", round(n * (n - r) / nullif(n + r, 0), 6) AS \"NIRv\" FROM (SELECT *, l_discount AS r, l_quantity / 50 AS n, l_tax AS g, l_extendedprice / 100000 AS s FROM lineitem)")
def vegetation_indices(spark, sf_dir):
    bands = {"blue": "l_tax", "green": "l_tax", "red": "l_discount"}
    rows = table(spark, sf_dir, "lineitem").withColumns({k: F.col(v) for k, v in bands.items()} | {"nir": F.col("l_quantity") / 50, "swir1": F.col("l_extendedprice") / 100000})
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in sc.veg_indices().items()])


@query("SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) + (65 + 16 * (o_custkey % 14)::INT - 1) AS date, CASE WHEN 65 + 16 * (o_custkey % 14) <= 209 THEN 'JUNE' WHEN 65 + 16 * (o_custkey % 14) <= 241 THEN 'JULY' ELSE 'AUGUST' END AS month FROM orders")
def checkpoint_calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("doy", 65 + 16 * (F.col("o_custkey") % 14))
    return o.select("o_orderkey", sc.doy_to_date(F.year("o_orderdate"), "doy").alias("date"), sc.mask_month("doy").alias("month"))


def backtest_panel(spark, sf_dir) -> DataFrame:
    """unit, year, doy, scenario, y, trend and features: two checkpoints, the units' own season as one scenario and a damped one as another."""
    rows = windows.prior_mean(trended(spark, sf_dir), ["unit"], "year", "y", "prior", 1).filter("trend is not null")
    rows = rows.select("unit", "year", "y", "trend", "prior", F.col("trend_slope").alias("slope"), F.col("year").cast("double").alias("when"))
    rows = rows.withColumn("doy", F.explode(F.array(F.lit(113), F.lit(193)))).withColumn("prior", F.when(F.col("doy") == 193, F.col("prior")))
    rows = rows.withColumn("scenario", F.explode(F.array(F.lit("own"), F.lit("damped"))))
    other = F.col("scenario") == "damped"
    return rows.filter(~other | (F.col("unit") % 5 != 0)).withColumn("slope", F.when(other, F.col("slope") / 2).otherwise(F.col("slope")))


@query()
def gbt_backtest(spark, sf_dir):
    """Rows only: Spark ML has no counterpart in SQL. All years of the table that have enough before them; 10 trees, as the canonical 200 take minutes a cell here."""
    rows = backtest_panel(spark, sf_dir)
    years = [r[0] for r in rows.select("year").distinct().orderBy("year").collect()]
    return models.backtest(rows, years, [113, 193], ["prior", "slope", "trend", "when"], "unit", "y", "trend", scenario="scenario", train_scenario="own", maxIter=10)


@query("SELECT user_id, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') + INTERVAL '5 days' AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", digits=4)
def stream_trailing(spark, sf_dir):
    out = streams.stream_trailing(table(spark, sf_dir, "events"), "user_id", "ts", "5 days", "1 day", [F.count("*").alias("n"), F.sum("value").alias("total")])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
