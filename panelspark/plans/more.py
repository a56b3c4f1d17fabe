"""Further queries: cleaning, scalar functions, reshaping, joins, report tables and audits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import cleaning as cl
from panelspark.functions import scalar as sc
from panelspark.operators import audits, joins, maps, metrics, models, reshape, series, stats, windows
from panelspark.sources import tables as src
from panelspark.streaming import streams

from .bindings import PANEL, PIXELS, RUNS, SEASON, SPARSE, TRENDED, panel, pixels, runs, season, season_lines, sparse, table, trended
from .registry import CELLS, FEATURES, FILLED, GAINS, GRID, PAIRS, SCORES, cells, pairs, query, scored, shares

FLAG = {"A": 1, "N": 2, "R": 3}


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("SELECT o_orderkey, CASE WHEN length(t) >= 5 THEN t ELSE lpad(t, 5, '0') END AS lenient, CASE WHEN s BETWEEN 1 AND 56 AND c BETWEEN 1 AND 998 THEN lpad(s::VARCHAR, 2, '0') || lpad(c::VARCHAR, 3, '0') END AS parts FROM (SELECT o_orderkey, regexp_replace(o_custkey || '.0', '\\.0$', '') AS t, o_custkey % 60 AS s, o_orderkey % 1100 AS c FROM orders)")
def ids_from_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", cl.clean_fips_lenient(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("lenient"), cl.fips_from_parts(F.col("o_custkey") % 60, F.col("o_orderkey") % 1100).alias("parts"))


@query("SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE o_totalprice END AS x, round(coalesce(CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE o_totalprice END, -1), 6) AS filled, o_custkey % 3 = 0 AS flag FROM orders")
def numbers_from_text(spark, sf_dir):
    k = F.col("o_custkey") % 4
    text = F.when(k == 0, "NaN").when(k == 1, "n/a").otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    o = table(spark, sf_dir, "orders").withColumn("x", cl.num_us(text))
    return o.select("o_orderkey", "x", cl.coalesce_cols("x", F.lit(-1.0)).alias("filled"), cl.flag(F.when(F.col("o_custkey") % 3 == 0, " TRUE ").otherwise("no")).alias("flag"))


@query("SELECT count(*) FILTER (WHERE l_discount > 0.08 + 1e-6) AS l_discount_outside, count(*) FILTER (WHERE l_quantity < 5 - 1e-6 OR l_quantity > 45 + 1e-6) AS l_quantity_outside FROM lineitem")
def index_ranges(spark, sf_dir):
    return cl.check_ranges(lines(spark, sf_dir), {"l_discount": (None, 0.08), "l_quantity": (5, 45)})


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity * 1e-4 BETWEEN -1 AND 1 THEN round(l_quantity * 1e-4, 6) END AS l_quantity, round(l_discount * 2, 6) AS l_discount FROM lineitem")
def scaled_values(spark, sf_dir):
    rows = cl.scale_indices(cl.autoscale(lines(spark, sf_dir), "l_quantity"), {"l_discount": 2.0})
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE upper(o_orderstatus) = 'O' AND o_custkey IS NOT NULL")
def survey_only(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn(" Program ", F.when(F.col("o_orderstatus") == "O", "Survey ").otherwise("census"))
    return cl.require_keys(cl.survey_rows(o), ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, make_date(y, 1, 1) + (d - 1) >= greatest(make_date(y, CASE m WHEN 'JUNE' THEN 7 WHEN 'JULY' THEN 8 ELSE 9 END, 1), dt + 30) AS permitted FROM (SELECT o_orderkey, year(o_orderdate) AS y, (150 + o_custkey % 150)::INT AS d, ['JUNE', 'JULY', 'AUGUST'][(o_custkey % 3 + 1)::INT] AS m, o_orderdate::DATE AS dt FROM orders)")
def permitted_masks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    month = F.element_at(F.array(*[F.lit(m) for m in ("JUNE", "JULY", "AUGUST")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", sc.permitted(F.year("o_orderdate"), 150 + F.col("o_custkey") % 150, month, F.date_add(F.to_date("o_orderdate"), 30)).alias("permitted"))


@query(f"WITH {RUNS} SELECT seed, unit, year, round(actual - predicted, 6) AS residual, round(predicted - actual, 6) AS signed_error, round(abs(actual - predicted), 6) AS abs_error, round((actual - predicted)^2, 3) AS sq_error, round(100 * abs(actual - predicted) / nullif(abs(actual), 0), 6) AS pct_error, round(abs(actual - predicted) / greatest(abs(actual), abs(predicted)), 6) AS rel_diff, CASE WHEN predicted > trend THEN 'A' WHEN predicted < trend THEN 'B' ELSE 'tie' END AS winner FROM runs")
def error_columns(spark, sf_dir):
    e = sc.errors("actual", "predicted") | {"winner": sc.better("predicted", "trend", "r2")}
    return runs(spark, sf_dir).select("seed", "unit", "year", *[F.round(c, 3).alias(k) if k == "sq_error" else c.alias(k) for k, c in e.items()])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((l_discount * 100 + l_tax * 100) / 2, 6) AS vpdmean, greatest(l_quantity - 30, 0.0) AS heat30, (l_quantity >= 35)::BIGINT AS hot35, (l_discount < 1)::BIGINT AS dryday, least(l_shipdate::DATE + 16, make_date(year(l_shipdate) + 1, 1, 1)) AS period_end, lpad(dayofyear(l_shipdate)::VARCHAR, 3, '0') AS label FROM lineitem")
def weather_columns(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({"tmax": F.col("l_quantity"), "ppt": F.col("l_discount"), "vpdmin": F.col("l_discount") * 100, "vpdmax": F.col("l_tax") * 100})
    more = {"period_end": sc.period_end(F.to_date("l_shipdate"), 16), "label": sc.doy_label(F.dayofyear("l_shipdate"))}
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in (sc.daily_weather() | more).items()])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((n - r) / (n + r + 1e-8), 6) AS ndvi, round((g - n) / (g + n + 1e-8), 6) AS ndwi, NOT (l_partkey % 12) IN (0, 1, 3, 8, 9, 10, 11) AS clear, l_discount > 0 AND l_tax > 0 AS physical, least(greatest(round_even(l_discount * 0.5 * 10000, 0), -32767), 32767)::BIGINT AS encoded, CASE WHEN l_quantity < 10 THEN 'NO_VALID_PIXELS' WHEN l_quantity < 20 THEN 'NO_REFERENCE_CORN' ELSE 'OK' END AS status FROM (SELECT *, l_discount / 100 AS g, l_tax / 100 AS r, l_quantity / 10000 AS n FROM lineitem)")
def pixel_columns(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({"g": F.col("l_discount") * 100, "r": F.col("l_tax") * 100, "n": F.col("l_quantity")})
    more = {"clear": sc.scl_ok(F.col("l_partkey") % 12), "physical": sc.refl_ok("l_discount", "l_tax"), "encoded": sc.encode_refl("l_discount", F.lit(0.5), F.lit(0.0)), "status": sc.count_status(F.when(F.col("l_quantity") < 10, 0).otherwise(1), F.when(F.col("l_quantity") < 20, 0).otherwise(1))}
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in (sc.pixel_indices("g", "r", "n") | more).items()])


@query(f"WITH {PIXELS}, t AS (SELECT zone, count(*) FILTER (WHERE a AND b) AS w, count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE b AND NOT a) AS y, count(*) FILTER (WHERE NOT a AND NOT b) AS z FROM pixels GROUP BY zone) SELECT zone, round((w + z) / (w + x + y + z), 6) AS agreement, round(2 * w / nullif(2 * w + x + y, 0), 6) AS dice, round(w / nullif(w + x + y, 0), 6) AS iou, round((x + y) * 0.0009, 6) AS disagreement_km2, round(x * 0.0009, 6) AS only_a_km2, round(y * 0.0009, 6) AS only_b_km2 FROM t")
def map_agreement(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumns({"w": F.col("a") & F.col("b"), "x": F.col("a") & ~F.col("b"), "y": F.col("b") & ~F.col("a"), "z": ~F.col("a") & ~F.col("b")})
    counts = maps.zonal_counts(p, ["zone"], ["w", "x", "y", "z"])
    return counts.select("zone", *[c.alias(k) for k, c in sc.agreement_scores("w", "x", "y", "z").items()])


@query("SELECT p_partkey, CASE WHEN n LIKE 'hist_yield_trend%' THEN 'trend' WHEN n LIKE 'year%' THEN 'year' WHEN n LIKE 'recent%' OR n LIKE 'season%' THEN 'weather' WHEN n LIKE 'AWC%' THEN 'awc' WHEN n LIKE 'CEC%' THEN 'cec' WHEN n LIKE '%anom%' THEN 'anomaly' ELSE 'vegetation' END AS grp, replace(n, '_', ' ') AS label, CASE WHEN abs(p_size / 1000.0) > 0.002 THEN round(100 * 0.01 / (p_size / 1000.0::DOUBLE), 6) END AS gain FROM (SELECT *, ['hist_yield_trend', 'year', 'season_ppt', 'AWC100', 'CEC_1', 'NDVI_anom_mean', 'NDVI_mean'][(p_partkey % 7 + 1)::INT] AS n FROM part)")
def feature_names(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("hist_yield_trend", "year", "season_ppt", "AWC100", "CEC_1", "NDVI_anom_mean", "NDVI_mean")])
    n = F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sc.feature_group(n).alias("grp"), sc.feature_label(n).alias("label"), sc.gain_reproduced(F.lit(0.01), F.col("p_size") / 1000.0).alias("gain"))


@query(f"WITH {CELLS} SELECT year, " + ", ".join(f"max(CASE WHEN seed = {s} THEN rmse END) AS \"{s}\"" for s in range(1, 6)) + " FROM cells GROUP BY year")
def pivot_metric(spark, sf_dir):
    return reshape.pivot_metric(cells(spark, sf_dir), ["year"], "seed", [1, 2, 3, 4, 5], "rmse")


@query(f"WITH {GAINS}, f AS (SELECT DISTINCT fit FROM shares), b AS (SELECT DISTINCT feature FROM shares) SELECT fit, feature, round(coalesce(share, 0), 6) AS share FROM f CROSS JOIN b LEFT JOIN shares USING (fit, feature)")
def importance_matrix(spark, sf_dir):
    return reshape.importance_matrix(shares(spark, sf_dir), ["fit"])


@query(f"WITH {GAINS} SELECT feature, round(100 * avg(share), 6) AS mean_pct, round(100 * coalesce(stddev_samp(share), 0), 6) AS sd_pct FROM shares GROUP BY feature")
def importance_summary(spark, sf_dir):
    return metrics.importance_summary(shares(spark, sf_dir), ["feature"])


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ';') AS kinds FROM events GROUP BY user_id")
def joined_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws("; ", F.collect_list("event_type")).alias("kinds"))
    return reshape.join_list(reshape.split_list(e, "kinds"), ["user_id"], "kinds")


@query(f"WITH {PANEL} SELECT unit, year, round(y, 4) AS y, s_name, round(s_acctbal, 4) AS s_acctbal FROM panel LEFT JOIN supplier ON s_suppkey = unit", digits=4)
def attach_static(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), "s_name", "s_acctbal")
    return joins.checked_join(panel(spark, sf_dir), s, ["unit"], "left", "many_to_one")


@query(f"WITH {SEASON}, k AS (SELECT DISTINCT unit, year FROM season) SELECT unit, year, round(value, 6) AS value FROM k LEFT JOIN (SELECT * FROM season WHERE doy = 193) USING (unit, year)")
def attach_at_checkpoint(spark, sf_dir):
    s = season(spark, sf_dir, GRID)
    return joins.attach_at(s.select("unit", "year").distinct(), s, ["unit", "year"], 193)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def match_histories(spark, sf_dir):
    li = lines(spark, sf_dir)
    return joins.match_histories(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def intersect_keys(spark, sf_dir):
    li = lines(spark, sf_dir)
    return reshape.intersect_keys([li.filter(F.col("l_returnflag") == f) for f in FLAG], ["l_partkey"])


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_keys(spark, sf_dir):
    li = lines(spark, sf_dir)
    return reshape.except_keys(li.filter("l_returnflag = 'A'"), li.filter("l_quantity > 45"), ["l_partkey"])


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b")
def same_keys(spark, sf_dir):
    li = lines(spark, sf_dir)
    return reshape.same_keys(li.filter("l_returnflag = 'A'"), li.filter("l_quantity > 45"), ["l_partkey"])


@query(f"WITH {CELLS} SELECT a.year, a.rmse AS rmse_a, b.rmse AS rmse_b, round(a.rmse - b.rmse, 6) AS rmse_delta FROM cells a JOIN cells b USING (year) WHERE a.seed = 2 AND b.seed = 3")
def metric_delta(spark, sf_dir):
    return joins.metric_delta(cells(spark, sf_dir), ["year"], "seed", 2, 3, ["rmse"])


@query(f"WITH {PANEL} SELECT i.unit, i.year, round(i.y, 4) AS y, round(m.y, 4) AS mask_y FROM panel i JOIN panel m ON m.unit = i.unit AND m.year + 1 = i.year", digits=4)
def lag_mask(spark, sf_dir):
    p = panel(spark, sf_dir)
    return joins.lag_mask(p, p.select("unit", F.col("year").alias("mask_year"), F.col("y").alias("mask_y")), ["unit"]).select("unit", "year", "y", "mask_y")


@query("SELECT c_custkey, coalesce(n_name, 'County ' || c_custkey) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey")
def names_with_default(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.with_names(table(spark, sf_dir, "customer"), n, "c_nationkey", "n_name", F.concat(F.lit("County "), F.col("c_custkey").cast("string"))).select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300) ORDER BY c_custkey LIMIT 10")
def unmatched_examples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 300").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unmatched_examples(table(spark, sf_dir, "customer"), o, ["c_custkey"], 10)


@query(f"WITH {RUNS} SELECT count(*) AS n, count(*) FILTER (WHERE abs(a.actual - b.actual) > 1e-9) AS differing FROM runs a JOIN runs b USING (unit, year) WHERE a.seed = 1 AND b.seed = 2")
def same_targets(spark, sf_dir):
    r = runs(spark, sf_dir, 2)
    return joins.same_targets(r.filter("seed = 1"), r.filter("seed = 2"), ["unit", "year"], "actual")


@query("WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE r = 1")
def first_per_key(spark, sf_dir):
    return metrics.first_per_key(lines(spark, sf_dir).select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query(f"WITH {SPARSE} SELECT unit, CASE WHEN count(y) >= 3 THEN round(avg(y), 6) END AS y_prior FROM sparse WHERE year < 2000 GROUP BY unit")
def history_means(spark, sf_dir):
    return metrics.history_means(sparse(spark, sf_dir), ["unit"], 2000, ["y"])


@query(f"WITH {SPARSE} SELECT unit, count(*) AS n_train, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) >= 3 AND count(*) >= 4 AS enough FROM sparse GROUP BY unit")
def training_audit(spark, sf_dir):
    return metrics.training_audit(sparse(spark, sf_dir), ["unit"], least_rows=4)


@query(f"WITH {TRENDED} SELECT round(median(y), 4) AS y, round(median(trend), 4) AS trend FROM trended", digits=4)
def train_medians(spark, sf_dir):
    return metrics.train_medians(trended(spark, sf_dir), ["y", "trend"])


@query(f"WITH {TRENDED} SELECT 'y' AS \"column\", count(y) / count(*) AS share, count(y) = 0 AS all_missing FROM trended UNION ALL SELECT 'trend', round(count(trend) / count(*), 6), count(trend) = 0 FROM trended")
def cell_coverage(spark, sf_dir):
    return metrics.cell_coverage(trended(spark, sf_dir), ["y", "trend"])


@query(f"WITH {TRENDED}, m AS (SELECT median(trend) AS m FROM trended WHERE year < 2000) SELECT unit, year, round(coalesce(trend, m), 3) AS trend FROM trended, m", digits=3)
def imputed(spark, sf_dir):
    rows = trended(spark, sf_dir)
    return models.impute(rows, models.medians_of(rows.filter("year < 2000"), ["trend"])).select("unit", "year", "trend")


@query(f"WITH {PIXELS} SELECT zone, count(*) AS n, count(*) FILTER (WHERE a_valid) AS n_valid, count(*) FILTER (WHERE a_valid AND a) AS n_class, round(100 * count(*) FILTER (WHERE a_valid) / count(*), 6) AS coverage_pct, round(count(*) FILTER (WHERE a_valid AND a) * 0.0009, 6) AS class_km2 FROM pixels GROUP BY zone")
def mask_coverage(spark, sf_dir):
    return maps.mask_coverage(pixels(spark, sf_dir), ["zone"], F.col("a_valid"), F.col("a"))


@query(f"WITH {CELLS} SELECT seed, round(avg(rmse), 5) AS mean, round(coalesce(stddev_samp(rmse), 0), 5) AS sd, count(*) AS n_periods, count(DISTINCT year) AS n_years FROM cells GROUP BY seed", digits=5)
def period_summary(spark, sf_dir):
    return metrics.period_summary(cells(spark, sf_dir), ["seed"], "rmse")


@query(f"WITH {CELLS} SELECT round(avg(a.rmse - b.rmse), 5) AS mean_delta, round(coalesce(stddev_samp(a.rmse - b.rmse), 0), 5) AS sd_delta, count(*) AS n FROM cells a JOIN cells b USING (year) WHERE a.seed = 1 AND b.seed = 2", digits=5)
def period_delta(spark, sf_dir):
    return metrics.period_delta(cells(spark, sf_dir), ["year"], "seed", 1, 2, "rmse")


@query(f"WITH {CELLS} SELECT year, round(avg(rmse), 5) AS mean, round(stddev_samp(rmse), 5) AS sd, round(min(rmse), 5) AS low, round(max(rmse), 5) AS high FROM cells GROUP BY year", digits=5)
def seasonal_profile(spark, sf_dir):
    return metrics.seasonal_profile(cells(spark, sf_dir), ["year"], "rmse")


@query(f"WITH {RUNS} SELECT unit, year, round(avg(predicted), 5) AS predicted, round(avg(actual), 5) AS actual, round(avg(predicted - actual), 5) AS difference FROM runs GROUP BY unit, year", digits=5)
def map_table(spark, sf_dir):
    return metrics.map_table(runs(spark, sf_dir), ["unit", "year"])


@query(f"WITH {RUNS} SELECT seed, year, round(100 * (1 - avg((actual - predicted)^2) / nullif(avg((actual - trend)^2), 0)), 5) AS skill_pct FROM runs GROUP BY seed, year", digits=5)
def skill_curve(spark, sf_dir):
    return metrics.skill_curve(runs(spark, sf_dir), ["seed", "year"])


@query(f"WITH {CELLS} SELECT seed, year, true AS agrees FROM cells")
def verified_metrics(spark, sf_dir):
    r = runs(spark, sf_dir)
    return metrics.verify_metrics(r, metrics.forecast_metrics(r, ["seed", "year"]).select("seed", "year", "rmse", "mae"), ["seed", "year"], ["rmse", "mae"]).select("seed", "year", "agrees")


@query(f"WITH {SPARSE} SELECT unit, year, round(sum(y) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 8) AS rolled, round(avg(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS mean FROM sparse WINDOW w AS (PARTITION BY unit ORDER BY year)", digits=8)
def rolling_values(spark, sf_dir):
    rows = windows.rolling_sum(sparse(spark, sf_dir), ["unit"], "year", "y", 2, "rolled")
    return windows.season_mean(rows, ["unit"], "year", "y", "mean").drop("y")


@query(f"WITH {SPARSE} SELECT unit, year, rank() OVER (PARTITION BY year ORDER BY round(y, 0)) + (count(*) OVER (PARTITION BY year, round(y, 0)) - 1) / 2.0 AS rank FROM sparse")
def average_ranks(spark, sf_dir):
    return windows.avg_rank(sparse(spark, sf_dir), ["year"], F.round("y", 0)).drop("y")


@query("WITH d AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, coalesce(bool_and(CASE WHEN p IS NOT NULL THEN p <> event_type END), false) AS alternates FROM d GROUP BY user_id")
def alternating(spark, sf_dir):
    return windows.alternating(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query(f"WITH {SEASON}, k AS (SELECT DISTINCT unit FROM season), g AS (SELECT unit, unnest(range(65, 274, 16)) AS doy FROM k), f AS (SELECT unit, doy, value FROM g LEFT JOIN (SELECT unit, doy, round(avg(value), 9) AS value FROM season GROUP BY 1, 2) USING (unit, doy)) SELECT unit, doy::BIGINT AS doy, round(coalesce(value, median(value) OVER (PARTITION BY unit), (SELECT median(value) FROM f)), 5) AS value FROM f", digits=5)
def filled_cube(spark, sf_dir):
    rows = season(spark, sf_dir, GRID).groupBy("unit", "doy").agg(F.round(F.avg("value"), 9).alias("value"))
    return series.fill_cube(reshape.on_grid(rows, ["unit"], GRID).withColumn("band", F.lit("b")), ["unit"], "band", "value").select("unit", "doy", "value")


#: Seven variables of order lines in the place of vegetation indices, each with gaps of its own.
INDICES = {"ndvi": "sqrt(l_quantity)", "evi": "ln(l_extendedprice)", "evi2": "CASE WHEN l_returnflag <> 'A' THEN sqrt(l_tax + 0.2) END", "ndmi": "CASE WHEN l_linenumber > 1 THEN ln(l_quantity + 1) END", "ndwi": "CASE WHEN l_returnflag = 'N' THEN sqrt(l_extendedprice) / 100 END", "gci": "CASE WHEN l_linestatus = 'F' THEN l_quantity * sqrt(l_tax + 0.1) END", "nirv": "sqrt(l_quantity * (l_discount + 0.05))"}


def features_sql(cut: int) -> str:
    """All features of all variables, each by windows of its own."""
    days = [g for g in GRID if g <= cut]
    parts = [f"lines AS (SELECT l_partkey AS unit, year(l_shipdate)::BIGINT AS year, (65 + 16 * ceil((dayofyear(l_shipdate) - 65) / 16.0))::BIGINT AS doy, * FROM lineitem WHERE dayofyear(l_shipdate) BETWEEN 50 AND 273)"]
    parts.append("cells7 AS (SELECT unit, year, doy, " + ", ".join(f"avg({e}) AS {v}" for v, e in INDICES.items()) + f" FROM lines WHERE doy <= {cut} GROUP BY 1, 2, 3)")
    parts.append(f"grid7 AS (SELECT unit, year, doy FROM (SELECT DISTINCT unit, year FROM cells7), (SELECT unnest(range(65, {cut} + 1, 16)) AS doy))")
    for v in INDICES:
        body = f"full_season AS (SELECT unit, year, doy::BIGINT AS doy, {v} AS value FROM grid7 LEFT JOIN cells7 USING (unit, year, doy))" + FILLED + FEATURES
        stats = ", ".join(f"{s} AS {v}_{s}" for s in series.STATS)
        wide = ", ".join(f"max(CASE WHEN doy = {d} THEN filled END) AS {v}_DOY_{d}" for d in days)
        grid_body = f"full_season AS (SELECT unit, year, doy::BIGINT AS doy, {v} AS value FROM grid7 LEFT JOIN cells7 USING (unit, year, doy))" + FILLED
        parts.append(f"f_{v} AS (SELECT unit, year, {stats} FROM (WITH {body}))")
        parts.append(f"g_{v} AS (SELECT unit, year, {wide} FROM (WITH {grid_body} SELECT * FROM filled) GROUP BY 1, 2)")
    names = [f"{v}_{s}" for v in INDICES for s in [*series.STATS, *[f"DOY_{d}" for d in days]]]
    return "WITH " + ", ".join(parts) + " SELECT unit, year, " + ", ".join(f"round({n}, 6) AS {n}" if "_DOY_" in n else n for n in names) + " FROM f_ndvi " + " ".join(f"JOIN {t}_{v} USING (unit, year)" for v in INDICES for t in "fg" if (t, v) != ("f", "ndvi"))


@query(features_sql(193), exact=tuple(f"{v}_{s}" for v in INDICES for s in ("std", "auc", "greenup")))
def model_features(spark, sf_dir):
    """The wide feature table of seven variables at one cut: one shuffle, then folds over their arrays."""
    out = series.build_features(season_lines(spark, sf_dir, GRID, **INDICES), ["unit", "year"], list(INDICES), GRID, 193)
    return out.withColumns({f"{v}_{s}": F.round(f"{v}_{s}", n) for v in INDICES for s, n in (("std", 5), ("auc", 5), ("greenup", 9))})


@query(f"WITH {PANEL} SELECT unit, count(*) AS n, count(DISTINCT CASE WHEN y > 2000 THEN 1 ELSE 0 END) AS n_classes, count(*) FILTER (WHERE y > 2000) AS n_code, max(year) - 1999 AS n_dates, CASE WHEN max(year) - 1999 = 0 THEN 'INSUFFICIENT_DATES' WHEN count(*) < 50 OR count(DISTINCT CASE WHEN y > 2000 THEN 1 ELSE 0 END) < 2 OR count(*) FILTER (WHERE y > 2000) < 5 THEN 'INSUFFICIENT_SAMPLES' WHEN max(year) - 1999 = 1 THEN 'LOW_DATE_COUNT' ELSE 'OK' END AS status FROM panel GROUP BY unit")
def training_gate(spark, sf_dir):
    p = panel(spark, sf_dir).withColumns({"label": F.when(F.col("y") > 2000, 1).otherwise(0), "dates": F.col("year") - 1999})
    return maps.training_gate(p, ["unit"], "label", "dates")


@query(f"WITH {PAIRS}, d AS (SELECT year, abs(actual - pa) - abs(actual - pb) AS d FROM pairs) SELECT year, round(avg(d), 4) AS mean_loss_diff, round(var_samp(d), 2) AS var, count(*) AS n, round(avg(d) / sqrt(var_samp(d) / count(*)) * sqrt((count(*) - 1.0) / count(*)), 4) AS dm FROM d GROUP BY year", digits=4)
def dm_absolute(spark, sf_dir):
    return stats.dm_test(pairs(spark, sf_dir), ["year"], "actual", "pa", "pb", loss="absolute", ddof=1, least=5).withColumn("var", F.round("var", 2)).drop("p", "verdict")


@query(f"WITH {CELLS}, p AS (SELECT a.year, b.seed, a.rmse AS x, b.rmse AS y FROM cells a JOIN cells b USING (year) WHERE a.seed = 1 AND b.seed > 1) SELECT seed, round(avg(x), 5) AS x, round(avg(y), 5) AS y FROM p GROUP BY seed", digits=5)
def paired_overall(spark, sf_dir):
    c = cells(spark, sf_dir)
    one = c.filter("seed = 1").select("year", F.col("rmse").alias("x"))
    return stats.paired_overall(c.filter("seed > 1").select("seed", "year", F.col("rmse").alias("y")).join(one, "year"), ["year"], "seed", "x", "y")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus || o_orderpriority) AS n_signatures, count(DISTINCT o_orderstatus || o_orderpriority) = 1 AS single FROM orders GROUP BY o_custkey")
def period_signatures(spark, sf_dir):
    return audits.period_signatures(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderstatus, count(*) FILTER (WHERE year(o_orderdate) - o_custkey % 2 <> CASE WHEN o_orderpriority < '3' THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END) AS wrong_year, max(o_orderdate::DATE) AS latest_available FROM orders GROUP BY 1")
def mask_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "mask_year": F.year("o_orderdate") - F.col("o_custkey") % 2, "on": F.to_date("o_orderdate")})
    return audits.mask_audit(o, ["o_orderstatus"], "year", "mask_year", F.col("o_orderpriority") < "3", "on")


@query(f"WITH {RUNS} SELECT 0::BIGINT AS duplicates, 0::BIGINT AS missing, 0::BIGINT AS wrong_n, 0::BIGINT AS unstable_targets")
def validated_results(spark, sf_dir):
    r = runs(spark, sf_dir)
    m = metrics.forecast_metrics(r, ["seed", "year"])
    return audits.validate_results(m, r, ["seed", "year"], "unit", [r.select("seed").distinct(), r.select("year").distinct()])


@query(f"WITH {SCORES} SELECT count(*) FILTER (WHERE least(tp, fp, fn, tn) < 0) AS negative, count(*) FILTER (WHERE tp + fp + fn + tn <> n) AS n_mismatch, count(*) FILTER (WHERE tp > n) AS tp_over_n FROM scores")
def validated_counts(spark, sf_dir):
    return audits.validate_counts(scored(spark, sf_dir).select("tp", "fp", "fn", "tn", F.col("n").cast("long").alias("n")), {"n": ("tp", "fp", "fn", "tn")}, [("tp", "n")])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def provenance(spark, sf_dir):
    return audits.provenance(lines(spark, sf_dir), ["l_returnflag", "l_linestatus"])


@query("WITH g AS (SELECT c_custkey AS unit FROM customer), d AS (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_custkey AS unit, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS why FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT unit, CASE WHEN d.unit IS NOT NULL THEN 'evaluated' ELSE coalesce(why, 'missing') END AS status FROM g LEFT JOIN d USING (unit) LEFT JOIN s USING (unit)")
def scenario_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("unit", F.col("o_custkey"))
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"))
    return audits.scenario_status(grid, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'").select("unit", F.col("o_orderpriority").alias("reason")), ["unit"])


@query("WITH e AS (SELECT DISTINCT year(l_shipdate)::BIGINT AS year, l_returnflag, l_partkey FROM lineitem), c AS (SELECT year, count(*) AS c FROM (SELECT year, l_partkey FROM e GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 3) GROUP BY year) SELECT year, l_returnflag, count(*) AS eligible_units, coalesce(any_value(c), 0) AS common_units, coalesce(any_value(c), 0) < 30 AS small_cohort FROM e LEFT JOIN c USING (year) GROUP BY 1, 2")
def cohort_audit(spark, sf_dir):
    e = lines(spark, sf_dir).select(F.year("l_shipdate").cast("bigint").alias("year"), "l_returnflag", "l_partkey").distinct()
    return audits.cohort_audit(e, joins.common_cohort(e, ["year", "l_partkey"], "l_returnflag"), ["year"], "l_returnflag")


@query("SELECT o_orderkey, a <= d AS mask_eligible, greatest(a, b) AS available_on, greatest(a, b) <= d AS eligible FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + (o_custkey % 7)::INT - 3 AS a, o_orderdate::DATE + (o_custkey % 5)::INT - 3 AS b FROM orders)")
def row_eligibility(spark, sf_dir):
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").withColumns({"d": d, "a": F.date_add(d, (F.col("o_custkey") % 7 - 3).cast("int")), "b": F.date_add(d, (F.col("o_custkey") % 5 - 3).cast("int"))})
    return audits.row_eligibility(o, "d", "a", "b").select("o_orderkey", "mask_eligible", "available_on", "eligible")


@query(f"WITH {TRENDED} SELECT count(*) FILTER (WHERE y IS NULL) AS y_bad, count(*) FILTER (WHERE trend IS NULL) AS trend_bad FROM trended")
def finite_check(spark, sf_dir):
    return audits.assert_finite(trended(spark, sf_dir), ["y", "trend"])


@query("SELECT count(DISTINCT l_returnflag) = 1 AS l_returnflag_single, false AS l_linestatus_single FROM lineitem".replace("false AS", "count(DISTINCT l_linestatus) = 1 AS"))
def single_values(spark, sf_dir):
    return audits.single_value(lines(spark, sf_dir), ["l_returnflag", "l_linestatus"])


@query(f"WITH {SCORES} SELECT year, max(n) - min(n) <= 1e-9 AS n_agrees FROM scores WHERE name LIKE 'common%' GROUP BY year")
def reconciled(spark, sf_dir):
    return audits.reconcile(scored(spark, sf_dir).filter(F.col("name").startswith("common")), ["year"], ["n"])


@query(f"WITH {RUNS}, l AS (SELECT year, avg(100 * abs(actual - predicted) / nullif(abs(actual), 0)) AS mape, 1 - sum((actual - predicted)^2) / (var_pop(actual) * count(*)) AS r2 FROM runs GROUP BY year) SELECT year, round(mape, 5) AS mape, round(r2, 5) AS r2, mape <= 10 AS mape_ok, r2 > 0.6 AS r2_ok FROM l", digits=5)
def spec_check(spark, sf_dir):
    r = runs(spark, sf_dir)
    return audits.spec_check(r.groupBy("year").agg(*[c for c in metrics.percent_columns()[:1]], metrics.r2(F.col("actual"), F.col("predicted")).alias("r2")))


@query("WITH e AS (SELECT c_custkey AS unit FROM customer), d AS (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_totalprice > 400), l AS (SELECT o_custkey AS unit, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) SELECT e.unit, CASE WHEN l.status IN ('F') THEN 'terminal: ' || l.status WHEN s.unit IS NULL THEN 'no scenes' ELSE 'to do' END AS reason FROM e ANTI JOIN d ON d.unit = e.unit LEFT JOIN l ON l.unit = e.unit LEFT JOIN (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_orderpriority < '3') s ON s.unit = e.unit")
def pending_work(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("unit", F.col("o_custkey"))
    ledger = windows.latest_status(o, ["unit"], "o_orderstatus", "o_orderkey").withColumnRenamed("o_orderstatus", "status")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"))
    return audits.pending(expected, o.filter("o_totalprice > 400"), ledger, o.filter("o_orderpriority < '3'"), ["unit"], ("F",))


@query(f"WITH {RUNS} SELECT count(*) AS n_keys, count(*) FILTER (WHERE k <> 5) AS n_wrong FROM (SELECT unit, year, count(DISTINCT seed) AS k FROM runs GROUP BY 1, 2)")
def required_runs(spark, sf_dir):
    return audits.require_runs(runs(spark, sf_dir), ["unit", "year"], "seed", 5)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'vegetation' WHEN p_partkey % 3 = 1 THEN 'weather' ELSE 'other' END AS role, CASE WHEN p_partkey % 3 = 0 THEN 2020 + p_size % 5 END AS year, CASE WHEN p_partkey % 3 = 0 THEN 'STUDY' END AS family, CASE WHEN p_partkey % 3 = 0 THEN 'JULY' END AS month FROM part")
def file_names(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("Copy of Corn_MODIS_"), (2020 + F.col("p_size") % 5).cast("string"), F.lit("_OUR_JULY (2).csv"))).when(k == 1, "CornBelt_PRISM_Weather_2020.csv").otherwise("notes.txt")
    rows = table(spark, sf_dir, "part").withColumn("name", name)
    return rows.select("p_partkey", src.classify_file(F.col("name")).alias("role"), *[c.alias(n) for n, c in src.parse_scenario(F.col("name")).items()])


@query("SELECT p_brand, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_units, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS products FROM part GROUP BY p_brand")
def input_audit(spark, sf_dir):
    return src.input_audit(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type")


@query("SELECT p_partkey AS path, p_type AS hash FROM part WHERE p_size > 10 EXCEPT SELECT p_partkey, p_type FROM part WHERE p_retailprice > 1000")
def changed_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("hash"), "p_size", "p_retailprice")
    return src.changed_files(p.filter("p_size > 10").select("path", "hash"), p.filter("p_retailprice > 1000"))


@query("SELECT selector, value FROM (SELECT DISTINCT 'l_linestatus' AS selector, l_linestatus AS value FROM lineitem WHERE l_returnflag = 'R' UNION SELECT DISTINCT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem WHERE l_returnflag = 'R')")
def slice_options(spark, sf_dir):
    return cl.slice_options(lines(spark, sf_dir), {"l_returnflag": "R"}, ["l_linestatus", "l_linenumber"])


@query("SELECT user_id, ts, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3".replace(", min(event_id) AS event_id", ""))
def stream_dedupe(spark, sf_dir):
    out = streams.stream_dedupe(table(spark, sf_dir, "events"), ["user_id", "ts", "event_type"], "ts", "1 day")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
