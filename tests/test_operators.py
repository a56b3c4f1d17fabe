"""Hand-countable cases and properties."""

import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import cleaning as cl
from panelspark.functions import scalar as sc
from panelspark.operators import audits, joins, maps, metrics, reshape, series, stats, windows
from panelspark.sources import tables


def one(df):
    return df.first().asDict()


def test_ids(spark):
    rows = spark.createDataFrame([("1001.0",), (" 17019 ",), ("00001",), ("17000",), ("abc",), (None,)], "x string")
    assert [r[0] for r in rows.select(cl.clean_fips("x")).collect()] == ["01001", "17019", None, None, None, None]


def test_numbers(spark):
    rows = spark.createDataFrame([("1,234.5",), ("NaN",), ("inf",), ("x",), (None,)], "x string")
    assert [r[0] for r in rows.select(cl.num_us("x")).collect()] == [1234.5, None, None, None, None]


def test_confusion(spark):
    truth, pred = [1, 1, 1, 0, 0, 0, 0, 0], [1, 1, 0, 1, 0, 0, 0, 0]
    pix = spark.createDataFrame([(i, bool(t), bool(p), i != 2) for i, (t, p) in enumerate(zip(truth, pred))], "i int, t boolean, p boolean, v boolean")
    for valid, fn, n in ((F.lit(True), 1, 8), (F.col("v"), 0, 7)):
        c = maps.confusion_counts(pix, [], F.col("t"), F.lit(True), {"m": (F.col("p"), valid)})
        s = one(maps.with_scores(reshape.score_rows(c, [], {"m": ("pair_m_tp", "pair_m_fp", "pair_m_fn", "pair_m_tn")})))
        assert (s["tp"], s["fp"], s["fn"], s["n"]) == (2, 1, fn, n)
    c = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 3, 4), (2, 0, 0, 4), (0, 0, 0, 4), (0, 3, 0, 4), (2, 0, 1, 4)], "tp long, fp long, fn long, tn long")
    got = [(r.f1, r.recall, r.area_bias_pct) for r in maps.with_scores(c).collect()]
    assert [g[0] for g in got] == [None, 0, 1, None, 0, 0.8]
    assert got[3][1] is None and math.isclose(got[5][2], -100 / 3)


def test_interpolation_is_bounded(spark):
    grid = [65, 81, 97, 113, 129]
    rows = spark.createDataFrame([(1, 65, None), (1, 81, 2.0), (1, 113, 4.0), (1, 70, 9.0)], "u int, doy int, v double")
    packed = series.pack(rows, ["u"], grid, ["v"])
    get = lambda **k: one(series.interpolate(packed, ["v"], grid, **k))["v"]
    assert get() == [None, 2, 3, 4, None]
    assert get(edges="clamp") == [2, 2, 3, 4, 4]
    back = series.unpack(packed, ["u"], grid, ["v"]).orderBy("doy").collect()
    assert [(r.doy, r.v) for r in back] == list(zip(grid, [None, 2, None, 4, None]))


def brute_features(days, values):
    """The statistics of one series by numpy."""
    import numpy as np

    d, v = np.array(days, float), np.array([np.nan if x is None or not np.isfinite(x) else x for x in values])
    ok = np.isfinite(v)
    full = np.full(len(v), np.nan)
    if ok.any():
        inside = (d >= d[ok].min()) & (d <= d[ok].max())
        full[inside] = np.interp(d[inside], d[ok], v[ok])
    x, y = d[np.isfinite(full)], full[np.isfinite(full)]
    spring = (x >= 60) & (x <= 120)
    early = full[:3][np.isfinite(full[:3])]
    out = {"mean": y.mean() if len(y) else None, "max": y.max(initial=-np.inf) if len(y) else None, "min": y.min() if len(y) else None, "std": y.std() if len(y) else None, "last": full[-1], "auc": np.trapezoid(y, x) if len(y) > 1 else None}
    out |= {"peak_doy": x[y.argmax()] if len(y) else None, "greenup": np.polyfit(x[spring], y[spring], 1)[0] if spring.sum() > 1 else None, "early_mean": early.mean() if len(early) else None, "last_slope": (full[-1] - full[-2]) / (d[-1] - d[-2])}
    return out | {f"DOY_{int(k)}": w for k, w in zip(days, full)}


def test_season_features_by_folds(spark):
    import numpy as np

    rng, grid = np.random.default_rng(5), list(range(65, 274, 16))
    rows = []
    for unit in range(60):
        for d in grid:
            if rng.random() < 0.1 + 0.8 * (unit % 3 > 0):
                rows.append((unit, d, float(rng.integers(0, 4)), float(rng.choice([np.nan, np.inf, -np.inf, 1.5, 2.5, 7.0])), float(rng.normal())))
    rows += [(0, 66, 5.0, 5.0, 5.0), (99, 270, 1.0, 1.0, 1.0)]  # off the grid
    obs = spark.createDataFrame(rows, "unit int, doy int, a double, b double, c double")
    for cut in (65, 113, 193, 273):
        days = [g for g in grid if g <= cut]
        got = {r.unit: r.asDict() for r in series.build_features(obs, ["unit"], ["a", "b", "a", "c"], grid, cut).collect()}
        assert set(got) == {r[0] for r in rows if r[1] <= cut}
        for unit, r in got.items():
            assert len(r) == 1 + 3 * (10 + len(days))
            if len(days) < 2:
                continue
            for i, v in enumerate("abc"):
                cells = {x[1]: x[2 + i] for x in rows if x[0] == unit}
                for stat, want in brute_features(days, [cells.get(d) for d in days]).items():
                    want = None if want is None or np.isnan(want) else float(want)
                    assert r[f"{v}_{stat}"] == (want if want is None else pytest.approx(want, abs=1e-9)), (unit, v, stat)


def test_season_features_shuffle_once(spark):
    obs = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_partkey AS unit", "dayofyear(l_shipdate) AS doy", *[f"l_quantity AS v{i}" for i in range(7)])
    plan = series.build_features(obs, ["unit"], [f"v{i}" for i in range(7)], list(range(65, 274, 16)), 193)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan


def test_pivot_sums_cells_once(spark):
    """Each cell is averaged once, before the shuffle by keys, and keys take their columns once."""
    obs = spark.createDataFrame([(1, 65, 1.0, 2.0), (1, 65, 2.0, None), (1, 65, 2.0, None), (1, 81, None, 5.0), (1, 70, 9.0, 9.0), (2, 70, 3.0, 4.0), (2, None, 3.0, 4.0), (None, 81, float("nan"), 7.0)], "u int, doy int, v double, w double")
    wide = reshape.pivot_obs(obs, ["u"], [65, 81], ["v", "w"], digits=3)
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 2
    got = {r.u: tuple(r)[1:] for r in wide.collect()}
    assert wide.columns == ["u", "v_DOY_65", "v_DOY_81", "w_DOY_65", "w_DOY_81"]
    assert got[1] == (1.667, None, 2.0, 5.0) and got[2] == (None,) * 4 and got[None][1] != got[None][1] and got[None][3] == 7 and len(got) == 3


def test_unpivot_reads_names_once(spark):
    """Variable and day of a column come from its name in the plan, not row by row; NULL cells stay."""
    from panelspark.plans import registry

    wide = spark.createDataFrame([(1, 2.0, None, 4, "x"), (2, None, 3.0, None, "y")], "u int, a_b_DOY_65 double, a_b_DOY_081 double, c_DOY_65 int, other string")
    long = reshape.unpivot_wide(wide, ["u"])
    assert [(c, t) for c, t in long.dtypes] == [("u", "int"), ("variable", "string"), ("doy", "int"), ("value", "double")]
    assert sorted(map(tuple, long.collect()), key=str) == sorted([(1, "a_b", 65, 2.0), (1, "a_b", 81, None), (1, "c", 65, 4.0), (2, "a_b", 65, None), (2, "a_b", 81, 3.0), (2, "c", 65, None)], key=str)
    plan = registry.QUERIES["unpivot_weather"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("Aggregate ") == 2


def test_unpivot_by_stack_and_pivot_by_variable(spark):
    """All steps of the method: cells are stacked, names are taken apart by regexp_extract, and a day's variables stand side by side again."""
    from panelspark.plans import registry

    def steps(df):
        return df._jdf.queryExecution().analyzed().toString()

    wide = spark.createDataFrame([(1, 2.0, None, 4, "x"), (2, None, 3.0, None, "y"), (2, 5.0, 6.0, 7, "y")], "u int, a_b_DOY_65 double, a_b_DOY_081 double, c_DOY_65 int, other string")
    assert all(x in steps(reshape.unpivot_wide(wide, ["u"])) for x in ("stack(", "regexp_extract("))
    days = reshape.unpivot_weather(wide, ["u"], ["c", "a_b", "d"])
    assert [(c, t) for c, t in days.dtypes] == [("u", "int"), ("doy", "int"), ("c", "double"), ("a_b", "double"), ("d", "double")]
    assert sorted(map(tuple, days.collect()), key=str) == sorted([(1, 65, 4.0, 2.0, None), (1, 81, None, None, None), (2, 65, None, None, None), (2, 81, None, 3.0, None), (2, 65, 7.0, 5.0, None), (2, 81, None, 6.0, None)], key=str)
    plan = steps(registry.QUERIES["unpivot_weather"](spark, "/root/testdata/sf0.001"))
    assert all(x in plan for x in ("stack(14, ", "regexp_extract("))


def test_season_features_by_batches(spark):
    """No element of an array is met by itself; missing values of packed arrays are missing whatever they are."""
    obs = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_partkey AS unit", "dayofyear(l_shipdate) AS doy", "l_quantity AS v")
    days = [65, 81, 97]
    features, filled = series.build_features(obs, ["unit"], ["v"], days, 97), series.interpolate(series.pack(obs, ["unit"], days, ["v"]), ["v"], days)
    assert all("lambda" not in df._jdf.queryExecution().executedPlan().toString() for df in (features, filled))
    nan, inf = float("nan"), float("inf")
    packed = spark.createDataFrame([(1, [1.0, nan, 3.0], "a"), (2, [inf, 2.0], "b"), (3, None, "c"), (4, [1.0, None, 5.0, 9.0], None), (5, [], "e")], "u int, v array<double>, s string")
    got = series.interpolate(packed, ["v"], days, to={"v": "f"}).orderBy("u").collect()
    assert [r.f for r in got] == [[1, 2, 3], [None, 2, None], [None] * 3, [1, 3, 5], [None] * 3] and [r.s for r in got] == ["a", "b", "c", None, "e"]
    assert [r.v for r in series.interpolate(packed, ["v"], days, "clamp").orderBy("u").collect()][:4] == [[1, 2, 3], [2, 2, 2], [None] * 3, [1, 3, 5]]
    got = {r.u: (r.v_mean, r.v_peak_doy, r.v_auc, r.v_DOY_81) for r in series.season_features(packed, ["u"], ["v"], days).collect()}
    assert got == {1: (2, 97, 64, 2), 2: (2, 81, None, 2), 3: (None,) * 4, 4: (3, 97, 96, 3), 5: (None,) * 4}


def test_anomaly_features(spark):
    rows = spark.createDataFrame([(1, 65, 1.0), (1, 97, 3.0), (2, 81, 5.0), (3, 65, None)], "u int, doy int, a double")
    got = {r.u: tuple(r)[1:] for r in series.anomaly_features(rows, ["u"], "a", [65, 81, 97]).collect()}
    assert got == {1: (2.0, 3.0, 1.0, 3.0, 1 / 16), 2: (5.0, 5.0, 5.0, None, None), 3: (None,) * 5}


def test_trend_knows_only_the_past(spark):
    base = [(1, 2000 + i, float(i + 1)) for i in range(3)]
    for last in (4.0, 99.0):
        rows = spark.createDataFrame([*base, (1, 2003, last)], "u int, year int, y double")
        got = {r.year: (r.trend, r.trend_n) for r in windows.causal_trend(rows, ["u"], "year", "y").collect()}
        assert got[2003] == (pytest.approx(4), 3) and got[2002] == (None, 2)


def test_anomaly_and_sums(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, 7.0])], "u int, t int, v double")
    assert [r.anomaly for r in windows.anomalies(rows, ["u"], "t", "v").orderBy("t").collect()] == [None, None, None, None, 4]
    assert [r.s for r in windows.season_cumsum(rows, ["u"], "t", "v", "s").orderBy("t").collect()][:3] == [1, None, 4]


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r.k: r.p_holm for r in windows.holm(rows.withColumn("f", F.lit(1)), "p", ["f"], ["k"]).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == got["c"] == pytest.approx(0.06) and got["d"] is None


def test_trusted_labels(spark):
    cases = {1: [1] * 6, 2: [1, 5] * 3, 3: [5, 1] * 3, 4: [1, 1, 5, 1, 5, 1]}
    rows = spark.createDataFrame([(c, 2016 + i, v) for c, vs in cases.items() for i, v in enumerate(vs)], "cell int, year int, class int")
    assert {r.cell: r.label for r in maps.trusted_labels(rows, ["cell"], "year", "class").collect()} == {1: 1, 2: 1, 3: 5, 4: 0}


def test_paired_tests(spark):
    rows = spark.createDataFrame([(1, float(i), float(i) + (0.5 if i % 2 else -0.25), float(i) + 0.1 * (i % 3)) for i in range(12)], "g int, y double, a double, b double")
    dm1, dm2 = (one(stats.dm_test(rows, ["g"], "y", x, z))["dm"] for x, z in (("a", "b"), ("b", "a")))
    assert dm1 == pytest.approx(-dm2)
    assert one(stats.paired_t(rows.withColumn("c", F.col("a")), ["g"], "a", "c"))["t"] == 0
    w = one(stats.wilcoxon(rows, ["g"], "a", "b"))
    assert w["w_plus"] + w["w_minus"] == w["n"] * (w["n"] + 1) / 2
    p = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0)], "t double, df double").select(stats.t_pvalue("t", "df").alias("p")).collect()
    assert p[0].p == pytest.approx(0.0733880, abs=1e-6) and p[1].p == pytest.approx(1)


def test_signed_rank(spark):
    assert stats.signed_rank_two_sided(0, 5) == pytest.approx(0.0625) and stats.signed_rank_two_sided(8, 10) == pytest.approx(0.048828125)
    rows = spark.createDataFrame([(1, float(i), 0.0) for i in (1, 2, 3, 4, 5)] + [(2, float(i % 3 - 1) * (1 + i % 2), 0.0) for i in range(60)], "g int, a double, b double")
    got = {r.g: r for r in stats.wilcoxon(rows, ["g"], "a", "b").collect()}
    assert got[1].p == pytest.approx(0.0625) and got[2].p == pytest.approx(1.0, abs=0.4)


def test_exact_quantiles(spark):
    import numpy as np

    from panelspark.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=3000), "one": np.array([7.0]), "ties": np.repeat([1.0, 2.0, 9.0], [5, 1, 6]), "wide": np.concatenate([rng.random(500), [1e300, -1e300]])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("normal", None), ("none", None)], "k string, v double")
    got = exact_quantiles(rows, "k", "v", [0.0, 0.25, 0.5, 0.95, 1.0])
    assert set(got) == set(data)
    for k, x in data.items():
        assert got[k] == pytest.approx(np.quantile(x, [0.0, 0.25, 0.5, 0.95, 1.0]).tolist())


def backtest(panel, **more):
    from panelspark.operators import models

    return models.backtest(panel, list(range(1995, 2003)), [113, 193], ["prior", "trend"], "unit", "y", "trend", scenario="scenario", train_scenario="own", maxIter=3, maxDepth=2, **({"least": 5, "least_years": 1} | more))


def test_backtest(spark):
    """Predictions of a year don't change with what comes after it; all scenarios have the same units; a second run gives the same rows."""
    from panelspark.plans import registry

    panel = registry.backtest_panel(spark, "/root/testdata/sf0.001").cache()
    got = backtest(panel).toPandas()
    assert got.year.nunique() > 1 and set(got.doy) == {113, 193}
    cells = got.groupby(["year", "doy", "scenario"]).unit.apply(frozenset).reset_index().groupby(["year", "doy"]).unit
    assert (cells.nunique() == 1).all()
    first = got.year.min()
    later = panel.withColumn("y", F.when(F.col("year") > int(first), F.col("y") * 100).otherwise(F.col("y")))
    key = ["year", "doy", "scenario", "unit"]
    at = lambda df: df[df.year == first].sort_values(key).predicted.round(9).tolist()
    assert at(backtest(later).toPandas()) == at(got)
    assert backtest(panel, least=10**9).count() == 0


def test_sweep_keeps_what_is_there(spark, tmp_path):
    from panelspark.operators import models

    done = []
    job = lambda run: done.append(run) or spark.range(run)
    path = str(tmp_path / "sweep")
    models.sweep(job, [1, 2], path, spark)
    assert models.sweep(job, [1, 2, 3], path, spark).groupBy("run").count().count() == 3 and done == [1, 2, 3]


def test_static_and_survey_files_fail_loudly(spark, tmp_path):
    (tmp_path / "s.csv").write_text("GEOID,AWC\n01001,0.5\n1001,0.7\n")
    with pytest.raises(ValueError, match="repeats"):
        tables.read_static(spark, str(tmp_path / "s.csv"), "GEOID", ["AWC"])
    with pytest.raises(ValueError, match="exactly"):
        tables.read_static(spark, str(tmp_path / "s.csv"), "GEOID", ["AWC", "CEC"])
    from panelspark.functions import cleaning

    with pytest.raises(ValueError, match="SURVEY"):
        cleaning.survey_rows(spark.createDataFrame([("census",)], "program string"))


def streamed(spark, folder, df, job, name, mode):
    df.repartition(3).write.parquet(str(folder))
    q = job(spark.readStream.schema(df.schema).parquet(str(folder))).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_dedupe(spark, tmp_path):
    from panelspark.streaming import streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    job = lambda df: streams.stream_dedupe(df, ["user_id", "event_type", "ts"], "ts", "400 days")
    got = streamed(spark, tmp_path / "in", events.unionAll(events), job, "deduped", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.distinct().collect()))


def test_stream_complete_periods(spark, tmp_path):
    """Only windows with all their days come out, and only when the release lag has passed."""
    from panelspark.streaming import streams

    days = [("a", f"2020-01-0{d} 12:00:00") for d in range(1, 6)] + [("a", "2020-01-02 13:00:00"), ("b", "2020-01-01 01:00:00"), ("b", "2020-01-02 01:00:00"), ("b", "2020-03-01 01:00:00")]
    df = spark.createDataFrame(days, "unit string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    job = lambda x: streams.stream_complete_periods(x, "unit", "ts", "5 days", "3 days", 5)
    want = [(r.unit, r.n_days) for r in job(df).collect()]
    df = df.withColumn("ts", F.col("ts") - F.expr("interval 1 day"))  # epoch days are cut in fives from 1970-01-01
    whole = [(r.unit, r.n_days) for r in job(df).collect()]
    got = [(r.unit, r.n_days) for r in streamed(spark, tmp_path / "in", df, job, "complete", "append").collect()]
    assert all(n == 5 for _, n in want + whole) and set(got) <= set(whole)


def test_metrics_edges(spark):
    rows = spark.createDataFrame([(1, 5.0, 4.0, 5.0), (2, 3.0, 3.0, 3.0), (2, 3.0, 2.0, 3.0)], "g int, actual double, predicted double, trend double")
    assert {r.g: r.r2 for r in metrics.forecast_metrics(rows, ["g"]).collect()} == {1: None, 2: None}


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    with pytest.raises(Exception, match="isn't many_to_one"):
        joins.checked_join(a, a.withColumnRenamed("a", "b"), ["k"], validate="many_to_one").collect()
    assert joins.checked_join(a, a.limit(1).select("k"), ["k"]).count() == 2
    left = spark.createDataFrame([(1, "2020-03-10"), (1, "2020-01-01"), (2, "2020-05-01")], "k int, d string").withColumn("d", F.col("d").cast("date"))
    right = spark.createDataFrame([(1, "2020-03-01", "a"), (1, "2020-03-10", "b"), (2, "2020-01-01", "c")], "k int, w string, v string").withColumn("w", F.col("w").cast("date"))
    got = {(r.k, str(r.d)): r.v for r in joins.asof(left, right, "d", "w", ["k"], ["v"], within=64).collect()}
    assert got == {(1, "2020-03-10"): "b", (1, "2020-01-01"): None, (2, "2020-05-01"): None}


def test_rollup_is_direct(spark):
    pix = spark.range(2000).select((F.col("id") % 7).alias("z"), (F.col("id") % 3 == 0).alias("t"), (F.col("id") % 5 == 0).alias("p"))
    direct = one(maps.confusion_counts(pix, [], F.col("t"), F.lit(True), {"m": (F.col("p"), F.lit(True))}))
    by_zone = maps.confusion_counts(pix, ["z"], F.col("t"), F.lit(True), {"m": (F.col("p"), F.lit(True))})
    assert one(maps.rollup_counts(by_zone, [], list(direct))) == direct


def test_audits(spark):
    counts = spark.createDataFrame([(1, 2, 3, 4, 10, 9), (1, 2, 3, 4, 11, 12)], "tp long, fp long, fn long, tn long, total long, common long")
    got = one(audits.validate_counts(counts, {"total": ("tp", "fp", "fn", "tn")}, [("common", "total")]))
    assert got == {"negative": 0, "total_mismatch": 1, "common_over_total": 1}
    assert one(audits.assert_finite(spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double"), ["x"])) == {"x_bad": 2}


def test_sources(spark, tmp_path):
    for seed in (1, 2):
        d = tmp_path / f"seed_{seed}"
        d.mkdir()
        (d / "m.csv").write_text(" GEOID ,NDVI\n01001,0.5\n01003,x\n")
    obs = tables.read_obs(spark, [str(tmp_path / "seed_1" / "m.csv")], ["GEOID"], ["NDVI", "GCI"]).orderBy("GEOID").collect()
    assert [(r.GEOID, r.NDVI, r.GCI) for r in obs] == [("01001", 0.5, None), ("01003", None, None)]
    assert {r.seed for r in tables.read_runs(spark, str(tmp_path / "*" / "m.csv")).collect()} == {1, 2}
    files = tables.dedupe_files_by_hash(tables.file_hashes(spark, str(tmp_path), "*.csv")).collect()
    assert len(files) == 1 and not files[0].conflict
    names = spark.createDataFrame([("Copy of Corn_MODIS_2023_PUBLISHED_ICDL_JULY (1).csv",), ("Corn_MODIS_2022_PREVIOUS_CDL.csv",)], "n string")
    got = [tuple(r) for r in names.select(*[c.alias(k) for k, c in tables.parse_scenario(F.col("n")).items()]).collect()]
    assert got == [(2023, "CLEAN_REBUILT", "JULY"), (2022, "PREVIOUS_CDL", None)]
    assert tables.read_optional(spark, str(tmp_path / "none.csv"), "a string").count() == 0


def test_headers_without_sorting_lines(spark, tmp_path):
    """The first line of every file, also where a task reads many files, in many batches; no task sorts lines."""
    names = [f"{i:02d}.csv" for i in range(40)]
    for i, n in enumerate(names):
        head = ["u,v", "v,u,w", "w,x"][i % 3]
        (tmp_path / n).write_text("\n".join([head] + ["%d,%d,%d"[: 3 * head.count(",") + 2] % (i, k, 7)[: head.count(",") + 1] for k in range(25_000 if i == 4 else 5)]) + "\n")
    (tmp_path / "none.csv").write_text("")
    paths = [str(tmp_path / n) for n in [*names, names[0], "none.csv"]]
    heads = tables.headers(spark, paths)
    assert "Sort" not in heads._jdf.queryExecution().executedPlan().toString()
    assert {(r.path.split("/")[-1], r.head) for r in heads.collect()} == {(n, ["u,v", "v,u,w", "w,x"][i % 3]) for i, n in enumerate(names)} and heads.count() == 40
    obs = tables.read_obs(spark, paths, ["u"], ["v", "w"])
    assert obs.count() == sum(25_000 if i == 4 else 5 for i in range(40) if i % 3 < 2)
    got = {(r.u, r.v, r.w) for r in obs.filter("u in ('0', '24999') or v = 1").collect()}
    assert ("0", 0, None) in got and ("0", 1, 7) in got and ("24999", 4, 7) in got


def test_stream_equals_batch(spark, tmp_path):
    from panelspark.streaming import streams

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda df: streams.stream_trailing(df, "user_id", "ts", "5 days", "40 days", [F.count("*").alias("n")])
    q = run(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("trailing").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("trailing")) == key(run(src))
