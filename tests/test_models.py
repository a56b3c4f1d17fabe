"""Total gain, predictions by numbers of trees, and forests by tile and checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators import models

SMALL = {"maxDepth": 3, "stepSize": 0.3}


@pytest.fixture(scope="module")
def rows(spark):
    cols = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("AWC"), (F.col("id") % 11).cast("double").alias("NDVI_mean"), F.lit(2.0).alias("hist_yield_trend"))
    return cols.withColumn("y", F.col("AWC") * 3 + F.when(F.col("NDVI_mean") > 5, 4.0).otherwise(0.0)).coalesce(1).cache()


COLS = ["AWC", "NDVI_mean", "hist_yield_trend"]


def test_total_gain_of_one_split(spark):
    """A tree of one split, by hand: the loss it saves is the between-group sum of squares."""
    data = spark.createDataFrame([(0.0, 5.0, 1.0), (0.0, 6.0, 1.0), (1.0, 5.0, 9.0), (1.0, 6.0, 11.0)], "a double, b double, y double").coalesce(1)
    model = models.fit_gbt(data, ["a", "b"], "y", maxIter=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all")
    got = {r.feature: r for r in models.importance(spark, model, ["a", "b"]).collect()}
    assert got["a"].total_gain == pytest.approx(4 * (10 - 5.5) ** 2) and got["a"].n_splits == 1 and got["a"].share == 1
    assert got["b"].total_gain == got["b"].share == got["b"].n_splits == 0


def test_gains_by_group(spark, rows):
    model = models.fit_gbt(rows, COLS, "y", maxIter=6, **SMALL)
    gains = models.importance(spark, model, COLS)
    got = {r.feature: r for r in gains.collect()}
    assert sum(r.share for r in got.values()) == pytest.approx(1) and got["hist_yield_trend"].total_gain == 0
    assert sum(r.n_splits for r in got.values()) == models.tree_nodes(model).count()
    groups = {r.group: r.share for r in models.importance_by_group(gains).collect()}
    assert len(groups) == 3 and sum(groups.values()) == pytest.approx(1)
    stump = models.fit_gbt(rows.withColumn("y", F.lit(1.0)), COLS, "y", maxIter=1, maxDepth=1)
    assert [r.share for r in models.importance(spark, stump, COLS).collect()] == [0.0] * 3


def test_staged_predictions_equal_separate_fits(rows):
    model = models.fit_gbt(rows, COLS, "y", maxIter=9, **SMALL)
    x = models.design(rows, COLS)
    staged = models.staged_predictions(model, x, [2, 5, 9, 50]).select("id", "trees", "prediction").collect()
    got = {(r.trees, r.id): r.prediction for r in staged}
    assert len(staged) == len(got) == 3 * 120
    for k in (2, 5, 9):
        alone = models.fit_gbt(rows, COLS, "y", maxIter=k, **SMALL).transform(x).select("id", "prediction").collect()
        assert all(got[k, r.id] == pytest.approx(r.prediction, abs=1e-12) for r in alone)


def test_tree_count_sweep(rows):
    sweep = models.tree_count_sweep(rows.withColumn("trend", F.lit(0.0)), rows.withColumn("trend", F.lit(0.0)), COLS, "y", "y", "trend", [1, 4, 8], **SMALL)
    got = {r.trees: r.rmse for r in sweep.collect()}
    assert set(got) == {1, 4, 8} and got[1] > got[4] > got[8]


def test_sweep_asks_the_file_system(spark, tmp_path):
    done = []

    def job(r):
        done.append(r)
        return spark.createDataFrame([(r * 10,)], "v int")

    path = f"file://{tmp_path}/runs"
    models.sweep(job, [1, 2], path, spark)
    (tmp_path / "runs" / "run=3").mkdir()  # a run that didn't end
    assert {(r.run, r.v) for r in models.sweep(job, [1, 2, 3], path, spark).collect()} == {(1, 10), (2, 20), (3, 30)}
    assert done == [1, 2, 3]


def test_forests_by_cell(spark, tmp_path):
    day = lambda m: dt.date(2022, m, 1)
    pix = [(t, i, float(i % 10), float(i % 3), (1 if i % 10 > 4 else 5) if i % 2 else None) for t in "abcd" for i in range(20 if t == "c" else 200)]
    pix += [("e", i, float(i), 0.0, 1) for i in range(80)] + [("f", i, float(i), None, 5 if i > 2 else 1) for i in range(80)]
    df = spark.createDataFrame(pix, "tile string, cell long, b1 double, b2 double, label int")
    dates = spark.createDataFrame([(t, day(m)) for t in "abcef" for m in (5, 7, 8)] + [("d", day(8)), ("g", day(5))], "tile string, date date")
    points = models.training_points(df, "tile", "label", "cell", per_class=60)
    assert max(r["count"] for r in points.groupBy("tile", "label").count().collect()) == 60
    status = models.cell_status(points, dates, "tile", "label", {"June": "2022-06-30", "August": "2022-08-31"})
    got = {(r.tile, r.checkpoint): (r.n_dates, r.status) for r in status.collect()}
    assert got["a", "June"] == (1, "LOW_DATE_COUNT") and got["a", "August"] == (3, "TRAINED")
    assert got["d", "June"] == (0, "INSUFFICIENT_DATES") and got["d", "August"] == (1, "LOW_DATE_COUNT")
    assert {got[t, "August"][1] for t in "cefg"} == {"INSUFFICIENT_SAMPLES"} and len(got) == 14
    path = f"file://{tmp_path}/cells"
    run = lambda: models.classify_cells(df, points, status, "tile", "label", lambda t, c: ["b1", "b2"], path, trees=5)
    out = run().collect()
    cells = {(r.tile, r.checkpoint) for r in out}
    assert cells == {("a", "June"), ("a", "August"), ("b", "June"), ("b", "August"), ("d", "August")} and len(out) == 5 * 200
    assert all(r.is_class == (r.b1 > 4) for r in out)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert run().count() == 1000 and before == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}  # nothing is computed again
    none = models.classify_cells(df, points, status.limit(0), "tile", "label", lambda t, c: [], path)
    assert none.count() == 0 and none.columns == [*df.columns, "checkpoint", "is_class", "confidence"]


def test_newest_copy_wins(spark):
    """Of files of one name the newest; of equally old ones the last path."""
    from panelspark.sources import tables

    t = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a.csv", "x/a.csv", t), ("a.csv", "y/a.csv", t + dt.timedelta(1)), ("b.csv", "x/b.csv", t), ("b.csv", "z/b.csv", t)], "name string, path string, modificationTime timestamp")
    assert {tuple(r) for r in tables.dedupe_files_newest(files).select("name", "path").collect()} == {("a.csv", "y/a.csv"), ("b.csv", "z/b.csv")}
    assert tables.dedupe_files_newest(files.limit(0)).count() == 0


def test_shares_of_an_array(spark):
    """Each place of an array is a row under its feature's name; empty and missing arrays give none."""
    from panelspark.operators import reshape

    rows = spark.createDataFrame([(1, [0.25, 0.75]), (2, []), (3, None), (4, [1.0, None])], "fit int, shares array<double>")
    got = {(r.fit, r.feature): r.share for r in reshape.long_importance(rows, ["fit"], ["a", "b"], "shares").collect()}
    assert got == {(1, "a"): 0.25, (1, "b"): 0.75, (4, "a"): 1.0, (4, "b"): None}
