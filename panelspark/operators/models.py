"""Model fitting and expanding-year back-tests as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from panelspark.sources.shared import scratch, there, written

from .joins import common_cohort, restrict
from .metrics import train_medians
from .reshape import union_all

#: The canonical parameters: 200 trees of depth 5, rate 0.04, four fifths of rows and columns.
CANONICAL = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.04, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Missing values become the training medians; columns without a median are dropped."""
    gone = [c for c, v in medians.items() if v is None]
    return df.drop(*gone).fillna({c: v for c, v in medians.items() if v is not None})


def medians_of(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """One number a column."""
    return train_medians(train, cols).first().asDict()


def design(df: DataFrame, cols: list[str], to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=to, handleInvalid="error").transform(df)


def feature_matrix(features: DataFrame, env: DataFrame, static: DataFrame, trends: DataFrame, keys: list[str], unit: str, doy: int) -> tuple[DataFrame, list[str]]:
    """Season features, weather at the checkpoint, static attributes, trend and year of every unit and year; and the columns' names in order."""
    from .joins import attach_at, checked_join

    rows = attach_at(features, env, keys, doy)
    rows = checked_join(checked_join(rows, static, [unit]), trends, keys)
    return rows, [c for c in rows.columns if c not in keys] + [k for k in keys if k != unit]


def fit_gbt(train: DataFrame, cols: list[str], label: str, **params):
    return GBTRegressor(featuresCol="features", labelCol=label, **(CANONICAL | params)).fit(design(train, cols))


def predict_yield(model, test: DataFrame, cols: list[str], trend: str) -> DataFrame:
    """The predicted anomaly, with the trend added back."""
    return model.transform(design(test, cols)).withColumn("predicted", F.col("prediction") + F.col(trend)).drop("features", "prediction")


def tree_nodes(model) -> DataFrame:
    """The inner nodes of an ensemble as a table: tree, node, feature (its place), gain (loss reduction summed over the node's rows), n_rows.

    The model is written to the shared folder and its node data are read back, so an ensemble of any size is a table.
    """
    spark = SparkSession.getActiveSession()
    path = scratch(spark, "model")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*").filter("leftChild >= 0")
    return nodes.select("tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"), (F.col("gain") * F.col("rawCount")).alias("gain"), F.col("rawCount").alias("n_rows"))


def importance(spark, model, cols: list[str]) -> DataFrame:
    """feature, group, n_splits, total_gain, share: the loss reduction of all splits on each feature; features that no split uses have 0.

    Without any split all shares are 0.
    """
    from panelspark.functions.scalar import feature_group

    names = spark.createDataFrame(list(enumerate(cols)), "feature int, name string")  # a row a feature
    sums = tree_nodes(model).groupBy("feature").agg(F.count("*").alias("n_splits"), F.sum("gain").alias("total_gain"))
    out = names.join(sums, "feature", "left").fillna({"n_splits": 0, "total_gain": 0.0})
    whole = out.agg(F.sum("total_gain").alias("__all"))
    share = F.coalesce(F.try_divide("total_gain", "__all"), F.lit(0.0))
    return out.crossJoin(F.broadcast(whole)).select(F.col("name").alias("feature"), feature_group("name").alias("group"), "n_splits", "total_gain", share.alias("share"))  # one row


def importance_by_group(gains: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """group, total_gain, share: sums of what `importance` gives, by fit if `keys` name some."""
    return gains.groupBy(*(keys or []), "group").agg(F.sum("total_gain").alias("total_gain"), F.sum("share").alias("share"))


def part_of(model, first: int, last: int):
    """The boosted ensemble of trees first to last - 1 (their own weights): what these trees add to a prediction."""
    gateway, inner = SparkContext._active_spark_context._gateway, model._java_obj
    kind = gateway.jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(kind.DecisionTreeRegressionModel, last - first), gateway.new_array(gateway.jvm.double, last - first)
    for i in range(first, last):
        trees[i - first], weights[i - first] = inner.trees()[i], inner.treeWeights()[i]
    return GBTRegressionModel(kind.GBTRegressionModel(f"{model.uid}_{first}_{last}", trees, weights)).setFeaturesCol(model.getFeaturesCol())


def staged_predictions(model, rows: DataFrame, counts: list[int], trees: str = "trees", to: str = "prediction") -> DataFrame:
    """Predictions after each number of trees, a row each: running sums over one fitted ensemble, whose trees are each evaluated once.

    A boosted ensemble's first k trees are what a fit of k trees with the same seed gives.
    """
    steps = sorted({min(c, model.getNumTrees) for c in counts if c > 0})
    out = rows
    for i, (first, last) in enumerate(zip([0, *steps], steps)):
        out = part_of(model, first, last).setPredictionCol(f"__part_{i}").transform(out)
    sums = [reduce(Column.__add__, [F.col(f"__part_{j}") for j in range(i + 1)]) for i in range(len(steps))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(trees), p.alias(to)) for n, p in zip(steps, sums)]))
    return out.select(*rows.columns, each.alias("__e")).select(*rows.columns, f"__e.{trees}", f"__e.{to}")


def tree_count_sweep(train: DataFrame, test: DataFrame, cols: list[str], label: str, actual: str, trend: str, counts: list[int], **params) -> DataFrame:
    """trees and the scores of the predictions after so many trees: one fit, with as many trees as the largest count."""
    from .metrics import forecast_metrics

    medians = medians_of(train, cols)
    used = [c for c in cols if medians[c] is not None]
    model = fit_gbt(impute(train, medians), used, label, **(params | {"maxIter": max(counts)}))
    staged = staged_predictions(model, design(impute(test, medians), used), counts, to="__p")
    rows = staged.select("trees", F.col(actual).alias("actual"), F.col(trend).alias("trend"), (F.col("__p") + F.col(trend)).alias("predicted"))
    return forecast_metrics(rows, ["trees"], trend="trend")


def backtest(panel: DataFrame, years: list[int], doys: list[int], cols: list[str], unit: str, actual: str, trend: str, scenario: str | None = None, least: int = 20, least_years: int = 3, train_scenario: str | None = None, **params) -> DataFrame:
    """For each year and checkpoint: one fit on the years before, predictions for every scenario on the units that all have.

    The driver loops over cells (a few dozen), never over rows; each fit is a distributed job. One grouped audit tells which cells have
    training data of `least` rows and `least_years` years; the others are left out, and without any cell the result has no rows.
    With scenarios the fit uses the rows of `train_scenario` (all where that is None).
    """
    out = []
    known = panel.filter(F.col(actual).isNotNull() & F.col(trend).isNotNull())
    learn = known.filter(F.col(scenario) == train_scenario) if scenario and train_scenario is not None else known
    sizes = {(r["year"], r["doy"]): r["count"] for r in learn.groupBy("year", "doy").count().collect()}  # a row a cell
    for year in years:
        for doy in doys:
            earlier = [n for (y, d), n in sizes.items() if y < year and d == doy]
            if sum(earlier) < least or len(earlier) < least_years:
                continue
            train = learn.filter((F.col("doy") == doy) & (F.col("year") < year))
            test = known.filter((F.col("doy") == doy) & (F.col("year") == year))
            if scenario:
                test = restrict(test, common_cohort(test, [unit], scenario), [unit])
            medians = medians_of(train, cols)
            used = [c for c in cols if medians[c] is not None]
            train = impute(train, medians).withColumn("__y", F.col(actual) - F.col(trend))
            model = fit_gbt(train, used, "__y", **params)
            pred = predict_yield(model, impute(test, medians), used, trend)
            out.append(pred.select(unit, "year", "doy", *([scenario] if scenario else []), F.col(actual).alias("actual"), F.col(trend).alias("trend"), "predicted"))
    if not out:
        kinds = {f.name: f.dataType for f in panel.schema}
        keys = [F.lit(None).cast(kinds[c]).alias(c) for c in (unit, "year", "doy", *([scenario] if scenario else []))]
        return panel.limit(0).select(*keys, *[F.lit(None).cast("double").alias(c) for c in ("actual", "trend", "predicted")])
    return union_all(*out)


def sweep(job: Callable[[int], DataFrame], runs: list[int], path: str, spark, name: str = "run") -> DataFrame:
    """Runs that aren't there yet, or didn't end, are written to their own partition; gives all of them."""
    have = there(spark, path)
    for r in runs:
        if f"{name}={r}" not in have:
            job(r).write.mode("overwrite").parquet(f"{path}/{name}={r}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/{name}={r}" for r in runs])


def classify_pixels(pix: DataFrame, labelled: DataFrame, cols: list[str], label: str, code: int, trees: int = 100, seed: int = 42) -> DataFrame:
    """A forest on time-stacked bands, its classes then reduced to one against the rest. Missing bands become the training medians."""
    medians = medians_of(labelled, cols)
    used = [c for c in cols if medians[c] is not None]
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, featureSubsetStrategy="sqrt", seed=seed).fit(design(impute(labelled, medians), used))
    out = model.transform(design(impute(pix, medians), used))
    return out.withColumn("is_class", F.col("prediction") == code).withColumn("confidence", F.array_max(vector_to_array("probability"))).select(*pix.columns, "is_class", "confidence")


def training_points(pix: DataFrame, tile: str, label: str, key: str, per_class: int = 1000, seed: int = 42) -> DataFrame:
    """Up to `per_class` labelled pixels of each tile and class, by a seeded hash of the key."""
    w = Window.partitionBy(tile, label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary")), key)
    return pix.filter(F.col(label).isNotNull()).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_class).drop("__r")


def cell_status(points: DataFrame, dates: DataFrame, tile: str, label: str, checkpoints: dict[str, str], code: int = 1) -> DataFrame:
    """tile, checkpoint, n_dates, n, n_classes, n_code, status of every tile and checkpoint.

    points: the training points; dates: tile, date of every scene. checkpoints: name and last day. A tile without scenes by a checkpoint is
    INSUFFICIENT_DATES, then one with fewer than 50 points, two classes or 5 points of the class INSUFFICIENT_SAMPLES; one scene gives LOW_DATE_COUNT, else TRAINED.
    """
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("checkpoint"), F.lit(v).cast("date").alias("cut")) for k, v in checkpoints.items()]))
    seen = dates.select(tile, "date").distinct().groupBy(tile).agg(F.sort_array(F.collect_list("date")).alias("__dates"))  # a year's scenes
    n = points.groupBy(tile).agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_classes"), F.count_if(F.col(label) == code).alias("n_code"))
    cells = n.join(seen, tile, "full").withColumn("__c", cuts).select(tile, "__c.checkpoint", F.coalesce(F.size(F.filter("__dates", lambda d: d <= F.col("__c.cut"))), F.lit(0)).alias("n_dates"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_classes", "n_code")])
    few = (F.col("n") < 50) | (F.col("n_classes") < 2) | (F.col("n_code") < 5)
    return cells.withColumn("status", F.when(F.col("n_dates") == 0, "INSUFFICIENT_DATES").when(few, "INSUFFICIENT_SAMPLES").when(F.col("n_dates") == 1, "LOW_DATE_COUNT").otherwise("TRAINED"))


def classify_cells(pix: DataFrame, points: DataFrame, status: DataFrame, tile: str, label: str, bands: Callable[[str, str], list[str]], path: str, code: int = 1, at_once: int = 4, **forest) -> DataFrame:
    """Every pixel of every tile and checkpoint that can be trained, by that cell's own forest: the pixels' columns, checkpoint, is_class, confidence.

    bands: the columns known for a tile by a checkpoint. Fits are bounded by their points and run a few at a time as separate jobs; each cell is written to its own
    partition of `path`, and one that is there already isn't computed again. The driver holds a row a cell.
    """
    spark = pix.sparkSession
    cells = [(r[tile], r["checkpoint"]) for r in status.filter(F.col("status").isin("TRAINED", "LOW_DATE_COUNT")).select(tile, "checkpoint").orderBy(tile, "checkpoint").collect()]
    schema = StructType([*pix.schema.fields, StructField("checkpoint", StringType()), StructField("is_class", BooleanType()), StructField("confidence", DoubleType())])
    points, have = written(points, "training-points"), there(spark, path)
    where = {cell: f"cell={i}" for i, cell in enumerate(cells)}

    @inheritable_thread_target(spark)
    def run(cell: tuple) -> None:
        here = F.col(tile) == cell[0]
        out = classify_pixels(pix.filter(here), points.filter(here), bands(*cell), label, code, **forest)
        out.withColumn("checkpoint", F.lit(cell[1])).select(schema.fieldNames()).write.mode("overwrite").parquet(f"{path}/{where[cell]}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(run, [c for c in cells if where[c] not in have]))
    return spark.read.schema(schema).parquet(*[f"{path}/{where[c]}" for c in cells]) if cells else spark.createDataFrame([], schema)
