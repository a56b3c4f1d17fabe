"""Zonal statistics and comparison of classified maps, on tables of pixels or of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import confusion_scores, ratio


def trailing_window(daily: DataFrame, keys: list[str], date: str, ends: list[int], days: int, means: list[str], sums: list[str]) -> DataFrame:
    """Means and sums of the days up to each checkpoint, and how many days there were.

    A day goes straight to the checkpoints whose window holds it, so nothing is joined.
    """
    doy = F.dayofyear(date)
    hit = F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: (doy <= e) & (doy > e - days))
    rows = daily.withColumn("year", F.year(date)).withColumn("doy", F.explode(hit))
    return rows.groupBy(*keys, "year", "doy").agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], F.count_distinct(date).alias("n_days"))


def zonal_mean(pix: DataFrame, zones: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Mean and count of each band in every zone: a zone without pixels has a NULL mean and the count 0."""
    found = pix.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands], *[F.count(b).alias(f"{b}_count") for b in bands])
    return zones.select(*keys).distinct().join(found, keys, "left").withColumns({f"{b}_count": F.coalesce(f"{b}_count", F.lit(0)) for b in bands})


def zonal_counts(pix: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    return pix.groupBy(*keys).agg(*[F.count_if(F.col(f)).alias(f) for f in flags])


def median_composite(pix: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    return pix.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands], F.count("*").alias("n_images"))


def complete_only(comp: DataFrame, bands: list[str], found: str, expected: str) -> DataFrame:
    """Bands of composites that miss a period are NULL."""
    ok = F.col(found) == F.col(expected)
    return comp.withColumns({b: F.when(ok, F.col(b)) for b in bands})


def confusion_counts(pix: DataFrame, keys: list[str], truth: Column, truth_valid: Column, masks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """tp, fp, fn, tn of each mask (prediction, valid) on the pairwise domain and on the one that all share, in one aggregate."""
    shared = truth_valid
    for _, valid in masks.values():
        shared = shared & valid
    aggs = [F.count_if(truth_valid).alias("reference_n"), F.count_if(truth_valid & truth).alias("reference_true"), F.count_if(shared).alias("common_n"), F.count_if(shared & truth).alias("common_true")]
    for name, (pred, valid) in masks.items():
        for domain, on in (("pair", truth_valid & valid), ("common", shared)):
            for cell, hit in (("tp", pred & truth), ("fp", pred & ~truth), ("fn", ~pred & truth), ("tn", ~pred & ~truth)):
                aggs.append(F.count_if(on & hit).alias(f"{domain}_{name}_{cell}"))
    return pix.groupBy(*keys).agg(*aggs)


def rollup_counts(counts: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Counts are added up before anything is scored."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def with_scores(rows: DataFrame) -> DataFrame:
    return rows.withColumns(confusion_scores())


def area_skill(scores: DataFrame, by: list[str], mapped: str = "area_km2", reference: str = "reference_km2") -> DataFrame:
    """How well mapped areas follow the reference over zones that have pixels."""
    from .metrics import r2

    a, p = F.col(reference), F.col(mapped)
    return scores.filter("n > 0").groupBy(*by).agg(F.count("*").alias("n_zones"), r2(a, p).alias("skill"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"))


def monthly_area(scores: DataFrame, by: list[str], mask: str = "name") -> DataFrame:
    """Mapped area of each mask on the common domain, and one reference row a period."""
    mapped = scores.groupBy(*by, mask).agg(F.sum("area_km2").alias("area_km2"))
    reference = scores.groupBy(*by, mask).agg(F.sum("reference_km2").alias("r")).groupBy(*by).agg(F.max("r").alias("area_km2")).withColumn(mask, F.lit("REFERENCE"))
    return mapped.unionByName(reference)


def reconcile_area(monthly: DataFrame, scores: DataFrame, by: list[str], mask: str = "name", tolerance: float = 1e-9) -> DataFrame:
    """By period: whether the reference is one and the same for every mask, is there once, and no mapped area is negative or missing."""
    sums = scores.groupBy(*by, mask).agg(F.sum("reference_km2").alias("r"))
    same = sums.groupBy(*by).agg((F.max("r") - F.min("r") <= tolerance).alias("reference_agrees"), F.max("r").alias("__r"))
    rows = monthly.groupBy(*by).agg(F.count_if(F.col(mask) == "REFERENCE").alias("n_reference"), F.count_if(F.coalesce(F.col("area_km2") < 0, F.lit(True))).alias("n_bad_area"), F.max(F.when(F.col(mask) == "REFERENCE", F.col("area_km2"))).alias("__m"))
    out = rows.join(same, by, "left")
    return out.withColumn("reconciled", (F.col("n_reference") == 1) & (F.col("n_bad_area") == 0) & F.coalesce(F.col("reference_agrees"), F.lit(False)) & (F.abs(F.col("__m") - F.col("__r")) <= tolerance)).drop("__m", "__r")


def mosaic(pix: DataFrame, keys: list[str], rank: str, value: str, valid: Column, policy: str = "first") -> DataFrame:
    """One value a cell: of the first (or last) source in order that has one."""
    pick = F.min_by if policy == "first" else F.max_by
    return pix.filter(valid).groupBy(*keys).agg(pick(value, rank).alias(value))


def mosaic_summary(pix: DataFrame, cell: list[str], value: str) -> DataFrame:
    """value, cells, how many of them have sources that disagree."""
    one = pix.groupBy(*cell).agg(F.min(value).alias(value), (F.count_distinct(value) > 1).alias("__c"))
    return one.groupBy(value).agg(F.count("*").alias("n_cells"), F.count_if("__c").alias("n_conflicts"))


def mask_coverage(pix: DataFrame, by: list[str], valid: Column, hit: Column) -> DataFrame:
    out = pix.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(valid & hit).alias("n_class"))
    return out.withColumn("coverage_pct", 100 * ratio("n_valid", "n")).withColumn("class_km2", F.col("n_class") * 0.0009)


def trusted_labels(hist: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The class of a stable cell, the next crop of one that strictly alternates between two (1 and 5), else 0."""
    from .windows import by

    d = hist.withColumn("__p", F.lag(value).over(by(keys, order)))
    one = d.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max_by(value, order).alias("last"), F.count_distinct(value).alias("k"), F.bool_and(F.when(F.col("__p").isNotNull(), F.col("__p") != F.col(value))).alias("alt"))
    two = (F.col("k") == 2) & (F.col("lo") == 1) & (F.col("hi") == 5) & F.col("alt")
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(two, F.when(F.col("last") == 1, 5).otherwise(1)).otherwise(0)
    return one.select(*keys, label.alias("label"))


def training_gate(labels: DataFrame, by: list[str], label: str, dates: str, code: int = 1) -> DataFrame:
    """Whether a tile has enough labelled points and dates, and what is missing if not."""
    g = labels.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_classes"), F.count_if(F.col(label) == code).alias("n_code"), F.max(dates).alias("n_dates"))
    status = F.when(F.col("n_dates") == 0, "INSUFFICIENT_DATES").when((F.col("n") < 50) | (F.col("n_classes") < 2) | (F.col("n_code") < 5), "INSUFFICIENT_SAMPLES").when(F.col("n_dates") == 1, "LOW_DATE_COUNT").otherwise("OK")
    return g.withColumn("status", status)
