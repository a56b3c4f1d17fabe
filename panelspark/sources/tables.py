"""Readers and writers: CSV with names and types declared, runs from paths, manifests, payloads; all through Spark's own sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.cleaning import clean_fips, fips_from_parts, num, num_us, survey_rows, yield_filter
from panelspark.operators.reshape import union_all

from .shared import there, written


def read_text_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as text, header names trimmed: ids keep their zeros."""
    df = spark.read.csv(paths, header=True, inferSchema=False)
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file that a task reads; its files come one after the other, line by line."""
    last = None
    for batch in batches:
        runs = pc.run_end_encode(batch.column("path"))
        for start, path in zip([0, *runs.run_ends.to_pylist()], runs.values.to_pylist()):
            if path != last:
                yield batch.slice(start, 1)
            last = path


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, head: the first line of each file that has one. Lines pass by in batches; none is sorted or kept."""
    lines = spark.read.text(paths).filter(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("head"))
    return lines.mapInArrow(first_lines, "path string, head string").distinct()


def read_obs(spark: SparkSession, paths: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Files that have the keys, their needed columns, values as numbers; columns that a file lacks are NULL.

    One Spark job reads all headers; files with equal headers are read together.
    """
    frames = []
    for row in headers(spark, paths).groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect():  # a row a header
        df = read_text_csv(spark, row["paths"])
        if set(keys) <= set(df.columns):
            frames.append(df.select(*keys, *[num(c).alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in values]))
    if not frames:
        raise ValueError("no file has the keys")
    return union_all(*frames)


def read_static(spark: SparkSession, path: str, key: str, values: list[str]) -> DataFrame:
    """A static attribute table: the cleaned key and exactly the declared columns as numbers; other columns or a repeated key are errors."""
    df = read_text_csv(spark, [path])
    found = [c for c in df.columns if c != key]
    if sorted(found) != sorted(values):
        raise ValueError(f"{path} must have exactly these columns besides {key}: {values}")
    rows = df.select(clean_fips(key).alias(key), *[num(c).alias(c) for c in values])
    repeated = rows.groupBy(key).count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{path} repeats a {key}")
    return rows


def read_yield(spark: SparkSession, paths: list[str]) -> DataFrame:
    """fips, year, yield from survey tables: county grain yields of whole years, SURVEY rows, duplicates averaged."""
    rows = yield_filter(survey_rows(read_text_csv(spark, paths)))
    rows = rows.select(fips_from_parts("`State ANSI`", "`County ANSI`").alias("fips"), F.col("Year").try_cast("int").alias("year"), num_us("Value").alias("yield"))
    return rows.filter("fips is not null and year is not null and yield is not null").groupBy("fips", "year").agg(F.avg("yield").alias("yield"))


def read_counts(spark: SparkSession, path: str, ids: list[str], counts: list[str]) -> DataFrame:
    """Count tables: ids stay text, counts are whole numbers; what isn't one is NULL."""
    df = read_text_csv(spark, [path])
    whole = lambda c: F.when(num(c) % 1 == 0, num(c).cast("bigint"))
    return df.select(*ids, *[whole(c).alias(c) for c in counts])


def list_files(spark: SparkSession, root: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """path, name, modificationTime, length of files below a root, letters of the pattern in any case; contents aren't read."""
    pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.filter(~F.col("path").contains(exclude)) if exclude else files


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name (normalised: lower case, without a copy's number), hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r" \(\d+\)(?=\.[^.]*$)", ""))
    return files.select("path", "modificationTime", name.alias("name"), F.sha2("content", 256).alias("hash"))


def dedupe_files_by_hash(files: DataFrame) -> DataFrame:
    """One path a name; `conflict` where copies differ."""
    return files.groupBy("name").agg(F.min("path").alias("path"), (F.count_distinct("hash") > 1).alias("conflict"))


def dedupe_files_newest(files: DataFrame) -> DataFrame:
    return files.groupBy("name").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


#: Names under which a mask family occurs in file names.
FAMILIES = {"OUR": "STUDY", "STUDY": "STUDY", "PUBLISHED": "CLEAN_REBUILT", "PUBLISHED_ICDL": "CLEAN_REBUILT", "AUTHORS": "CLEAN_REBUILT", "CLEAN_REBUILT": "CLEAN_REBUILT", "PREVIOUS_CDL": "PREVIOUS_CDL", "FINAL_CDL": "FINAL_CDL"}


def parse_scenario(name: Column) -> dict[str, Column]:
    """year, family, month of a file's name."""
    base = F.regexp_replace(F.upper(name), r"^COPY OF |( \(\d+\))?\.CSV$", "")
    pattern = r"_((?:19|20)\d{2})_([A-Z_]+?)(?:_(JUNE|JULY|AUGUST))?$"
    family = F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.regexp_extract(base, pattern, 2))
    none = lambda c: F.when(c != "", c)
    return {"year": none(F.regexp_extract(base, pattern, 1)).cast("int"), "family": family, "month": none(F.regexp_extract(base, pattern, 3))}


def classify_file(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("modis"), "vegetation").when(n.contains("prism") | n.contains("weather"), "weather").when(n.contains("yield") | n.contains("nass"), "yield").otherwise("other")


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or have another hash than the manifest says."""
    return current.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def with_year(df: DataFrame, name: Column) -> DataFrame:
    """The year of the column, else the last one in the file's name."""
    found = F.element_at(F.regexp_extract_all(name, F.lit(r"(20\d{2})"), 1), -1)
    own = F.col("year").try_cast("int") if "year" in df.columns else F.lit(None).cast("int")
    return df.withColumn("year", F.coalesce(own, found.cast("int")))


def read_runs(spark: SparkSession, glob: str, pattern: str = r"seed_(\d+)", name: str = "seed") -> DataFrame:
    """CSV results of many runs, the run's number taken from the path."""
    df = spark.read.csv(glob, header=True, inferSchema=False)
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int"))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or one without rows if there is none."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, **options: str) -> None:
    w = df.write.mode("overwrite").options(**options)
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def to_payload(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One compact JSON list of records for each group (report-sized)."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *rest)))).alias("payload"))


def write_manifest(spark: SparkSession, values: dict[str, str], path: str) -> None:
    spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values)).write.mode("overwrite").json(path)


def cache_parsed(df: DataFrame, path: str, digest: str) -> DataFrame:
    """Parsed rows kept under their content's digest; read back if they are there."""
    target = f"{path}/hash={digest}"
    try:
        return df.sparkSession.read.parquet(target)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


def staged(spark: SparkSession, root: str, path: str, read: Callable[[list[str]], DataFrame], columns: dict[str, Column], schema: str, pattern: str = "*") -> tuple[DataFrame, int]:
    """The parsed rows of all files below `root`, of which only new and changed ones are read again; and how many files these were.

    read: from paths to rows as they are in the files; columns: what is kept of them, of the types in `schema`. Below `path` the rows lie by their file's fingerprint
    (SHA-256), and every run ends with a new manifest of paths and fingerprints. A manifest counts once it is whole, so a run that breaks off leaves the last
    one in force and is simply run again. Copies of a file are parsed once and count once each; rows of files that are gone stay, but no manifest names them. A
    file without rows is in the manifest. Only the names of changed files pass through the driver, as those of any files to read do.
    """
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    current = written(now.select("path", F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("hash")), "fingerprints")
    versions = sorted(int(v.split("=")[1]) for v in there(spark, f"{path}/manifest"))
    known = spark.read.parquet(f"{path}/manifest/version={versions[-1]}") if versions else current.limit(0)
    fresh = current.groupBy("hash").agg(F.min(F.struct("path", "file")).alias("one")).join(known.select("hash").distinct(), "hash", "left_anti")
    paths = {r["path"]: (r["file"], r["hash"]) for r in fresh.select("one.*", "hash").collect()}
    if paths:
        named = spark.createDataFrame(list(paths.values()), "__path string, hash string")
        rows = read(list(paths)).select(*[c.alias(k) for k, c in columns.items()], F.col("_metadata.file_path").alias("__path"))
        rows.join(named, "__path").drop("__path").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("hash").parquet(f"{path}/rows")
    version = (versions[-1] if versions else 0) + 1
    current.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    if not paths and not versions:
        return spark.createDataFrame([], schema), 0
    kept = spark.read.schema(f"{schema}, hash string").parquet(f"{path}/rows")
    return kept.join(spark.read.parquet(f"{path}/manifest/version={version}").select("hash"), "hash").drop("hash"), len(paths)


def county_names(spark: SparkSession, geojson: str, fallback: DataFrame) -> DataFrame:
    """fips, name: from the features' properties, else from a table of fips and name; the first of several wins."""
    props = spark.read.json(geojson, multiLine=True).select(F.explode("features").alias("f")).select(F.col("f.properties.GEOID").alias("fips"), F.col("f.properties.NAME").alias("name"), F.lit(0).alias("__r"))
    both = props.unionByName(fallback.select("fips", "name", F.lit(1).alias("__r")))
    return both.groupBy("fips").agg(F.min_by("name", "__r").alias("name"))


def prune_inputs(files: DataFrame, test_years: list[int]) -> DataFrame:
    """Same-year maps up to the last test year, other masks only for test years."""
    return files.filter(F.when(F.col("family") == "SAME_YEAR", F.col("year") <= max(test_years)).otherwise(F.col("year").isin(test_years)))


def input_audit(obs: DataFrame, file: str, unit: str, product: str) -> DataFrame:
    return obs.groupBy(file).agg(F.count("*").alias("n_rows"), F.count_distinct(unit).alias("n_units"), F.array_join(F.array_sort(F.collect_set(product)), "|").alias("products"))


def export(df: DataFrame, columns: list[str], by: list[str], path: str) -> None:
    df.select(*columns).repartition(*by).write.mode("overwrite").partitionBy(*by).csv(path, header=True)
