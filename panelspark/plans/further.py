"""Queries on files that Spark writes from the driver's tables and reads back, on model inputs, validation rules and test summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import cleaning as cl
from panelspark.functions import scalar as sc
from panelspark.operators import audits, joins, maps, metrics, models, reshape, series, stats, windows
from panelspark.sources import tables as src
from panelspark.sources.shared import scratch
from panelspark.streaming import streams

from .bindings import RUNS, SEASON, TRENDED, runs, season, table, trended
from .registry import BOOTSTRAP, CELLS, GAINS, GRID, PAIRS, SCORES, cells, pairs, query, scored, shares


def as_csv(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.csv(path, header=True)
    return path


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


# files


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, lpad(o_custkey::VARCHAR, 9, '0') AS id, o_orderstatus FROM orders")
def text_csv(spark, sf_dir):
    """Ids in CSV keep their zeros; names are trimmed."""
    path = as_csv(orders(spark, sf_dir).select(F.col("o_orderkey").alias(" o_orderkey "), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("id"), "o_orderstatus"), "text")
    return src.read_text_csv(spark, [path])


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_quantity, CASE WHEN l_returnflag = 'A' THEN l_tax END AS l_tax FROM lineitem WHERE l_returnflag <> 'N'")
def observation_files(spark, sf_dir):
    """Files with different headers; those without the keys are left out."""
    li = table(spark, sf_dir, "lineitem")
    part = lambda flag, *cols: as_csv(li.filter(F.col("l_returnflag") == flag).select(*cols), f"obs-{flag}")
    paths = [part("R", "l_orderkey", "l_linenumber", "l_quantity"), part("A", "l_tax", "l_orderkey", "l_linenumber", "l_quantity"), part("N", "l_orderkey", "l_tax")]
    return src.read_obs(spark, paths, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("SELECT (10001 + 1000 * (s_suppkey // 998) + s_suppkey % 998)::VARCHAR AS fips, s_nationkey::DOUBLE AS nation, round(s_acctbal, 6) AS balance FROM supplier")
def static_table(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((10001 + 1000 * F.floor(F.col("s_suppkey") / 998) + F.col("s_suppkey") % 998).cast("bigint").alias("fips"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return src.read_static(spark, as_csv(s, "static"), "fips", ["nation", "balance"])


@query("SELECT lpad(s::VARCHAR, 2, '0') || lpad(c::VARCHAR, 3, '0') AS fips, y::BIGINT AS year, round(avg(p), 6) AS yield FROM (SELECT o_custkey % 60 AS s, o_orderkey % 1100 AS c, year(o_orderdate) AS y, round(o_totalprice, 2) AS p FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority < '4') WHERE s BETWEEN 1 AND 56 AND c BETWEEN 1 AND 998 GROUP BY 1, 2")
def yield_table(spark, sf_dir):
    """Yields in the layout of the survey's tables, with thousands separators."""
    o = orders(spark, sf_dir)
    fixed = {"Commodity": "corn", "Period": "YEAR", "Domain": "TOTAL", "Data Item": "CORN, GRAIN - YIELD, MEASURED IN BU / ACRE", "County": "SOME"}
    rows = o.select(
        F.when(F.col("o_orderstatus") == "F", "CENSUS").otherwise("SURVEY").alias("Program"),
        F.when(F.col("o_orderpriority") < "4", "COUNTY").otherwise("STATE").alias("Geo Level"),
        *[F.lit(v).alias(k) for k, v in fixed.items()],
        (F.col("o_custkey") % 60).alias("State ANSI"),
        (F.col("o_orderkey") % 1100).alias("County ANSI"),
        F.year("o_orderdate").alias("Year"),
        F.format_number(F.round("o_totalprice", 2), 2).alias("Value"),
    )
    return src.read_yield(spark, [as_csv(rows, "yield")])


@query("SELECT lpad(l_suppkey::VARCHAR, 5, '0') AS fips, l_returnflag AS mask, count(*)::BIGINT AS n, CASE WHEN l_returnflag <> 'N' THEN count(*) FILTER (WHERE l_tax > 0.04)::BIGINT END AS hit FROM lineitem GROUP BY 1, 2")
def count_tables(spark, sf_dir):
    """Counts as whole numbers; what isn't one is NULL."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.04).alias("hit"))
    hit = F.when(F.col("l_returnflag") == "N", F.lit("1.5")).otherwise(F.col("hit").cast("string"))
    path = as_csv(li.select(F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("fips"), F.col("l_returnflag").alias("mask"), "n", hit.alias("hit")), "counts")
    return src.read_counts(spark, path, ["fips", "mask"], ["n", "hit"])


def copied(spark, sf_dir) -> str:
    """Two equal files for each return flag."""
    root = scratch(spark, "copies")
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions("l_returnflag", "l_linestatus")
    for copy in ("one", "two"):
        li.write.partitionBy("l_returnflag").csv(f"{root}/{copy}")
    return root


@query("SELECT DISTINCT l_returnflag, 2::BIGINT AS n_files FROM lineitem")
def listed_files(spark, sf_dir):
    """Files found below a root, by a pattern in other letters' case."""
    files = src.list_files(spark, copied(spark, sf_dir), "PART-*.CSV", exclude="_temporary")
    return files.groupBy(F.regexp_extract("path", "l_returnflag=(.)", 1).alias("l_returnflag")).agg(F.count("*").alias("n_files"))


@query("SELECT DISTINCT l_returnflag, 2::BIGINT AS n_files, 1::BIGINT AS n_hashes, false AS conflict FROM lineitem")
def hashed_files(spark, sf_dir):
    """Copies have one hash."""
    files = src.file_hashes(spark, copied(spark, sf_dir), "part-*").withColumn("name", F.regexp_extract("path", "l_returnflag=(.)", 1))
    n = files.groupBy("name").agg(F.count("*").alias("n_files"), F.count_distinct("hash").alias("n_hashes"))
    return n.join(src.dedupe_files_by_hash(files).select("name", "conflict"), "name").withColumnRenamed("name", "l_returnflag")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size ELSE 2000 + p_size END AS year FROM part")
def years_of_files(spark, sf_dir):
    """The column's year, else the last one in the file's name."""
    p = table(spark, sf_dir, "part").withColumns({"year": F.when(F.col("p_partkey") % 2 == 0, (1990 + F.col("p_size")).cast("string")).otherwise("n/a"), "name": F.concat(F.lit("Corn_2012_v2_"), (2000 + F.col("p_size")).cast("string"), F.lit(".csv"))})
    return src.with_year(p, F.col("name")).select("p_partkey", "year")


@query(f"WITH {RUNS} SELECT seed, unit::VARCHAR AS unit, year::VARCHAR AS year FROM runs WHERE seed <= 3")
def runs_from_paths(spark, sf_dir):
    """The run's number comes from the path."""
    root, r = scratch(spark, "runs"), runs(spark, sf_dir).filter("seed <= 3")
    for seed in (1, 2, 3):
        r.filter(F.col("seed") == seed).select("unit", "year").write.csv(f"{root}/seed_{seed}", header=True)
    return src.read_runs(spark, f"{root}/seed_*")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def optional_table(spark, sf_dir):
    """A table that is there, and one that isn't."""
    path, schema = as_csv(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "optional"), "o_orderkey bigint, o_orderstatus string"
    return reshape.union_all(src.read_optional(spark, path, schema), src.read_optional(spark, path + "-absent", schema))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders")
def written_tables(spark, sf_dir):
    """Written by status and read back."""
    path = scratch(spark, "written")
    src.write_table(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice"), path, by=["o_orderstatus"], compression="zstd")
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)


@query("SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS payload FROM nation GROUP BY 1")
def payloads(spark, sf_dir):
    return src.to_payload(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], ["n_nationkey"])


@query("SELECT count(*)::VARCHAR AS n_orders, max(o_orderkey)::VARCHAR AS last FROM orders")
def manifest(spark, sf_dir):
    path, r = scratch(spark, "manifest"), orders(spark, sf_dir).agg(F.count("*"), F.max("o_orderkey")).first()
    src.write_manifest(spark, {"n_orders": str(r[0]), "last": str(r[1])}, path)
    return spark.read.schema("n_orders string, last string").json(path)


@query("SELECT n_nationkey, n_name FROM nation")
def parsed_once(spark, sf_dir):
    """Parsed rows kept by digest: the second call reads what the first has written."""
    path, n = scratch(spark, "parsed"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    src.cache_parsed(n, path, "d1")
    return src.cache_parsed(n.limit(0), path, "d1")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS price, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS first_read, 2::BIGINT AS then_read FROM orders WHERE o_orderstatus <> 'P'")
def staged_inputs(spark, sf_dir):
    """Files by status: after the first run one changes and one is emptied; the second run reads these two alone."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderstatus")
    root, path = scratch(spark, "inputs"), scratch(spark, "staged")
    put = lambda df, status: df.filter(F.col("o_orderstatus") == status).drop("o_orderstatus").coalesce(1).write.mode("overwrite").csv(f"{root}/{status}", header=True)
    for status in [r[0] for r in o.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]:
        put(o, status)
    columns = {"o_orderkey": F.col("o_orderkey").cast("long"), "price": F.col("o_totalprice").cast("double")}
    run = lambda: src.staged(spark, root, path, lambda paths: spark.read.csv(paths, header=True), columns, "o_orderkey long, price double", "*.csv")
    _, first = run()
    put(o.withColumn("o_totalprice", -F.col("o_totalprice")), "F")
    put(o.limit(0), "P")
    rows, then = run()
    return rows.withColumns({"first_read": F.lit(first).cast("long"), "then_read": F.lit(then).cast("long")})


@query("SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS fips, CASE WHEN n_nationkey % 2 = 0 THEN 'map ' || n_name ELSE n_name END AS name FROM nation")
def names_of_units(spark, sf_dir):
    """Names from a map's features, else from a table."""
    n = table(spark, sf_dir, "nation").withColumn("fips", F.lpad(F.col("n_nationkey").cast("string"), 5, "0"))
    features = F.collect_list(F.struct(F.struct(F.col("fips").alias("GEOID"), F.concat(F.lit("map "), "n_name").alias("NAME")).alias("properties"))).alias("features")
    path = scratch(spark, "features")
    n.filter("n_nationkey % 2 = 0").agg(features).coalesce(1).write.json(path)
    return src.county_names(spark, path, n.select("fips", F.col("n_name").alias("name")))


@query("SELECT p_partkey, 1990 + p_size AS year FROM part WHERE CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size <= 2015 ELSE 1990 + p_size IN (2010, 2015) END")
def pruned_inputs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (1990 + F.col("p_size")).alias("year"), F.when(F.col("p_partkey") % 2 == 0, "SAME_YEAR").otherwise("OTHER").alias("family"))
    return src.prune_inputs(p, [2010, 2015]).select("p_partkey", "year")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def exported(spark, sf_dir):
    path = scratch(spark, "export")
    src.export(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_nationkey"], ["s_nationkey"], path)
    return spark.read.schema("s_suppkey bigint, s_nationkey bigint").csv(path, header=True)


# cleaning and selection


@query("SELECT lpad(o_custkey::VARCHAR, 5, '0') AS fips, count(*) AS n FROM orders WHERE length(o_custkey::VARCHAR) <= 5 AND lpad(o_custkey::VARCHAR, 5, '0') NOT LIKE '00%' AND lpad(o_custkey::VARCHAR, 5, '0') NOT LIKE '%000' GROUP BY 1")
def good_ids(spark, sf_dir):
    rows = cl.drop_bad_fips(orders(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("fips")), "fips", f"bad-{uuid.uuid4().hex}")
    return rows.groupBy("fips").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN o_orderdate::TIMESTAMP WHEN 1 THEN o_orderdate::TIMESTAMP - INTERVAL 5 HOUR END AS at FROM orders")
def utc_times(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_custkey") % 3 == 0, F.concat(day, F.lit("T00:00:00Z"))).when(F.col("o_custkey") % 3 == 1, F.concat(day, F.lit("T00:00:00+05:00"))).otherwise("soon")
    return orders(spark, sf_dir).select("o_orderkey", cl.utc_naive(text).alias("at"))


@query("SELECT l_suppkey AS unit, round(avg(l_quantity), 6) AS \"NDVI_DOY_065\", round(avg(l_tax), 6) AS \"NDVI_DOY_081\", round(avg(l_discount), 6) AS found FROM lineitem GROUP BY 1")
def named_columns(spark, sf_dir):
    """Vendors' names under our own, the columns up to a day, and one found in any case."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg("l_quantity").alias("vendor_a"), F.avg("l_tax").alias("NDVI_DOY_081"), F.avg("l_discount").alias("evi_doy_65"), F.max("l_tax").alias("NDVI_DOY_273"))
    rows = cl.apply_aliases(li, {"vendor_a": "NDVI_DOY_065", "absent": "x", "unit": "NDVI_DOY_081"})
    return rows.select("unit", *cl.cols_upto(rows, "NDVI", 193), F.col(cl.find_col(rows, "EVI", 65)).alias("found"))


@query(f"WITH {TRENDED} SELECT unit, year, round(y, 4) AS y, trend_n, round(trend, 4) AS trend FROM trended WHERE y IS NOT NULL AND trend IS NOT NULL AND trend_n % 2 = 0", digits=4)
def model_rows(spark, sf_dir):
    """Rows with target and trend, numeric columns alone, codes that stand for no data left out."""
    rows = cl.filter_model_rows(trended(spark, sf_dir), "y", "trend").withColumn("code", F.col("trend_n") % 2).withColumn("name", F.lit("text"))
    rows = cl.drop_nodata(rows, [1], "code")
    return rows.select(cl.feature_cols(rows, ("code", "trend_slope", "trend_intercept", "trend_first", "trend_last")))


@query("SELECT count(*) FILTER (WHERE l_tax <= 0) AS not_positive FROM lineitem")
def positive_values(spark, sf_dir):
    return cl.require_positive(table(spark, sf_dir, "lineitem"), "l_tax")


@query("SELECT l_orderkey AS key, count(*) FILTER (WHERE l_linenumber = 1) AS ones, count(*) FILTER (WHERE y < 1997) AS before, count(*) FILTER (WHERE y = 1997) AS tested FROM (SELECT *, year(l_shipdate) AS y FROM lineitem) GROUP BY 1")
def split_by_time(spark, sf_dir):
    """A class against the rest, columns under new names, and rows before a year beside those of it."""
    rows = cl.select_as(table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")), {"l_orderkey": "key", "l_linenumber": "class", "y": "year"})
    rows = cl.binarize(rows, 1)
    before, tested = cl.time_split(rows, 1997)
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    out = rows.groupBy("key").agg(F.count_if("is_class").alias("ones")).join(count(before, "before"), "key", "left").join(count(tested, "tested"), "key", "left")
    return out.fillna(0)


@query(f"WITH {TRENDED}, {SEASON}, seen AS (SELECT DISTINCT unit, year FROM season WHERE doy <= 193), felt AS (SELECT DISTINCT l_partkey AS unit, year(l_shipdate)::BIGINT AS year FROM lineitem WHERE l_tax > 0.02) SELECT unit, year FROM trended JOIN seen USING (unit, year) JOIN felt USING (unit, year) WHERE y IS NOT NULL AND trend IS NOT NULL")
def eligible_rows(spark, sf_dir):
    obs = season(spark, sf_dir, GRID).withColumn("other", F.lit(None).cast("double"))
    weather = table(spark, sf_dir, "lineitem").filter("l_tax > 0.02").select(F.col("l_partkey").alias("unit"), F.year("l_shipdate").cast("bigint").alias("year"), F.lit(193).alias("doy"), F.col("l_tax").alias("rain"))
    return cl.eligible_rows(trended(spark, sf_dir), obs, weather, ["unit", "year"], 193, ["value", "other"], ["rain"], ["y", "trend"]).select("unit", "year")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'returned' ELSE 'accepted' END AS label FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F'")
def scenario_slice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    labels = li.select("l_returnflag").distinct().filter("l_returnflag <> 'N'").withColumn("label", F.when(F.col("l_returnflag") == "R", "returned").otherwise("accepted"))
    rows = cl.known_scenarios(li, labels, ["l_returnflag"])
    both = [cl.scenario(rows, f, "F", "l_returnflag", "l_linestatus") for f in ("R", "A")]
    return reshape.union_all(*both).select("l_orderkey", "l_linenumber", "label")


# scalar functions


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %d') AS day, substr(lpad(o_custkey::VARCHAR, 5, '0'), 1, 2) AS state, CASE WHEN o_custkey % 3 = 0 THEN 'given' WHEN o_custkey % 3 = 1 THEN '15TWG' END AS tile, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS config FROM orders")
def labels_of_rows(spark, sf_dir):
    """Labels of days and states, tile ids, digests of configurations."""
    k = F.col("o_custkey") % 3
    item = F.when(k == 1, F.concat(F.lit("S2A_MSIL2A_T15TWG_"), F.col("o_orderkey").cast("string"))).otherwise("unknown")
    return orders(spark, sf_dir).select("o_orderkey", sc.day_label("o_orderdate").alias("day"), sc.state_of(F.lpad(F.col("o_custkey").cast("string"), 5, "0")).alias("state"), sc.tile_id(item, F.when(k == 0, "given")).alias("tile"), sc.config_hash("o_orderstatus", "o_custkey").alias("config"))


@query(f"WITH {RUNS} SELECT unit, year, round(avg(predicted) - coalesce(stddev_samp(predicted), 0), 5) AS low, round(avg(predicted) + coalesce(stddev_samp(predicted), 0), 5) AS high FROM runs GROUP BY unit, year", digits=5)
def spread_bands(spark, sf_dir):
    e = metrics.ensemble(runs(spark, sf_dir), ["unit", "year"])
    return e.select("unit", "year", *[c.alias(k) for k, c in sc.band("predicted", "sd").items()])


@query(f"WITH {TRENDED} SELECT unit, year, round(y - trend, 4) AS anomaly, round(y, 4) AS restored FROM trended WHERE trend IS NOT NULL", digits=4)
def yield_anomalies(spark, sf_dir):
    t = trended(spark, sf_dir).filter("trend is not null").withColumn("anomaly", sc.yield_anomaly("y", "trend"))
    return t.select("unit", "year", "anomaly", sc.yield_from_anomaly("anomaly", "trend").alias("restored"))


@query(f"WITH {PAIRS} SELECT unit, year, CASE WHEN ea < eb THEN 'A' WHEN ea > eb THEN 'B' ELSE 'tie' END AS better FROM (SELECT unit, year, abs(actual - pa) AS ea, abs(actual - pb) AS eb FROM pairs)")
def better_rows(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumns({"ea": F.abs(F.col("actual") - F.col("pa")), "eb": F.abs(F.col("actual") - F.col("pb"))})
    return p.select("unit", "year", sc.better("ea", "eb", "mae").alias("better"))


# joins, shapes and report tables


@query("SELECT o_orderkey, trim(x) AS word FROM (SELECT o_orderkey, unnest(string_split(o_orderstatus || '; ' || o_orderpriority || ';;', ';')) AS x FROM orders) WHERE trim(x) <> ''")
def split_lists(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", F.concat("o_orderstatus", F.lit("; "), "o_orderpriority", F.lit(";;")).alias("word"))
    return reshape.split_list(o, "word")


@query("SELECT l_orderkey, l_linenumber, s_nationkey AS zone FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3)")
def zones_of_cohort(spark, sf_dir):
    """Rows of units that all scenarios have, with their zone."""
    li = table(spark, sf_dir, "lineitem")
    rows = joins.restrict(li, joins.common_cohort(li, ["l_partkey"], "l_returnflag"), ["l_partkey"])
    bridge = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
    return joins.assign_zone(rows, bridge, "l_suppkey").select("l_orderkey", "l_linenumber", "zone")


@query(f"WITH {SEASON}, wide AS (SELECT unit, year, " + ", ".join(f"max(CASE WHEN doy = {d} THEN value END) AS v{d}" for d in (65, 81, 97)) + f" FROM season GROUP BY unit, year), prior AS (SELECT w.unit, w.year, " + ", ".join(f"avg(p.v{d}) AS m{d}" for d in (65, 81, 97)) + f" FROM wide w JOIN wide p ON p.unit = w.unit AND p.year < w.year GROUP BY 1, 2) SELECT unit, year, " + ", ".join(f"round(v{d} - m{d}, 5) AS a{d}" for d in (65, 81, 97)) + " FROM wide LEFT JOIN prior USING (unit, year) WHERE year = 1997", digits=5)
def aligned_history(spark, sf_dir):
    """A year's season against the means of the years before, as arrays."""
    days = (65, 81, 97)
    wide = season(spark, sf_dir, GRID).groupBy("unit", "year").agg(F.array(*[F.max(F.when(F.col("doy") == d, F.col("value"))) for d in days]).alias("values"))
    means = wide.filter("year < 1997").groupBy("unit").agg(F.array(*[F.avg(F.col("values")[i]) for i in range(3)]).alias("prior"))
    rows = joins.align_history(wide.filter("year = 1997"), means, ["unit"], "values", "prior")
    return rows.select("unit", "year", *[F.col("anomaly")[i].alias(f"a{d}") for i, d in enumerate(days)])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def ranked_rows(spark, sf_dir):
    """Rows in a given order of one column; then in the fixed order of all keys."""
    n = orders(spark, sf_dir).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return reshape.sort_keys(reshape.order_by_rank(n, "o_orderstatus", ["P", "O", "F"]), ["o_orderpriority"])


@query("SELECT p_brand, sum(p_size)::BIGINT AS area, row_number() OVER (ORDER BY sum(p_size) DESC, p_brand) AS place FROM part GROUP BY 1")
def largest_first(spark, sf_dir):
    """Report groups, largest first, with their place."""
    areas = reshape.largest_first(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("area")), "area", ["p_brand"])
    return areas.withColumn("place", F.row_number().over(windows.by([], F.desc("area"), "p_brand")))


@query("SELECT l_suppkey, l_returnflag, CASE WHEN count(*) FILTER (WHERE l_quantity > 10) = count(*) THEN round(avg(l_tax), 6) END AS tax FROM lineitem GROUP BY 1, 2")
def complete_composites(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_tax").alias("tax"), F.count_if(F.col("l_quantity") > 10).alias("found"), F.count("*").alias("expected"))
    return maps.complete_only(li, ["tax"], "found", "expected").select("l_suppkey", "l_returnflag", "tax")


@query(f"WITH {CELLS} SELECT year, " + ", ".join(f"max(CASE WHEN seed = {s} THEN rmse END) AS s{s}" for s in (1, 2)) + " FROM cells GROUP BY year")
def late_season(spark, sf_dir):
    """The last checkpoint's values, scenarios side by side."""
    c = cells(spark, sf_dir).filter("seed <= 2").select("year", F.concat(F.lit("s"), F.col("seed").cast("string")).alias("scenario"), "rmse")
    rows = c.withColumn("doy", F.lit(273)).unionByName(c.withColumns({"doy": F.lit(193), "rmse": F.lit(0.0)}))
    return metrics.late_season(rows, "scenario", ["s1", "s2"], "rmse")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS reason FROM orders GROUP BY 1")
def reasons(spark, sf_dir):
    return metrics.reasons(orders(spark, sf_dir).withColumnRenamed("o_orderpriority", "reason"), ["o_custkey"], "reason")


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('7|' || (l_orderkey * 10 + l_linenumber)), l_orderkey * 10 + l_linenumber) AS r FROM lineitem) SELECT l_linestatus, l_returnflag, count(*) AS n, count(*) FILTER (WHERE r <= 200) AS n_sampled FROM s GROUP BY 1, 2")
def class_counts(spark, sf_dir):
    """Classes before and after a balanced sample. Keys repeat in this table: of rows with one key, which the SQL leaves open, those of the smaller status come first."""
    li = table(spark, sf_dir, "lineitem").withColumn("key", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))
    return metrics.class_counts(li, ["l_linestatus"], "l_returnflag", windows.balanced_sample(li, "l_returnflag", "key", 200, 7, ["l_linestatus"], keyless_last=True))


@query(f"WITH {RUNS}, m AS (SELECT unit, year, avg(predicted - actual) AS d FROM runs GROUP BY 1, 2) SELECT year, round(min(d), 4) AS low, round(max(d), 4) AS high, round(max(abs(d)), 4) AS limit_ FROM m GROUP BY year", digits=4)
def colour_limits(spark, sf_dir):
    return metrics.colour_limits(metrics.map_table(runs(spark, sf_dir), ["unit", "year"]), ["year"]).withColumnRenamed("limit", "limit_")


@query(f"WITH {TRENDED} SELECT unit, count(*) AS n_train, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) >= 3 AND count(*) >= 5 AS enough, (max(CASE WHEN y IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN trend IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS n_features FROM trended GROUP BY unit")
def training_features(spark, sf_dir):
    return metrics.training_audit(trended(spark, sf_dir), ["unit"], least_rows=5, features=["y", "trend"])


@query(f"WITH {GAINS} SELECT substr(feature, 1, 7) AS grp, round(sum(share) / (SELECT count(DISTINCT fit) FROM shares), 6) AS mean_share FROM shares GROUP BY 1")
def importance_groups(spark, sf_dir):
    """Shares summed by group of features, over all fits."""
    return metrics.importance_mean(shares(spark, sf_dir).withColumn("grp", F.substring("feature", 1, 7)), ["fit"], ["grp"])


@query(f"WITH {SCORES}, c AS (SELECT * FROM scores WHERE name LIKE 'common%') SELECT year, 1::BIGINT AS n_reference, count(*) FILTER (WHERE area_km2 < 0) AS n_bad_area, max(reference_km2) - min(reference_km2) <= 1e-9 AS reference_agrees, max(reference_km2) - min(reference_km2) <= 1e-9 AND count(*) FILTER (WHERE area_km2 < 0) = 0 AS reconciled FROM c GROUP BY year")
def reconciled_area(spark, sf_dir):
    s = scored(spark, sf_dir).filter(F.col("name").startswith("common"))
    return maps.reconcile_area(maps.monthly_area(s, ["year"]), s, ["year"])


# season's features


@query(f"WITH {SEASON}, prior AS (SELECT unit, year, doy, value - avg(value) OVER (PARTITION BY unit, doy ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM season WHERE doy <= 97), cells_ AS (SELECT DISTINCT unit, year FROM prior), full_ AS (SELECT unit, year, doy, a FROM (SELECT unit, year, unnest([65, 81, 97]) AS doy FROM cells_) LEFT JOIN prior USING (unit, year, doy)), f AS (SELECT unit, year, doy, CASE WHEN doy = 81 AND a IS NULL THEN (lag(a) OVER w + lead(a) OVER w) / 2 ELSE a END AS a FROM full_ WINDOW w AS (PARTITION BY unit, year ORDER BY doy)) SELECT unit, year, round(avg(a), 6) AS anom_mean, round(max(a), 6) AS anom_max, round(min(a), 6) AS anom_min, round(max(CASE WHEN doy = 97 THEN a END), 6) AS anom_last, round((max(CASE WHEN doy = 97 THEN a END) - max(CASE WHEN doy = 81 THEN a END)) / 16, 6) AS anom_last_slope FROM f GROUP BY 1, 2")
def anomaly_features(spark, sf_dir):
    """Features of the series of anomalies from the means of earlier years, gaps filled by lines."""
    rows = series.upto(season(spark, sf_dir, GRID), 97)
    before = windows.by(["unit", "doy"], "year").rowsBetween(-(1 << 30), -1)
    anomaly = rows.withColumn("a", F.col("value") - F.avg("value").over(before)).drop("value")
    return series.anomaly_features(anomaly, ["unit", "year"], "a", [65, 81, 97])


@query(f"WITH {TRENDED}, {SEASON}, f AS (SELECT unit, year, avg(value) AS mean FROM season GROUP BY 1, 2), w AS (SELECT unit, year, value AS rain FROM season WHERE doy = 193), s AS (SELECT s_suppkey AS unit, s_acctbal AS balance FROM supplier) SELECT unit, year, round(mean, 5) AS mean, round(rain, 5) AS rain, round(balance, 5) AS balance, round(trend, 4) AS trend FROM f LEFT JOIN w USING (unit, year) LEFT JOIN s USING (unit) LEFT JOIN trended USING (unit, year)", digits=5)
def feature_matrix(spark, sf_dir):
    """Season features, weather at the checkpoint, static attributes and the trend of each unit and year."""
    obs = season(spark, sf_dir, GRID)
    features = obs.groupBy("unit", "year").agg(F.avg("value").alias("mean"))
    static = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("balance"))
    rows, cols = models.feature_matrix(features, obs.withColumnRenamed("value", "rain"), static, trended(spark, sf_dir).select("unit", "year", "trend"), ["unit", "year"], "unit", 193)
    return rows.select("unit", *cols).withColumn("trend", F.round("trend", 4))


# validation


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_custkey % 7 = 0) AS wrong_year, count(*) FILTER (WHERE o_custkey % 5 = 0) AS wrong_month, count(*) FILTER (WHERE o_custkey % 11 = 0) AS wrong_date FROM orders GROUP BY 1")
def file_keys(spark, sf_dir):
    """Rows that disagree with the name of their file, or whose date isn't their checkpoint's."""
    d, k = F.to_date("o_orderdate"), F.col("o_custkey")
    o = orders(spark, sf_dir).withColumns({"year": F.year(d), "month": F.month(d), "doy": F.dayofyear(d), "file_year": F.when(k % 7 == 0, 1900).otherwise(F.year(d)), "file_month": F.when(k % 5 == 0, F.lit(None)).otherwise(F.month(d)), "date": F.when(k % 11 == 0, F.date_add(d, 1)).otherwise(d)})
    return audits.file_key_audit(o, ["o_orderstatus"], "file_year", "file_month", "year", "month", "date", "doy")


@query("SELECT l_suppkey, count(DISTINCT l_linenumber) AS n_doys, list_sort(list_distinct(list(l_linenumber))) = [1, 2, 3, 4, 5, 6, 7] AS complete, count(*) FILTER (WHERE l_tax > 0.07) AS n_incomplete_days FROM lineitem GROUP BY 1")
def grid_of_variables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("rain", F.when(F.col("l_tax") <= 0.07, F.col("l_tax"))).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
    return audits.grid_check(li, ["l_suppkey"], "l_linenumber", list(range(1, 8)), ["l_quantity", "rain"])


@query("SELECT 'missing input' AS reason, y::BIGINT AS year FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders WHERE o_totalprice > 400 AND o_orderpriority > '1') UNION SELECT 'too few earlier years', y FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) a WHERE (SELECT count(DISTINCT year(o_orderdate)) FROM orders WHERE year(o_orderdate) < a.y) < 3")
def blocked_years(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("year", F.year("o_orderdate").cast("bigint"))
    years = o.select("year").distinct()
    return audits.blocking(audits.availability(years, o.filter("o_totalprice > 400 and o_orderpriority > '1'"), ["year"]), years, years)


INVENTORY = "SELECT l_suppkey AS zone, year(l_shipdate)::BIGINT AS year, (l_suppkey * 10 + CASE WHEN l_suppkey % 7 = 0 THEN year(l_shipdate) ELSE 0 END)::DOUBLE AS inventory, (l_suppkey + CASE WHEN l_suppkey % 11 = 0 AND year(l_shipdate) = 1996 THEN 0.5 ELSE 0 END)::DOUBLE AS reference FROM lineitem GROUP BY l_suppkey, year(l_shipdate)"


@query(f"WITH c AS ({INVENTORY}), t AS (SELECT *, count(DISTINCT year) OVER (PARTITION BY zone) AS k, (SELECT count(DISTINCT year) FROM c) AS n FROM c), z AS (SELECT zone, max(inventory) <> min(inventory) AS i, max(reference) <> min(reference) AS r, count(*) AS k FROM c GROUP BY zone) SELECT 0::BIGINT AS duplicates, (SELECT count(*) FROM c WHERE inventory % 1 <> 0 OR reference % 1 <> 0) AS not_whole, count(*) FILTER (WHERE i) AS inventory_changes, count(*) FILTER (WHERE r) AS reference_changes, count(*) FILTER (WHERE k <> (SELECT count(DISTINCT year) FROM c)) AS zones_lacking_periods FROM z")
def validated_inventory(spark, sf_dir):
    """Zones whose inventory or reference moves between years, and counts that aren't whole."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.year("l_shipdate").alias("year")).distinct()
    c = li.withColumns({"inventory": (F.col("zone") * 10 + F.when(F.col("zone") % 7 == 0, F.col("year")).otherwise(0)).cast("double"), "reference": F.col("zone") + F.when((F.col("zone") % 11 == 0) & (F.col("year") == 1996), 0.5).otherwise(0.0)})
    return audits.validate_inventory(c, ["zone"], ["year"], "inventory", "reference")


@query(f"WITH {SCORES} SELECT year, name, year % 3 <> 0 OR area_bias_pct IS NULL AS bias_agrees FROM scores")
def reconciled_bias(spark, sf_dir):
    """Stored biases, some of them changed, against those recomputed from the counts."""
    s = scored(spark, sf_dir).withColumn("stored", F.col("area_bias_pct") + F.when(F.col("year") % 3 == 0, 0.1).otherwise(0.0))
    return audits.reconcile_bias(s, "stored").select("year", "name", "bias_agrees")


@query(f"WITH {RUNS} SELECT year, count(*) AS n, count(*) FILTER (WHERE predicted - 1000 < 0) AS n_negative FROM runs GROUP BY year")
def negative_predictions(spark, sf_dir):
    return audits.negative_predictions(runs(spark, sf_dir).withColumn("predicted", F.col("predicted") - 1000), ["year"])


@query("SELECT o_orderstatus, count(*) AS n_periods, count(*) FILTER (WHERE o_custkey % 2 = 0) AS n_complete, min(o_orderdate::DATE) AS first_start, max(o_orderdate::DATE + 16) AS last_end FROM orders GROUP BY 1")
def period_audit(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return audits.temporal_audit(orders(spark, sf_dir).withColumns({"start": d, "end": F.date_add(d, 16), "complete": F.col("o_custkey") % 2 == 0}), ["o_orderstatus"])


@query(f"WITH {RUNS}, m AS (SELECT seed, year, sqrt(avg((actual - predicted)^2)) AS rmse FROM runs GROUP BY seed, year) SELECT seed, year, seed % 2 = 0 AS agrees FROM m")
def verified_changed_metrics(spark, sf_dir):
    """Stored metrics of odd seeds are changed; the check finds just these."""
    r = runs(spark, sf_dir)
    m = metrics.forecast_metrics(r, ["seed", "year"]).select("seed", "year", (F.col("rmse") * F.when(F.col("seed") % 2 == 1, 1.001).otherwise(1.0)).alias("rmse"))
    return metrics.verify_metrics(r, m, ["seed", "year"], ["rmse"]).select("seed", "year", "agrees")


@query(f"WITH {RUNS} SELECT count(*) AS n, count(*) FILTER (WHERE unit % 5 = 0) AS differing FROM runs WHERE seed = 1")
def changed_targets(spark, sf_dir):
    """One side's targets are changed for every fifth unit."""
    r = runs(spark, sf_dir)
    other = r.filter("seed = 2").withColumn("actual", F.col("actual") + F.when(F.col("unit") % 5 == 0, 1.0).otherwise(0.0))
    return joins.same_targets(r.filter("seed = 1"), other, ["unit", "year"], "actual")


@query(f"WITH {RUNS}, m AS (SELECT seed, year, count(*) AS n FROM runs GROUP BY 1, 2) SELECT count(*) FILTER (WHERE seed = 2) AS duplicates, count(*) FILTER (WHERE seed = 1) AS missing, count(*) FILTER (WHERE seed = 3) AS wrong_n, (SELECT count(*) FROM (SELECT DISTINCT unit, year FROM runs WHERE unit % 4 = 0)) AS unstable_targets FROM m")
def violated_results(spark, sf_dir):
    """Metrics with repeated, missing and wrong cells, and predictions whose targets differ between runs."""
    r = runs(spark, sf_dir)
    m = metrics.forecast_metrics(r, ["seed", "year"]).filter("seed > 1").withColumn("n", F.col("n") + F.when(F.col("seed") == 3, 1).otherwise(0))
    m = m.unionByName(m.filter("seed = 2"))
    p = r.withColumn("actual", F.col("actual") + F.when((F.col("unit") % 4 == 0) & (F.col("seed") == 1), 1.0).otherwise(0.0))
    return audits.validate_results(m, p, ["seed", "year"], "unit", [r.select("seed").distinct(), r.select("year").distinct()])


# tests


@query(f"WITH {BOOTSTRAP}, v AS (SELECT *, (year % 10) / 100.0::DOUBLE AS p FROM boot), w AS (SELECT *, CASE WHEN low > 0 AND p < 0.05 THEN 'B' WHEN high < 0 AND p < 0.05 THEN 'A' WHEN low > 0 OR high < 0 OR p < 0.05 THEN 'M' ELSE 'N' END AS v FROM v) SELECT statistic, count(*) AS n_cells, count(*) FILTER (WHERE low > 0 OR high < 0) AS n_excludes_zero, count(*) FILTER (WHERE p < 0.05) AS n_significant, count(*) FILTER (WHERE v = 'A') AS a_better, count(*) FILTER (WHERE v = 'B') AS b_better, count(*) FILTER (WHERE v = 'M') AS mixed, count(*) FILTER (WHERE v = 'N') AS no_difference FROM w GROUP BY statistic")
def verdict_counts(spark, sf_dir):
    """Verdicts over years, by statistic."""
    b = stats.cluster_bootstrap(pairs(spark, sf_dir), ["year"], "nation", "actual", "pa", "pb", 2000, 42)
    b = b.withColumns({"low": F.round("low", 5), "high": F.round("high", 5), "p": (F.col("year") % 10) / 100.0})
    return stats.verdicts(b, ["statistic"])


@query()
def test_pvalues(spark, sf_dir):
    """p-values of all paired tests by year (no SQL has these distributions; tests hold them against tables of values)."""
    p = pairs(spark, sf_dir).withColumns({"ea": F.abs(F.col("actual") - F.col("pa")), "eb": F.abs(F.col("actual") - F.col("pb"))})
    dm = stats.dm_test(p, ["year"], "actual", "pa", "pb").select("year", F.col("p").alias("p_dm"), "verdict")
    j = stats.j_test(p, ["year"], "actual", "pa", "pb").select("year", F.col("p_a").alias("p_ja"), F.col("p_b").alias("p_jb"))
    w = stats.wilcoxon(p, ["year"], "ea", "eb").select("year", F.col("p").alias("p_w"))
    return stats.paired_t(p, ["year"], "ea", "eb").select("year", F.col("p").alias("p_t")).join(dm, "year").join(j, "year").join(w, "year")


# models


def anomaly_rows(spark, sf_dir) -> DataFrame:
    """The supplier panel with the anomaly as target and what is known before the year."""
    return trended(spark, sf_dir).filter("trend is not null").withColumns({"target": F.col("y") - F.col("trend"), "n": F.col("trend_n").cast("double"), "constant": F.lit(1.0)})


@query()
def gbt_importance(spark, sf_dir):
    """Total gain and share of each feature in a model of the anomaly, features that no tree uses included (Spark ML's trees: no SQL)."""
    cols = ["trend", "trend_slope", "n", "constant"]
    return models.importance(spark, models.fit_gbt(anomaly_rows(spark, sf_dir), cols, "target", maxIter=20), cols)


@query()
def tree_count_sweep(spark, sf_dir):
    """Scores after 5, 10, 15 and 20 trees of one fit on the years before the last three (Spark ML's trees: no SQL)."""
    rows = anomaly_rows(spark, sf_dir)
    last = rows.agg(F.max("year")).first()[0] or 0
    return models.tree_count_sweep(rows.filter(F.col("year") <= last - 3), rows.filter(F.col("year") > last - 3), ["trend", "trend_slope", "n"], "target", "y", "trend", [5, 10, 15, 20])


@query()
def swept_runs(spark, sf_dir):
    """Fits of three seeds, a partition each; those that are there already aren't computed again."""
    path, rows = scratch(spark, "sweep"), anomaly_rows(spark, sf_dir)
    cols = ["trend", "trend_slope", "n"]
    job = lambda seed: models.predict_yield(models.fit_gbt(rows, cols, "target", maxIter=5, maxDepth=3, seed=seed), rows, cols, "trend").select("unit", "year", "predicted")
    models.sweep(job, [1, 2], path, spark, "seed")
    return models.sweep(job, [1, 2, 3], path, spark, "seed")


CHECKPOINTS = {"early": "1994-06-30", "middle": "1996-06-30", "late": "1999-12-31"}
TILES = """tiles AS (SELECT l_orderkey * 10 + l_linenumber AS cell, CASE WHEN l_partkey % 97 = 5 THEN 'small' WHEN l_returnflag = 'A' THEN 'one sided' ELSE l_returnflag END AS tile, l_shipdate::DATE AS date, l_quantity, l_discount, l_tax,
  CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_returnflag = 'A' OR l_quantity > 25 THEN 1 WHEN l_discount > 0.05 THEN 5 ELSE 0 END END AS label FROM lineitem)"""


def tiles(spark, sf_dir) -> DataFrame:
    """Order lines as pixels of tiles; a third of them have labels. One tile has a class only, one few points."""
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    tile = F.when(F.col("l_partkey") % 97 == 5, "small").when(flag == "A", "one sided").otherwise(flag)
    label = F.when(F.col("l_orderkey") % 3 == 0, F.when((flag == "A") | (q > 25), 1).when(F.col("l_discount") > 0.05, 5).otherwise(0))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), tile.alias("tile"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_discount", "l_tax", label.alias("label"))


def cell_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training points, and the status of every tile and checkpoint; scenes are the months of the lines."""
    pix = tiles(spark, sf_dir)
    points = models.training_points(pix, "tile", "label", "cell")
    return points, models.cell_status(points, pix.select("tile", F.trunc("date", "month").cast("date").alias("date")), "tile", "label", CHECKPOINTS)


@query(
    f"""WITH {TILES}, n AS (SELECT tile, sum(least(k, 1000))::BIGINT AS n, count(*) AS n_classes, coalesce(sum(least(k, 1000)) FILTER (WHERE label = 1), 0)::BIGINT AS n_code FROM (SELECT tile, label, count(*) AS k FROM tiles WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY tile),
    cuts AS (SELECT * FROM (VALUES {", ".join(f"('{k}', DATE '{v}')" for k, v in CHECKPOINTS.items())}) AS c(checkpoint, cut)), d AS (SELECT tile, checkpoint, count(DISTINCT CASE WHEN date_trunc('month', date) <= cut THEN date_trunc('month', date) END) AS n_dates FROM tiles, cuts GROUP BY 1, 2)
    SELECT tile, checkpoint, n_dates, coalesce(n, 0) AS n, coalesce(n_classes, 0) AS n_classes, coalesce(n_code, 0) AS n_code, CASE WHEN n_dates = 0 THEN 'INSUFFICIENT_DATES' WHEN coalesce(n, 0) < 50 OR coalesce(n_classes, 0) < 2 OR coalesce(n_code, 0) < 5 THEN 'INSUFFICIENT_SAMPLES' WHEN n_dates = 1 THEN 'LOW_DATE_COUNT' ELSE 'TRAINED' END AS status FROM d LEFT JOIN n USING (tile)"""
)
def cell_status(spark, sf_dir):
    return cell_points(spark, sf_dir)[1]


@query()
def classified_pixels(spark, sf_dir):
    """A forest of 100 trees for every tile and checkpoint that can be trained, on the bands known by then (Spark ML's trees: no SQL)."""
    points, status = cell_points(spark, sf_dir)
    known = {"early": ["l_quantity"], "middle": ["l_quantity", "l_discount"], "late": ["l_quantity", "l_discount", "l_tax"]}
    out = models.classify_cells(tiles(spark, sf_dir), points, status, "tile", "label", lambda _, checkpoint: known[checkpoint], scratch(spark, "cells"))
    return out.select("tile", "checkpoint", "cell", "is_class", "confidence")


# streams' rules on finished tables


@query("WITH d AS (SELECT user_id AS unit, ts::DATE AS d FROM events) SELECT unit, to_timestamp(floor(epoch(d) / 432000) * 432000)::TIMESTAMP AS start, count(DISTINCT d) AS n_days FROM d GROUP BY 1, 2 HAVING count(DISTINCT d) >= 2".replace("to_timestamp(floor(epoch(d) / 432000) * 432000)::TIMESTAMP", "make_timestamp((floor(epoch(d) / 432000) * 432000000000)::BIGINT)"))
def complete_periods(spark, sf_dir):
    """Five-day windows in which a user has readings of two days at least."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "unit")
    return streams.stream_complete_periods(e, "unit", "ts", "5 days", "1 day", 2).select("unit", F.col("start").cast("timestamp_ntz").alias("start"), "n_days")


# the same rules as streams: files that arrive in turn, run to their end

#: Arrivals of events: the first half, the second half with some of the first again, and what comes late.
ARRIVALS = """mid AS (SELECT min(ts) + to_seconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 2000000) AS m FROM events),
arrived AS (SELECT CASE WHEN event_id % 10 = 0 THEN 2 WHEN ts < m THEN 0 ELSE 1 END AS arrival, user_id, event_type, ts, value FROM events, mid UNION ALL SELECT 1, user_id, event_type, ts, value FROM events, mid WHERE event_id % 7 = 0 AND event_id % 10 > 0 AND ts < m),
marks AS (SELECT arrival, date_trunc('milliseconds', max(ts)) AS top FROM arrived GROUP BY 1),
known AS (SELECT a.*, (SELECT max(top) FROM marks WHERE marks.arrival <= a.arrival - 2) AS seen, (SELECT max(top) FROM marks) AS last FROM arrived a)"""


def arriving(spark, sf_dir, job) -> DataFrame:
    """What the job's stream gives of events that arrive in three batches."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    first = F.unix_micros("ts") < (low or 0) + ((high or 0) - (low or 0)) // 2_000_000 * 1_000_000
    late = F.col("event_id") % 10 == 0
    again = e.filter(~late & first & (F.col("event_id") % 7 == 0))
    path = scratch(spark, "arrivals")
    files = streams.arrivals([e.filter(~late & first), e.filter(~late & ~first).unionAll(again), e.filter(late)], path)
    return streams.landed(spark, path, e.schema, job, scratch(spark, "landed"), files)[0]


WINDOW = "make_timestamp(epoch_us(ts) // 432000000000 * 432000000000)"


@query(f"""WITH {ARRIVALS}, w AS (SELECT *, {WINDOW} AS start, {WINDOW} + INTERVAL '5 days' AS end_ FROM known) SELECT user_id, start, end_ AS "end", count(*) AS n, round(sum(value), 4) AS total FROM w WHERE (seen IS NULL OR end_ > seen - INTERVAL '1 day') AND end_ <= last - INTERVAL '1 day' GROUP BY 1, 2, 3""", digits=4)
def streamed_trailing(spark, sf_dir):
    """Five-day sums of a stream of files: windows come out once the watermark has passed them; what comes later is left out, repeats count."""
    job = lambda rows: streams.stream_trailing(rows, "user_id", "ts", "5 days", "1 day", [F.count("*").alias("n"), F.sum("value").alias("total")])
    out = arriving(spark, sf_dir, job)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"WITH {ARRIVALS} SELECT DISTINCT user_id, event_type, ts FROM known WHERE seen IS NULL OR ts > seen - INTERVAL '2 days'")
def streamed_dedupe(spark, sf_dir):
    """First arrivals of a stream of files."""
    out = arriving(spark, sf_dir, lambda rows: streams.stream_dedupe(rows.select("user_id", "event_type", "ts"), ["user_id", "event_type", "ts"], "ts", "2 days"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {ARRIVALS}, w AS (SELECT *, {WINDOW} AS start, {WINDOW} + INTERVAL '5 days' AS end_ FROM known) SELECT user_id AS unit, start, count(DISTINCT ts::DATE) AS n_days FROM w WHERE (seen IS NULL OR end_ > seen - INTERVAL '1 day') AND end_ <= last - INTERVAL '1 day' GROUP BY 1, 2 HAVING count(DISTINCT ts::DATE) >= 2")
def streamed_periods(spark, sf_dir):
    """Windows of a stream of files that have readings of two days at least."""
    job = lambda rows: streams.stream_complete_periods(rows.withColumnRenamed("user_id", "unit"), "unit", "ts", "5 days", "1 day", 2)
    return arriving(spark, sf_dir, job).select("unit", F.col("start").cast("timestamp_ntz").alias("start"), "n_days")
