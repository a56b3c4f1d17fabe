"""The operators' concepts bound to the driver's tables (suppliers as units, nations as clusters, order lines as pixels, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.windows import causal_trend, portable_draw


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (supplier), year, y: mean price of a piece."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").cast("bigint").alias("year")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 9).alias("y"))


PANEL = "panel AS (SELECT l_suppkey AS unit, year(l_shipdate)::BIGINT AS year, round(avg(l_extendedprice / l_quantity), 9) AS y FROM lineitem GROUP BY 1, 2)"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (customer), year, y: mean order price; with gaps."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("bigint").alias("year")).agg(F.round(F.avg("o_totalprice"), 9).alias("y"))


SPARSE = "sparse AS (SELECT o_custkey AS unit, year(o_orderdate)::BIGINT AS year, round(avg(o_totalprice), 9) AS y FROM orders GROUP BY 1, 2)"


def trended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier panel with its causal trend."""
    return causal_trend(panel(spark, sf_dir), ["unit"], "year", "y")


TRENDED = (
    PANEL
    + """, windowed AS (SELECT *, count(y) OVER w AS trend_n, avg(CASE WHEN y IS NOT NULL THEN year END) OVER w AS mx, avg(y) OVER w AS my, regr_slope(y, year) OVER w AS s,
  min(CASE WHEN y IS NOT NULL THEN year END) OVER w AS trend_first, max(CASE WHEN y IS NOT NULL THEN year END) OVER w AS trend_last
  FROM panel WINDOW w AS (PARTITION BY unit ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
trended AS (SELECT unit, year, y, trend_n, trend_first, trend_last, CASE WHEN trend_n >= 3 THEN my + s * (year - mx) END AS trend, CASE WHEN trend_n >= 3 THEN s END AS trend_slope FROM windowed)"""
)


def runs(spark: SparkSession, sf_dir: str, seeds: int = 5) -> DataFrame:
    """seed, unit, nation, year, actual, trend, predicted: the trend with noise that any engine can repeat."""
    base = trended(spark, sf_dir).filter("trend is not null").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").cast("bigint").alias("nation")), "unit")
    rows = base.withColumn("seed", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(seeds).cast("bigint"))))
    noise = (portable_draw(F.col("seed").cast("string"), F.col("unit").cast("string"), F.col("year").cast("string")) % 1000) / 1000.0 - 0.5
    return rows.select("seed", "unit", "nation", "year", F.col("y").alias("actual"), F.round("trend", 4).alias("trend"), F.round(F.col("trend") * (1 + 0.1 * noise), 4).alias("predicted"))


RUNS = (
    TRENDED
    + """, runs AS (SELECT seed, unit, s_nationkey::BIGINT AS nation, year, y AS actual, round(trend, 4) AS trend,
  round(trend * (1 + 0.1 * ((('0x' || substr(md5(concat_ws('|', seed, unit, year)), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE - 0.5)), 4) AS predicted
  FROM trended JOIN supplier ON s_suppkey = unit, (SELECT unnest(range(1, 6)) AS seed) WHERE trend IS NOT NULL)"""
)


def season_lines(spark: SparkSession, sf_dir: str, grid: list[int], **values: str) -> DataFrame:
    """unit (part), year, doy (on the grid) of every line shipped in the 16 days up to a checkpoint, with its quantity as value, or `values` (SQL)."""
    li = table(spark, sf_dir, "lineitem")
    d = F.dayofyear("l_shipdate")
    at = (grid[0] + 16 * F.ceil((d - grid[0]) / 16)).cast("bigint")
    cols = [F.expr(v).alias(k) for k, v in (values or {"value": "l_quantity"}).items()]
    return li.filter(d.between(grid[0] - 15, grid[-1])).select(F.col("l_partkey").alias("unit"), F.year("l_shipdate").cast("bigint").alias("year"), at.alias("doy"), *cols)


def season(spark: SparkSession, sf_dir: str, grid: list[int]) -> DataFrame:
    """unit (part), year, doy (on the grid), value: mean quantity of lines shipped in the 16 days up to each checkpoint; with gaps."""
    return season_lines(spark, sf_dir, grid).groupBy("unit", "year", "doy").agg(F.round(F.avg("value"), 9).alias("value"))


SEASON = """season AS (SELECT l_partkey AS unit, year(l_shipdate)::BIGINT AS year, (65 + 16 * ceil((dayofyear(l_shipdate) - 65) / 16.0))::BIGINT AS doy, round(avg(l_quantity), 9) AS value
  FROM lineitem WHERE dayofyear(l_shipdate) BETWEEN 50 AND 273 GROUP BY 1, 2, 3)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (user), date, tmax, n: events by day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 9).alias("tmax"), F.count("*").alias("n"))


DAILY = "daily AS (SELECT user_id AS unit, ts::DATE AS date, round(avg(value), 9) AS tmax, count(*) AS n FROM events GROUP BY 1, 2)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone (supplier), cell, truth, truth_valid, masks: order lines as pixels."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("zone"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), F.year("l_shipdate").cast("bigint").alias("year"), (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_quantity") > 2).alias("truth_valid"), (F.col("l_discount") > 0.05).alias("a"), (F.col("l_quantity") > 4).alias("a_valid"), (F.col("l_tax") > 0.04).alias("b"), (F.col("l_quantity") < 49).alias("b_valid"))


PIXELS = "pixels AS (SELECT l_suppkey AS zone, l_orderkey * 10 + l_linenumber AS cell, year(l_shipdate)::BIGINT AS year, l_returnflag = 'R' AS truth, l_quantity > 2 AS truth_valid, l_discount > 0.05 AS a, l_quantity > 4 AS a_valid, l_tax > 0.04 AS b, l_quantity < 49 AS b_valid FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to so many digits; whole numbers as bigint; for comparison with SQL. `exact` columns stay as they are."""
    out = {}
    for c, t in df.dtypes:
        if c in exact:
            continue
        if t in ("double", "float") or t.startswith("decimal"):
            out[c] = F.round(F.col(c).cast("double"), digits)
        elif t in ("int", "smallint", "tinyint"):
            out[c] = F.col(c).cast("bigint")
    return df.withColumns(out) if out else df
