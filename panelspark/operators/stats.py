"""Tests on paired rows as grouped aggregates; only the p-values of the few result rows go through Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .prefix import tied_ranks
from .windows import portable_draw


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([None if math.isnan(p := t_two_sided(a, b)) else p for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return pd.Series([None if z_ is None or math.isnan(z_) else math.erfc(abs(z_) / math.sqrt(2)) for z_ in z], dtype="float64")


def signed_rank_two_sided(w: float, n: int) -> float:
    """The exact two-sided p of the smaller rank sum w of n differences without ties: of the 2^n sign patterns those at least as far out."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        ways = np.convolve(ways, np.eye(1, rank + 1)[0] + np.eye(1, rank + 1, rank)[0]) / 2
    return min(1.0, 2 * float(ways[: math.floor(w) + 1].sum()))


def signed_rank_pvalue(w: Column | str, n: Column | str, z: Column | str, tied: Column | str, exact_upto: int = 50) -> Column:
    """Two-sided p of a signed-rank test: exact for few differences without ties, else from the normal z."""

    @F.pandas_udf(DoubleType())
    def p(w: pd.Series, n: pd.Series, z: pd.Series, tied: pd.Series) -> pd.Series:
        out = []
        for w_, n_, z_, t_ in zip(w, n, z, tied):
            if w_ is None or math.isnan(w_) or not n_:
                out.append(None)
            elif n_ <= exact_upto and not t_:
                out.append(signed_rank_two_sided(w_, int(n_)))
            else:
                out.append(None if z_ is None or math.isnan(z_) else math.erfc(abs(z_) / math.sqrt(2)))
        return pd.Series(out, dtype="float64")

    return p(w, n, z, tied)


def paired_t(pairs: DataFrame, by: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """mean_a, mean_b, mean_diff, sd_diff, n, t, p: if all differences are 0, t is 0 and p 1; if they are equal but not 0, NULL."""
    d = F.col(a) - F.col(b)
    out = pairs.filter(d.isNotNull()).groupBy(*by).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.count("*").alias("n"), F.max(F.abs(d)).alias("__m"))
    t = F.when(F.col("__m") == 0, F.lit(0.0)).when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))
    out = out.withColumn("t", F.when(F.col("n") >= least, t)).drop("__m")
    return out.withColumn("p", t_pvalue(F.col("t"), F.col("n").cast("double") - 1))


def wilcoxon(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Signed ranks of the differences that aren't 0: w_plus, w_minus, w, n, z (normal, with tie correction), p (exact for few rows without ties)."""
    d = pairs.withColumn("__d", F.col(a) - F.col(b)).filter("__d <> 0")
    ups = {"__up": (F.col("__d") > 0).cast("long")}
    ranks = tied_ranks(d, by, F.abs("__d"), "__r", ups)  # a row for each size of a difference
    up, k = F.col("__up"), F.col("n").cast("double")
    out = ranks.groupBy(*by).agg(F.sum(F.col("__r") * up).alias("w_plus"), F.sum(F.col("__r") * (k - up)).alias("w_minus"), F.sum("n").alias("n"), F.sum(k * k * k - k).alias("__ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48
    out = out.withColumn("w", F.least("w_plus", "w_minus")).withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(var)))
    return out.withColumn("p", signed_rank_pvalue("w", "n", "z", F.col("__ties") > 0)).drop("__ties")


def dm_test(pairs: DataFrame, by: list[str], actual: str, a: str, b: str, loss: str = "squared", ddof: int = 0, least: int = 8, order: str | None = None, h: int = 1) -> DataFrame:
    """Diebold-Mariano with the small-sample factor: mean_loss_diff, var, n, dm, p (t with n - 1 degrees), verdict. For h > 1 autocovariances over `order` are added."""
    ea, eb = F.col(actual) - F.col(a), F.col(actual) - F.col(b)
    d = ea * ea - eb * eb if loss == "squared" else F.abs(ea) - F.abs(eb)
    rows = pairs.withColumn("__d", d).filter("__d is not null")
    aggs = [F.avg("__d").alias("mean_loss_diff"), (F.var_samp if ddof else F.var_pop)("__d").alias("var"), F.count("*").alias("n")]
    if h > 1:
        w = Window.partitionBy(*by)
        rows = rows.withColumn("__c", F.col("__d") - F.avg("__d").over(w))
        for k in range(1, h):
            rows = rows.withColumn(f"__c{k}", F.col("__c") * F.lag("__c", k).over(w.orderBy(order)))
            aggs.append(F.sum(f"__c{k}").alias(f"__g{k}"))
    out = rows.groupBy(*by).agg(*aggs)
    n = F.col("n").cast("double")
    var = F.col("var")
    for k in range(1, h):
        var = var + 2 * (1 - k / h) * F.col(f"__g{k}") / n
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    dm = F.when((n >= least) & (var > 1e-300), F.try_divide(F.col("mean_loss_diff"), F.sqrt(var / n)) * factor)
    out = out.withColumn("dm", dm).drop(*[f"__g{k}" for k in range(1, h)]).withColumn("p", t_pvalue(F.col("dm"), n - 1))
    few, same = F.col("n") < least, F.col("var") < 1e-12
    text = F.when(few, "too few rows").when(same, "identical").when(F.col("p") >= 0.05, "no difference").when(F.col("dm") < 0, "A better").when(F.col("dm") > 0, "B better")
    return out.withColumn("verdict", text)


def j_test(pairs: DataFrame, by: list[str], actual: str, a: str, b: str, least: int = 5) -> DataFrame:
    """The regression actual ~ 1 + a + b in closed form: both coefficients, their t values and p; one fit serves both directions."""
    y, x, z = F.col(actual), F.col(a), F.col(b)
    ok = y.isNotNull() & x.isNotNull() & z.isNotNull()
    m = pairs.filter(ok).groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(x).alias("__xx"), F.var_pop(z).alias("__zz"), F.var_pop(y).alias("__yy"), F.covar_pop(x, z).alias("__xz"), F.covar_pop(x, y).alias("__xy"), F.covar_pop(z, y).alias("__zy"))
    xx, zz, yy, xz, xy, zy, n = (F.col(k) for k in ("__xx", "__zz", "__yy", "__xz", "__xy", "__zy", "n"))
    det = xx * zz - xz * xz
    ba, bb = F.try_divide(xy * zz - zy * xz, det), F.try_divide(zy * xx - xy * xz, det)
    s2 = (yy - ba * xy - bb * zy) * n / (n - 3)
    ta, tb = ba / F.sqrt(s2 * zz / (det * n)), bb / F.sqrt(s2 * xx / (det * n))
    good = (n >= least) & (det > 1e-12 * xx * zz)
    out = m.select(*by, "n", F.when(good, ba).alias("coef_a"), F.when(good, bb).alias("coef_b"), F.when(good & (s2 > 0), ta).alias("t_a"), F.when(good & (s2 > 0), tb).alias("t_b"))
    return out.withColumns({f"p_{k}": t_pvalue(F.col(f"t_{k}"), F.col("n").cast("double") - 3) for k in "ab"})


def cluster_bootstrap(pairs: DataFrame, by: list[str], cluster: str, actual: str, a: str, b: str, n_boot: int = 2000, seed: int = 42, trend: str = "trend") -> DataFrame:
    """statistic, point, low and high (2.5 % and 97.5 %) when whole clusters are drawn with replacement, n_clusters.

    Statistics: rmse_gap and mae_gap (a - b), skill_a and skill_b (against the trend). Rows become sums by cluster once; draws then
    work on the sums. Draws are the same in any engine (see portable_draw). Bounds of fewer than two clusters are NULL.
    """
    y = F.col(actual)
    ea, eb, et = y - F.col(a), y - F.col(b), y - F.col(trend)
    parts = {"__n": F.count("*"), "__sa": F.sum(ea * ea), "__sb": F.sum(eb * eb), "__aa": F.sum(F.abs(ea)), "__ab": F.sum(F.abs(eb)), "__st": F.sum(et * et)}
    sums = pairs.groupBy(*by, cluster).agg(*[v.cast("double").alias(k) for k, v in parts.items()])
    cells = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(cluster, *parts))).alias("__c")).withColumn("n_clusters", F.size("__c").cast("bigint"))  # a cell's clusters: a few dozen

    def added(rows: DataFrame, clusters: str) -> DataFrame:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in parts])
        rows = rows.withColumn("__t", F.aggregate(clusters, zero, lambda t, x: F.struct(*[(t[k] + x[k]).alias(k) for k in parts])))
        n, sa, sb, aa, ab, st = (F.col(f"__t.{k}") for k in parts)
        return rows.withColumns({"rmse_gap": F.sqrt(sa / n) - F.sqrt(sb / n), "mae_gap": aa / n - ab / n, "skill_a": 1 - F.try_divide(sa, st), "skill_b": 1 - F.try_divide(sb, st)})

    values = ["rmse_gap", "mae_gap", "skill_a", "skill_b"]
    pick = lambda slot: F.get("__c", (portable_draw(F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"), slot.cast("string")) % F.col("n_clusters")).cast("int"))
    draws = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("__p", F.transform(F.sequence(F.lit(1), F.col("n_clusters").cast("int")), pick))
    draws, cells = added(draws, "__p"), added(cells, "__c")
    bounds = draws.groupBy(*by).agg(*[F.percentile(k, F.array(F.lit(0.025), F.lit(0.975))).alias(f"__q_{k}") for k in values])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("point"), F.col(f"__q_{k}").alias("q")) for k in values])).alias("x")
    few = F.col("n_clusters") < 2
    out = cells.join(bounds, by).select(*by, "n_clusters", rows)
    return out.select(*by, "x.statistic", "x.point", F.when(~few, F.col("x.q")[0]).alias("low"), F.when(~few, F.col("x.q")[1]).alias("high"), "n_clusters")


def skill_bias(pairs: DataFrame, by: list[str], actual: str, trend: str, *preds: str) -> DataFrame:
    y, t = F.col(actual), F.col(trend)
    out = []
    for p in preds:
        out += [(1 - F.try_divide(F.sum((y - F.col(p)) * (y - F.col(p))), F.sum((y - t) * (y - t)))).alias(f"skill_{p}"), F.avg(F.col(p) - y).alias(f"bias_{p}")]
    return pairs.groupBy(*by).agg(*out)


def verdict(low: Column, high: Column, p: Column, alpha: float = 0.05) -> Column:
    """What an interval of a - b (errors) and a p-value say together."""
    return F.when((low > 0) & (p < alpha), "B better").when((high < 0) & (p < alpha), "A better").when((low > 0) | (high < 0) | (p < alpha), "mixed").otherwise("no difference")


def verdicts(cells: DataFrame, by: list[str], low: str = "low", high: str = "high", p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Over cells: how many there are, how many intervals exclude 0 on either side, how many p are small, and each verdict's count."""
    what = verdict(F.col(low), F.col(high), F.col(p), alpha)
    names = {"a_better": "A better", "b_better": "B better", "mixed": "mixed", "no_difference": "no difference"}
    counts = [F.count_if(what == v).alias(k) for k, v in names.items()]
    return cells.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if((F.col(low) > 0) | (F.col(high) < 0)).alias("n_excludes_zero"), F.count_if(F.col(p) < alpha).alias("n_significant"), *counts)


def paired_overall(pairs: DataFrame, cell: list[str], run: str, a: str, b: str) -> DataFrame:
    """Per run means over the cells that are there in all runs, ready for paired_t or wilcoxon."""
    good = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = good.agg(F.count_distinct(run).alias("__n"))
    cells = good.groupBy(*cell).agg(F.count_distinct(run).alias("__k")).join(F.broadcast(total)).filter("__k = __n").select(*cell)  # one row
    return good.join(cells, cell, "left_semi").groupBy(run).agg(F.avg(a).alias(a), F.avg(b).alias(b))
