"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from panelspark.plans import further, more, registry  # noqa: F401  (both add to the registry)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    """Rows as sorted text, numbers to five digits."""

    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
            return str(float(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if":
            return f"{float(x):.4f}".replace("-0.0000", "0.0000")
        return str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)

    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    differing = [p for p in zip(plain(got), plain(want)) if p[0] != p[1]]
    assert len(differing) <= len(got) // 500, differing[:3]  # digits at the edge of rounding


def test_class_counts_of_missing_classes_and_keys(spark, tmp_path):
    """NULL classes are classes, and rows without a key are drawn last, as in the SQL; keys don't repeat here, so it leaves nothing open."""
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT CASE WHEN i % 13 = 0 THEN NULL ELSE i END::BIGINT AS l_orderkey, 1::INTEGER AS l_linenumber, [NULL, 'F', 'O'][i % 3 + 1]::VARCHAR AS l_linestatus,
        CASE WHEN i % 100 < 3 THEN NULL WHEN i % 5 = 0 THEN 'A' ELSE 'N' END AS l_returnflag FROM range(3000) r(i)) TO '{tmp_path}/lineitem.parquet'""")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got, want = registry.QUERIES["class_counts"](spark, str(tmp_path)).toPandas(), c.execute(registry.ORACLE_SQL["class_counts"]).df()
    assert len(want) == 9 and want.n_sampled.min() > 0 and plain(got) == plain(want)


def test_class_counts_repeat(spark):
    """Rows that share a key are drawn in the same order, however they come."""
    from panelspark.operators import metrics, windows

    rows = [(str(k), "A", s) for k in range(20) for s in "FO"]
    for some in (rows, rows[::-1]):
        li = spark.createDataFrame(some, "key string, flag string, status string").coalesce(1)
        for n in (3, 8, 11):
            got = metrics.class_counts(li, ["status"], "flag", windows.balanced_sample(li, "flag", "key", n, 7, ["status"])).collect()
            assert {r.status: (r.n, r.n_sampled) for r in got} == {"F": (20, (n + 1) // 2), "O": (20, n // 2)}


def test_models_give_whole_results(spark):
    share = registry.QUERIES["gbt_importance"](spark, SF).toPandas().set_index("feature")
    assert len(share) == 4 and share.share.sum() == pytest.approx(1) and share.share["constant"] == 0 == share.n_splits["constant"]
    assert set(registry.QUERIES["swept_runs"](spark, SF).toPandas().seed) == {1, 2, 3}
    curve = registry.QUERIES["tree_count_sweep"](spark, SF).toPandas()
    assert sorted(curve.trees) == [5, 10, 15, 20] and curve.n.nunique() == 1
    p = registry.QUERIES["test_pvalues"](spark, SF).toPandas()
    assert all(p[c].dropna().between(0, 1).all() for c in ("p_t", "p_dm", "p_ja", "p_jb", "p_w"))


def test_classified_pixels(spark):
    """All pixels of every tile and checkpoint that can be trained, and no others."""
    status = registry.QUERIES["cell_status"](spark, SF).toPandas().set_index(["tile", "checkpoint"]).status
    assert {"TRAINED", "INSUFFICIENT_SAMPLES"} <= set(status)
    got = registry.QUERIES["classified_pixels"](spark, SF).toPandas()
    sizes = further.tiles(spark, SF).groupBy("tile").count().toPandas().set_index("tile")["count"]
    want = {c: sizes[c[0]] for c, s in status.items() if s in ("TRAINED", "LOW_DATE_COUNT")}
    assert got.groupby(["tile", "checkpoint"]).size().to_dict() == want and got.confidence.between(0, 1).all()
    truth = further.tiles(spark, SF).select("cell", ((further.F.col("l_quantity") > 25)).alias("truth")).toPandas().drop_duplicates("cell", keep=False)
    late = got[got.checkpoint == "late"].merge(truth, on="cell")
    assert (late.is_class == late.truth).mean() > 0.95


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
