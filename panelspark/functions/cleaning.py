"""Column functions that clean ids, numbers, times and flags. All give NULL where a value can't be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_fips(c: Column | str) -> Column:
    """A five-digit county id: trimmed, '.0' dropped, zero-padded; state 00, county 000 and anything else are NULL."""
    s = F.regexp_replace(F.trim(as_col(c).cast("string")), r"\.0*$", "")
    p = F.lpad(s, 5, "0")
    return F.when(s.rlike(r"^[0-9]{1,5}$") & ~p.startswith("00") & ~p.endswith("000"), p)


def clean_fips_lenient(c: Column | str) -> Column:
    """The id without one trailing '.0', padded to five; not checked, and never cut."""
    s = F.regexp_replace(as_col(c).cast("string"), r"\.0$", "")
    return F.when(F.length(s) >= 5, s).otherwise(F.lpad(s, 5, "0"))


def fips_from_parts(state: Column | str, county: Column | str) -> Column:
    """An id from numeric codes: whole numbers, states 1-56, counties 1-998."""
    s, c = num(state), num(county)
    ok = (s % 1 == 0) & (c % 1 == 0) & s.between(1, 56) & c.between(1, 998)
    return F.when(ok, F.concat(F.lpad(s.cast("int").cast("string"), 2, "0"), F.lpad(c.cast("int").cast("string"), 3, "0")))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = as_col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def num(c: Column | str) -> Column:
    """A double; what isn't a finite number is NULL."""
    return finite(F.trim(as_col(c).cast("string")).try_cast("double"))


def num_us(c: Column | str) -> Column:
    """A double from text with thousands separators."""
    return num(F.regexp_replace(as_col(c).cast("string"), ",", ""))


def utc_naive(c: Column | str) -> Column:
    """An ISO timestamp as UTC without a zone (the session's zone must be UTC)."""
    return F.try_to_timestamp(as_col(c).cast("string")).cast("timestamp_ntz")


def flag(c: Column | str) -> Column:
    """true, 1 and 1.0 are true, whatever their case."""
    return F.coalesce(F.lower(F.trim(as_col(c).cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def coalesce_cols(*cols: Column | str) -> Column:
    return F.coalesce(*map(as_col, cols))


def apply_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Renames vendor columns where the target is absent."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def find_col(df: DataFrame, prefix: str, doy: int) -> str | None:
    """The column of a prefix and day, in any case, the day padded or not."""
    names = {c.lower(): c for c in df.columns}
    return next((names[n] for d in (f"{doy:03d}", str(doy)) if (n := f"{prefix}_doy_{d}".lower()) in names), None)


def scale_indices(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Multiplies columns by declared factors, which must be finite and positive."""
    for k, v in scales.items():
        if not 0 < v < INF:
            raise ValueError(f"scale of {k} must be finite and positive")
    return df.withColumns({k: F.col(k) * F.lit(float(v)) for k, v in scales.items()})


#: The range that each index may have.
INDEX_RANGES = {"NDVI": (-1, 1), "EVI_scaled": (-0.2, 1), "EVI2": (-2.5, 2.5), "NDMI": (-1, 1), "NDWI": (-1, 1), "NIRv": (-1, 1), "GCI": (-1, None)}


def check_ranges(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]], tolerance: float = 1e-6) -> DataFrame:
    """One row: for each column how many values are outside its range."""

    def out(c: str, low, high) -> Column:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low - tolerance)
        if high is not None:
            bad = bad | (F.col(c) > high + tolerance)
        return F.count_if(bad).alias(f"{c}_outside")

    return df.agg(*[out(c, *b) for c, b in bounds.items()])


def autoscale(df: DataFrame, c: str, limit: float = 2.0, factor: float = 1e-4) -> DataFrame:
    """If the 95th percentile of |c| is over the limit all values are scaled; then what is outside [-1, 1] is NULL."""
    from panelspark.operators.quantiles import exact_quantiles

    q = exact_quantiles(df.select(F.lit("q").alias("k"), F.abs(c).alias("v")), "k", "v", [0.95]).get("q", [0.0])[0]
    x = F.col(c) * factor if q > limit else F.col(c)
    return df.withColumn(c, x).withColumn(c, F.when(F.col(c).between(-1, 1), F.col(c)))


def drop_bad_fips(df: DataFrame, c: str, name: str = "bad_ids") -> DataFrame:
    """Cleans the id and drops rows without one; the count is observed under `name`."""
    cleaned = df.withColumn(c, clean_fips(c))
    return cleaned.observe(name, F.count_if(F.col(c).isNull()).alias("dropped")).filter(F.col(c).isNotNull())


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all there, as whole numbers."""
    return df.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).withColumns({k: F.col(k).cast("int") for k in keys})


def survey_rows(df: DataFrame, program: str = "Program") -> DataFrame:
    """SURVEY rows where a program column exists, else all; a program column without any SURVEY row is an error."""
    name = next((c for c in df.columns if c.strip().lower() == program.lower()), None)
    if not name:
        return df
    rows = df.filter(F.upper(F.trim(F.col(name))) == "SURVEY")
    if rows.isEmpty():
        raise ValueError(f"no row of {name} is SURVEY")
    return rows


def yield_filter(df: DataFrame) -> DataFrame:
    """County corn grain yields of whole years, totals only, without pooled counties."""
    same = {"Geo Level": "COUNTY", "Commodity": "CORN", "Period": "YEAR", "Domain": "TOTAL"}
    rows = df.filter(reduce(Column.__and__, [F.upper(F.trim(F.col(f"`{k}`"))) == v for k, v in same.items()]))
    rows = rows.filter(F.upper(F.col("`Data Item`")).contains("GRAIN") & F.upper(F.col("`Data Item`")).contains("YIELD"))
    return rows.filter(F.col("`State ANSI`").isNotNull() & F.col("`County ANSI`").isNotNull() & ~F.upper(F.coalesce(F.col("County"), F.lit(""))).rlike("OTHER.*COUNTIES"))


def cols_upto(df: DataFrame, prefix: str, doy: int) -> list[str]:
    """Wide columns `{prefix}_DOY_{d}` with d <= doy, in the order of days."""
    found = [(int(c.rsplit("_", 1)[1]), c) for c in df.columns if c.startswith(f"{prefix}_DOY_") and c.rsplit("_", 1)[1].isdigit()]
    return [c for d, c in sorted(found) if d <= doy]


def feature_cols(df: DataFrame, leak: tuple[str, ...]) -> list[str]:
    """Numeric and boolean columns but those that would leak the target."""
    kinds = {"int", "bigint", "double", "float", "boolean", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if c not in leak and (t in kinds or t.startswith("decimal"))]


def eligible_rows(panel: DataFrame, obs: DataFrame, weather: DataFrame, keys: list[str], doy: int, indices: list[str], conditions: list[str], needed: list[str]) -> DataFrame:
    """Rows of the panel that a model may use at a checkpoint.

    They have all of `needed` (yield, trend, anomaly), some finite index up to the day, and some finite weather value at the day, by the same keys.
    """
    some = lambda cols: reduce(Column.__or__, [finite(c).isNotNull() for c in cols])
    seen = obs.filter((F.col("doy") <= doy) & some(indices)).select(*keys).distinct()
    felt = weather.filter((F.col("doy") == doy) & some(conditions)).select(*keys).distinct()
    rows = panel.filter(reduce(Column.__and__, [finite(c).isNotNull() for c in needed]))
    return rows.join(seen, keys, "left_semi").join(felt, keys, "left_semi")


def known_scenarios(df: DataFrame, labels: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rows of the scenarios that the table of labels names, with their labels; strict: any other scenario is an error."""
    if strict and not df.select(*keys).distinct().join(labels, keys, "left_anti").isEmpty():
        raise ValueError("a scenario isn't among the labels")
    return df.join(labels, keys)


def scenario(df: DataFrame, train: str, test: str, train_col: str = "train_mask", test_col: str = "test_mask") -> DataFrame:
    """The slice of one pair of training and test mask."""
    return df.filter((F.col(train_col) == train) & (F.col(test_col) == test))


def filter_model_rows(df: DataFrame, target: str, baseline: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull() & F.col(baseline).isNotNull())


def require_positive(df: DataFrame, c: str) -> DataFrame:
    """One row: how many values aren't positive."""
    return df.agg(F.count_if(F.coalesce(F.col(c) <= 0, F.lit(True))).alias("not_positive"))


def drop_nodata(pix: DataFrame, codes: list[int], c: str = "class") -> DataFrame:
    """Leaves out codes that stand for no data; a valid zero stays."""
    return pix.filter(F.col(c).isNotNull() & ~F.col(c).isin(codes))


def binarize(pix: DataFrame, code: int, c: str = "class", to: str = "is_class") -> DataFrame:
    return pix.withColumn(to, (F.col(c) == code))


def select_as(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names, no others."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def time_split(df: DataFrame, year: int, c: str = "year") -> tuple[DataFrame, DataFrame]:
    """Rows before the year, and those of it."""
    return df.filter(F.col(c) < year), df.filter(F.col(c) == year)


def slice_options(rec: DataFrame, chosen: dict[str, object], selectors: list[str]) -> DataFrame:
    """selector, value: what is still there to choose for each further selector."""
    rows = rec.filter(reduce(Column.__and__, [F.col(k) == v for k, v in chosen.items()], F.lit(True)))
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("selector"), F.col(s).cast("string").alias("value")) for s in selectors]))
    return rows.select(pairs.alias("x")).select("x.*").distinct()
