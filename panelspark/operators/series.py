"""Features of a season's series up to a cut day, as folds over arrays: one packed array a key and variable, aligned to the grid's days.

`pack` brings a key's observations together: one shuffle, with map-side sums by cell. Interpolation, areas, peaks and slopes then go day by day over the
arrays of a whole Arrow batch of keys, for any number of variables in the same pass; no window, layout or pivot follows. NULL, NaN and infinite values are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = ["mean", "max", "min", "std", "last", "auc", "peak_doy", "greenup", "early_mean", "last_slope"]
ANOMALY_STATS = ["mean", "max", "min", "last", "last_slope"]
#: The days between which the early rise is fitted.
SPRING = (60, 120)


def upto(df: DataFrame, cut: int, doy: str = "doy") -> DataFrame:
    """Only what is known by the cut; must come before any interpolation."""
    return df.filter(F.col(doy) <= cut)


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def days_of(grid: list[int]) -> Column:
    return F.array(*[F.lit(d) for d in grid])


def pack(obs: DataFrame, keys: list[str], grid: list[int], values: list[str], doy: str = "doy", digits: int | None = None) -> DataFrame:
    """A row a key, a column for each of `values`: its array over the grid; absent cells are NULL, repeated ones their mean, days off the grid are left out.

    digits: to which the means are rounded. Keys all of whose days are off the grid have arrays of NULL.
    """
    mean = lambda v, d: F.avg(F.when(F.col(doy) == d, finite(F.col(v).cast("double"))))
    cell = mean if digits is None else lambda v, d: F.round(mean(v, d), digits)
    return obs.groupBy(*keys).agg(*[F.array(*[cell(v, d) for d in grid]).alias(v) for v in dict.fromkeys(values)])


def unpack(packed: DataFrame, keys: list[str], grid: list[int], values: list[str], doy: str = "doy") -> DataFrame:
    """Long form: a row a key and day of the grid."""
    cells = F.arrays_zip(days_of(grid).alias("d"), *[F.col(v) for v in values])
    rows = packed.select(*keys, F.explode(cells).alias("__c"))
    return rows.select(*keys, F.col("__c.d").cast("bigint").alias(doy), *[F.col(f"__c.{v}").alias(v) for v in values])


def matrix(series: pa.ListArray, n: int) -> np.ndarray:
    """A row a series, a column a day of the grid; NaN where a value is missing or a series is too short."""
    out = np.full((len(series), n), np.nan)
    sizes = pc.fill_null(pc.list_value_length(series), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at < n
    out[row[inside], at[inside]] = series.flatten().cast("float64").to_numpy(zero_copy_only=False)[inside]
    out[~np.isfinite(out)] = np.nan
    return out


def between(x: np.ndarray, grid: list[int], edges: str = "null") -> np.ndarray:
    """Series along lines between their known points. edges: "null" leaves what isn't between two of them, "clamp" takes the nearest value."""
    n, d, known = x.shape[1], np.array(grid, float), ~np.isnan(x)
    a = np.maximum.accumulate(np.where(known, np.arange(n), 0), axis=1)
    b = np.minimum.accumulate(np.where(known, np.arange(n), n - 1)[:, ::-1], axis=1)[:, ::-1]
    before, after = np.take_along_axis(x, a, 1), np.take_along_axis(x, b, 1)  # NaN where no point is known on that side
    with np.errstate(all="ignore"):
        full = np.where(known, x, before + (after - before) * ((d - d[a]) / (d[b] - d[a])))
    return np.where(np.isnan(full), np.where(np.isnan(before), after, before), full) if edges == "clamp" else full


def interpolate(packed: DataFrame, values: list[str], grid: list[int], edges: str = "null", to: dict[str, str] | None = None) -> DataFrame:
    """Fills the gaps of every packed series by lines. to: other names for the results."""
    names, n = {v: (to or {}).get(v, v) for v in values}, len(grid)
    kind = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(f.name, kind) if f.name in names.values() else f for f in packed.schema] + [T.StructField(c, kind) for c in dict.fromkeys(names.values()) if c not in packed.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for v, name in names.items():
                full = between(matrix(batch.column(v), n), grid, edges)
                columns[name] = pa.ListArray.from_arrays(pa.array(np.arange(0, full.size + 1, n), pa.int32()), pa.array(full.ravel(), mask=np.isnan(full.ravel())))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return packed.mapInArrow(run, schema) if grid else packed.withColumns({name: F.array().cast(kind) for name in names.values()})


def stats(x: np.ndarray, grid: list[int]) -> dict[str, np.ndarray]:
    """The statistics of filled series, a row each, summed in the order of days; what isn't finite has no value."""
    known, empty = ~np.isnan(x), np.full(len(x), np.nan)
    n = known.sum(axis=1)

    def total(of, days=range(len(grid))) -> np.ndarray:
        sums = np.zeros(len(x))
        for i in days:
            sums = np.where(known[:, i], sums + of(i), sums)
        return sums

    def area() -> np.ndarray:
        sums, v, d = np.zeros(len(x)), empty, empty
        for i, day in enumerate(grid):
            sums = np.where(known[:, i] & ~np.isnan(v), sums + (x[:, i] + v) / 2 * (day - d), sums)
            v, d = np.where(known[:, i], x[:, i], v), np.where(known[:, i], day, d)
        return sums

    def rise() -> np.ndarray:
        spring, shift = [i for i, g in enumerate(grid) if SPRING[0] <= g <= SPRING[1]], sum(SPRING) / 2  # days are centred, so that squares cost no digits
        k = known[:, spring].sum(axis=1).astype(float)
        sx, sy = total(lambda i: grid[i] - shift, spring), total(lambda i: x[:, i], spring)
        sxx, sxy = total(lambda i: (grid[i] - shift) * (grid[i] - shift), spring), total(lambda i: (grid[i] - shift) * x[:, i], spring)
        return np.where(k >= 2, (k * sxy - sx * sy) / (k * sxx - sx * sx), np.nan)

    with np.errstate(all="ignore"):
        mean, early = total(lambda i: x[:, i]) / n, range(min(3, len(grid)))
        top = np.where(known, x, -np.inf).max(axis=1, initial=-np.inf)
        found = {
            "mean": mean,
            "max": top,
            "min": np.where(known, x, np.inf).min(axis=1, initial=np.inf),
            "std": np.sqrt(total(lambda i: (x[:, i] - mean) * (x[:, i] - mean)) / n),
            "last": x[:, -1],
            "auc": np.where(n >= 2, area(), np.nan),
            "peak_doy": np.where(n > 0, np.array(grid, float)[(x == top[:, None]).argmax(axis=1)], np.nan),
            "greenup": rise(),
            "early_mean": total(lambda i: x[:, i], early) / known[:, list(early)].sum(axis=1),
            "last_slope": (x[:, -1] - x[:, -2]) / (grid[-1] - grid[-2]) if len(grid) > 1 else empty,
        }
    return {k: np.where(np.isfinite(v), v, np.nan) for k, v in found.items()}


def season_features(packed: DataFrame, keys: list[str], values: list[str], grid: list[int], edges: str = "null", anomalies: dict[str, str] | None = None, cells: bool = True) -> DataFrame:
    """A row a key, for each variable `{v}_{stat}` of STATS and (cells) `{v}_DOY_{d}`; for each of `anomalies` (variable: packed column) `{v}_anom_{stat}`.

    `grid` holds the days up to the cut, to which the arrays are aligned. Columns named twice are built once.
    """
    names, odd, n = list(dict.fromkeys(values)), anomalies or {}, len(grid)
    wanted = [(v, v, STATS) for v in names] + [(c, f"{v}_anom", ANOMALY_STATS) for v, c in odd.items()]
    days = {f"DOY_{d}": i for i, d in enumerate(grid)} if cells else {}
    columns = {f"{to}_{s}": "int" if s == "peak_doy" else "double" for _, to, some in wanted for s in [*some, *(days if some is STATS else [])]}
    rows = packed.select(*keys, *dict.fromkeys([*names, *odd.values()]))
    schema = T.StructType([*rows.schema[: len(keys)], *[T.StructField(c, T.IntegerType() if kind == "int" else T.DoubleType()) for c, kind in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for column, to, some in wanted:
                full = between(matrix(batch.column(column), n), grid, edges)
                found = stats(full, grid)
                out |= {f"{to}_{s}": found[s] for s in some} | ({f"{to}_{c}": full[:, i] for c, i in days.items()} if some is STATS else {})
            arrays = [pa.array(out[c], from_pandas=True).cast("int32" if kind == "int" else "float64") for c, kind in columns.items()]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keys)] + arrays, keys + list(columns))

    return rows.mapInArrow(run, schema)


def build_features(obs: DataFrame, keys: list[str], values: list[str], grid: list[int], cut: int, doy: str = "doy", digits: int | None = None) -> DataFrame:
    """The features of every variable of a table of observations (a column each), from what is known by the cut."""
    days = [g for g in grid if g <= cut]
    return season_features(pack(upto(obs, cut, doy), keys, days, values, doy, digits), keys, values, days)


def fill_cube(pix: DataFrame, cell: list[str], band: str, value: str) -> DataFrame:
    """Missing values from the cell's median over time in that band, else the band's median, else 0."""
    from .quantiles import exact_quantiles

    own = F.median(value).over(Window.partitionBy(*cell, band))
    found = {k: v[0] for k, v in exact_quantiles(pix, band, value, [0.5]).items()}
    overall = F.try_element_at(F.create_map(*[F.lit(x) for kv in found.items() for x in kv]), F.col(band).cast("string")) if found else F.lit(None).cast("double")  # an entry a band
    return pix.withColumn("__own", own).withColumn(value, F.coalesce(value, "__own", overall, F.lit(0.0))).drop("__own")


def anomaly_features(df: DataFrame, keys: list[str], value: str, days: list[int], doy: str = "doy", to: str = "anom") -> DataFrame:
    """mean, max, min, last and last_slope of the anomaly series, gaps filled by lines; `days` are the grid days up to the cut."""
    packed = pack(df, keys, days, [value], doy)
    found = season_features(packed, keys, [], days, anomalies={value: value}, cells=False)
    return found.select(*keys, *[F.col(f"{value}_anom_{s}").alias(f"{to}_{s}") for s in ANOMALY_STATS])
