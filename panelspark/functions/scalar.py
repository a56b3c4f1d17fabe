"""Scalar column functions: calendar, features' names, vegetation indices, weather, scores of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import as_col

#: The checkpoints of a season, every 16 days.
GRID = list(range(65, 274, 16))
MONTH_STARTS = {"JUNE": 7, "JULY": 8, "AUGUST": 9}
PIXEL_KM2 = 0.0009


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where b is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def doy_to_date(year: Column | str, doy: Column | str) -> Column:
    return F.date_add(F.make_date(as_col(year), F.lit(1), F.lit(1)), as_col(doy).cast("int") - 1)


def day_label(date: Column | str) -> Column:
    return F.date_format(as_col(date), "MMM dd")


def mask_month(doy: Column | str, cuts: tuple[tuple[int, str], ...] = ((209, "JUNE"), (241, "JULY")), last: str = "AUGUST") -> Column:
    """The month whose map serves a checkpoint: the first cut that the day doesn't pass."""
    d = as_col(doy)
    out = F.lit(last)
    for cut, month in reversed(cuts):
        out = F.when(d <= cut, F.lit(month)).otherwise(out)
    return out


def permitted(year: Column | str, doy: Column | str, month: Column | str, declared: Column | str) -> Column:
    """Whether a map may be used: not before the first day after its month, nor before it was declared available."""
    y, m = as_col(year), as_col(month)
    free = F.coalesce(*[F.when(m == k, F.make_date(y, F.lit(v), F.lit(1))) for k, v in MONTH_STARTS.items()])
    return doy_to_date(y, doy) >= F.greatest(free, as_col(declared).cast("date"))


def state_of(fips: Column | str) -> Column:
    return F.substring(as_col(fips), 1, 2)


def doy_label(doy: Column | str) -> Column:
    return F.lpad(as_col(doy).cast("string"), 3, "0")


#: Prefixes of feature names and their groups; the first that fits counts, others are vegetation.
FEATURE_GROUPS = (("hist_yield_trend", "trend"), ("year", "year"), ("recent", "weather"), ("season", "weather"), ("AWC", "awc"), ("CEC", "cec"))


def feature_group(name: Column | str) -> Column:
    n = as_col(name)
    out = F.when(n.contains("anom"), "anomaly").otherwise(F.lit("vegetation"))
    for prefix, group in reversed(FEATURE_GROUPS):
        out = F.when(n.startswith(prefix), group).otherwise(out)
    return out


def feature_label(name: Column | str, names: dict[str, str] | None = None) -> Column:
    """A display name: from the table given, else with spaces for underscores."""
    plain = F.replace(as_col(name), F.lit("_"), F.lit(" "))
    if not names:
        return plain
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, as_col(name)), plain)


def errors(actual: str, predicted: str) -> dict[str, Column]:
    """residual (actual - predicted), signed_error (predicted - actual), absolute, squared and percentage error, relative difference."""
    a, p = F.col(actual), F.col(predicted)
    return {"residual": a - p, "signed_error": p - a, "abs_error": F.abs(a - p), "sq_error": (a - p) * (a - p), "pct_error": 100 * F.try_divide(F.abs(a - p), F.abs(a)), "rel_diff": F.try_divide(F.abs(a - p), F.greatest(F.abs(a), F.abs(p)))}


def veg_indices(blue: str = "blue", green: str = "green", red: str = "red", nir: str = "nir", swir: str = "swir1") -> dict[str, Column]:
    """Vegetation indices from reflectances."""
    b, g, r, n, s = map(F.col, (blue, green, red, nir, swir))
    ndvi = F.try_divide(n - r, n + r)
    return {"NDVI": ndvi, "EVI2": 2.5 * F.try_divide(n - r, n + 2.4 * r + 1), "NDMI": F.try_divide(n - s, n + s), "NDWI": F.try_divide(g - n, g + n), "GCI": F.try_divide(n, g) - 1, "NIRv": n * ndvi}


def pixel_indices(green: str, red: str, nir: str) -> dict[str, Column]:
    """NDVI and NDWI of digital numbers (reflectance x 10000), with 1e-8 in the denominators."""
    g, r, n = (F.col(c) / 10000.0 for c in (green, red, nir))
    return {"ndvi": (n - r) / (n + r + 1e-8), "ndwi": (g - n) / (g + n + 1e-8)}


def qa_ok(qa: Column | str) -> Column:
    """Bits 0-1 are 0 or 3; bits 2, 10 and 12 are 0."""
    q = as_col(qa).cast("int")
    bit = lambda k: F.shiftright(q, k).bitwiseAND(F.lit(1)) == 0
    return q.bitwiseAND(F.lit(3)).isin(0, 3) & bit(2) & bit(10) & bit(12)


def scl_ok(scl: Column | str, *bands: str, bad: tuple[int, ...] = (0, 1, 3, 8, 9, 10, 11)) -> Column:
    """The scene class isn't among the bad ones and all bands have data."""
    ok = ~as_col(scl).isin(*bad)
    for b in bands:
        ok = ok & F.col(b).isNotNull() & (F.col(b) != -32768)
    return ok


def refl_ok(*bands: str) -> Column:
    ok = F.lit(True)
    for b in bands:
        ok = ok & (F.col(b) > 0) & (F.col(b) <= 1)
    return ok


def encode_refl(dn: Column | str, scale: Column, offset: Column) -> Column:
    """Reflectance x 10000, rounded, within 16 bits."""
    return F.least(F.greatest(F.rint((as_col(dn) * scale + offset) * 10000), F.lit(-32767.0)), F.lit(32767.0)).cast("int")


def daily_weather(tmax: str = "tmax", ppt: str = "ppt", vpdmin: str = "vpdmin", vpdmax: str = "vpdmax") -> dict[str, Column]:
    return {"vpdmean": (F.col(vpdmin) + F.col(vpdmax)) / 2, "heat30": F.greatest(F.col(tmax) - 30, F.lit(0.0)), "hot35": (F.col(tmax) >= 35).cast("int"), "dryday": (F.col(ppt) < 1).cast("int")}


def period_end(start: Column | str, days: int) -> Column:
    """The day after a period: it ends with its year at the latest."""
    s = as_col(start)
    return F.least(F.date_add(s, days), F.make_date(F.year(s) + 1, F.lit(1), F.lit(1)))


def confusion_scores(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    """Scores of a confusion matrix; those without a denominator are NULL. F1 is 0 if there are only errors."""
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    recall, spec = ratio(a, a + c), ratio(d, d + b)
    return {
        "precision": ratio(a, a + b),
        "recall": recall,
        "f1": ratio(2 * a, 2 * a + b + c),
        "iou": ratio(a, a + b + c),
        "accuracy": ratio(a + d, a + b + c + d),
        "specificity": spec,
        "balanced_accuracy": (recall + spec) / 2,
        "mcc": F.try_divide(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c))),
        "omission": ratio(c, a + c),
        "commission": ratio(b, a + b),
        "area_bias_pct": 100 * ratio(b - c, a + c),
        "area_km2": (a + b) * PIXEL_KM2,
        "reference_km2": (a + c) * PIXEL_KM2,
        "n": a + b + c + d,
    }


def agreement_scores(both: str, only_a: str, only_b: str, neither: str) -> dict[str, Column]:
    a, b, c, d = (F.col(x).cast("double") for x in (both, only_a, only_b, neither))
    return {"agreement": ratio(a + d, a + b + c + d), "dice": ratio(2 * a, 2 * a + b + c), "iou": ratio(a, a + b + c), "disagreement_km2": (b + c) * PIXEL_KM2, "only_a_km2": b * PIXEL_KM2, "only_b_km2": c * PIXEL_KM2}


def tile_id(item: Column | str, *fields: Column | str) -> Column:
    """The first field that is there, else what the item's id says."""
    found = F.regexp_extract(as_col(item), r"_T?([0-9]{2}[A-Z]{3})(?:_|$)", 1)
    return F.coalesce(*map(as_col, fields), F.when(found != "", found))


def config_hash(*cols: str) -> Column:
    """A digest of a configuration, its fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def count_status(valid: Column | str, reference: Column | str) -> Column:
    return F.when(as_col(valid) == 0, "NO_VALID_PIXELS").when(as_col(reference) == 0, "NO_REFERENCE_CORN").otherwise("OK")


def better(a: Column | str, b: Column | str, metric: str, name_a: str = "A", name_b: str = "B") -> Column:
    """Which is better; of errors the smaller one."""
    x, y = as_col(a), as_col(b)
    if metric in ("rmse", "mae", "mape"):
        x, y = y, x
    return F.when(x > y, name_a).when(x < y, name_b).when(x == y, "tie")


def yield_anomaly(actual: Column | str, baseline: Column | str) -> Column:
    return as_col(actual) - as_col(baseline)


def yield_from_anomaly(anomaly: Column | str, baseline: Column | str) -> Column:
    return as_col(anomaly) + as_col(baseline)


def band(mean: str, sd: str) -> dict[str, Column]:
    s = F.coalesce(F.col(sd), F.lit(0.0))
    return {"low": F.col(mean) - s, "high": F.col(mean) + s}


def gain_reproduced(gain: Column | str, oracle: Column | str, least: float = 0.002) -> Column:
    return F.when(F.abs(as_col(oracle)) > least, 100 * as_col(gain) / as_col(oracle))
