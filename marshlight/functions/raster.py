"""Per-pixel projections: masks, reflectance, indices, unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .calendar import _col, days_in_month, dekad_days, seconds_in_month

# Pixel sizes in km².
PIXEL_30M_KM2 = 0.0009
TEN_M_PER_30M = 9.0

# Quality-flag bits that mark cloud, per sensor.
CLOUD_BITS = {"ten_metre": (10, 11), "thirty_metre": (1, 2, 3, 4)}

# Native flux unit -> mm per step. Keys name the conversion, not a product.
MM_RULES = ("tenth_mm", "flux_mm_per_s", "negative_metres", "hundredth_per_8day", "tenth_mm_per_dekad", "mm")


def finite(value) -> Column:
    """The value where it is an ordinary number; null for NaN and both infinities."""
    x = _col(value).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN would poison Spark averages; every ingest path turns it into NULL."""
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names})


def mask_where(value, keep) -> Column:
    return F.when(_col(keep), _col(value))


def fill_masked(value, filler: float = 0.0) -> Column:
    return F.coalesce(_col(value), F.lit(filler))


def self_mask(value) -> Column:
    """Zero counts as no data."""
    return F.nullif(_col(value), F.lit(0))


def complete(*names: str) -> Column:
    """True where every named column is present."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def transition_code(before, after) -> Column:
    """Two class codes as one number: tens before, units after."""
    return _col(before) * 10 + _col(after)


def wet_from_class(cls) -> Column:
    return (_col(cls) > 0).cast("double")


def asset_field(asset_id, position: int) -> Column:
    """Field of an underscore-separated asset id; negative positions count from the end."""
    return F.element_at(F.split(_col(asset_id), "_"), position)


def clear_sky(qa, sensor: str, saturation=None) -> Column:
    """No cloud bit set and, where the sensor reports it, no saturated band."""
    bits = sum(1 << b for b in CLOUD_BITS[sensor])
    ok = _col(qa).bitwiseAND(F.lit(bits)) == 0
    return ok if saturation is None else ok & (_col(saturation) == 0)


def reflectance(dn, sensor: str) -> Column:
    if sensor == "ten_metre":
        return _col(dn) / 10000.0
    return _col(dn) * 2.75e-5 - 0.2


def normalized_difference(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.try_divide(a - b, a + b)


def screen_fill(value, low: float = -1e10, high: float = 1e15) -> Column:
    v = _col(value)
    return F.when(v.between(low, high), v)


def first_usable(*values) -> Column:
    """First variable that survives the fill screen, in the given order of preference."""
    return F.coalesce(*[screen_fill(v) for v in values])


def to_mm(value, step_start, rule: str) -> Column:
    """Native flux to millimetres per step."""
    v = _col(value)
    if rule == "tenth_mm":
        return v * 0.1
    if rule == "flux_mm_per_s":
        return v * seconds_in_month(step_start)
    if rule == "negative_metres":
        return v * -1000.0
    if rule == "hundredth_per_8day":
        return v * 0.01 * 8
    if rule == "tenth_mm_per_dekad":
        return v * 0.1 * dekad_days(step_start)
    if rule == "mm":
        return v
    raise ValueError(f"unknown rule {rule!r}")


def to_mm_by_rule(value, step_start, rule) -> Column:
    """The same with the rule in a column, for a union of products with mixed units."""
    out = F.lit(None).cast("double")
    for name in MM_RULES:
        out = F.when(_col(rule) == name, to_mm(value, step_start, name)).otherwise(out)
    return out


def pixels_to_km2(count, pixel: str = "30m") -> Column:
    """Pixel counts to km²; ten-metre counts are brought to the thirty-metre grid first."""
    n = _col(count)
    return (n / TEN_M_PER_30M if pixel == "10m" else n) * PIXEL_30M_KM2


def flow_to_km3(q_m3s, month) -> Column:
    return _col(q_m3s) * days_in_month(month) * 86400 / 1e9


def km3_to_mm(km3, area_km2) -> Column:
    area = _col(area_km2) if isinstance(area_km2, (str, Column)) else F.lit(float(area_km2))
    return _col(km3) * 1e9 / (area * 1e6) * 1000


def km2_change_from_log_slope(base_km2, slope) -> Column:
    return (1 + _col(base_km2)) * F.expm1(_col(slope))


def drop_trailing_zeros(
    df: DataFrame, product: str, tiny: float = 1e-6,
    dataset: str = "dataset", date: str = "date", value: str = "value",
) -> DataFrame:
    """Null the zero padding of one product: tiny values, and all after its last real month."""
    last = df.where((F.col(dataset) == product) & (F.col(value) > tiny)).agg(F.max(date)).scalar()
    bad = (F.col(dataset) == product) & ((F.col(value) <= tiny) | (F.col(date) > last))
    return df.withColumn("was_padding", F.coalesce(bad & F.col(value).isNotNull(), F.lit(False))).withColumn(
        value, F.when(~F.coalesce(bad, F.lit(False)), F.col(value))
    )


def infer_wet(
    grid: DataFrame, value: str = "value", time: str = "time",
    threshold: float | None = None,
) -> DataFrame:
    """Add ``wet``, reading the meaning of the numbers from the first snapshot that has data.

    Small values of an integer column are classes (1..4 wet); fractions (minimum 0..1, maximum up
    to 1.5) use ``threshold`` (0.5); other data count as wet wherever present. The verdict is one scalar subquery over one snapshot.
    """
    seen = grid.where(F.col(value).isNotNull())
    first = seen.agg(F.min(time)).scalar()
    span = seen.where(F.col(time) == first).agg(
        F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ).scalar()
    v = F.col(value)
    fraction = span["lo"].between(0, 1) & span["hi"].between(0, 1.5)
    rule = F.when(fraction, v > (0.5 if threshold is None else threshold)).otherwise(v.isNotNull())
    if isinstance(grid.schema[value].dataType, IntegralType):
        rule = F.when(span["hi"] <= 5, v.isin(1, 2, 3, 4)).otherwise(rule)
    return grid.withColumn("wet", F.coalesce(rule, F.lit(False)))
