"""Monthly and daily series: calendars, lags, gaps, scaling, flood-season features, phase loops.

Series are keyed by station or product. Raw readings of any volume are first collapsed to one row
per key and month with a partial aggregate; windows then run over months, so a window partition is
as long as the calendar, not as the data. Frames over raw readings use chunks with a halo.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_spine, month_start, season_cos, season_sin, water_year
from ..functions.raster import finite
from .quantiles import exact_quantiles
from .sequence import trailing_frame

FLOOD_MONTHS = (3, 4, 5, 6, 7)
LAGS = (1, 2, 3, 4, 6, 9, 12)


def to_month_start(df: DataFrame, keys: list[str], values: list[str], date: str = "date", name: str = "month") -> DataFrame:
    """One row per key and month, duplicates averaged."""
    return df.groupBy(*keys, month_start(date).alias(name)).agg(*[F.avg(v).alias(v) for v in values])


def daily_to_monthly(df: DataFrame, keys: list[str], value: str, date: str = "date", min_days: int = 15) -> DataFrame:
    """Monthly mean where at least ``min_days`` observations exist, else null."""
    mean = F.when(F.count(value) >= min_days, F.avg(value))
    return df.groupBy(*keys, month_start(date).alias("month")).agg(mean.alias(value))


def annual_mean(df: DataFrame, keys: list[str], value: str, date: str = "month") -> DataFrame:
    return df.groupBy(*keys, F.year(date).alias("year")).agg(F.avg(value).alias(value))


def profile(df: DataFrame, keys: list[str], value: str, date: str) -> DataFrame:
    """Rows, missing values, full range of dates and the range with data."""
    seen = F.when(F.col(value).isNotNull(), F.col(date))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"),
        F.min(date).alias("first"), F.max(date).alias("last"),
        F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"),
    )


def on_month_spine(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Complete month range per key, gaps null."""
    return month_spine(df, keys, month).join(df, [*keys, month], "left")


def missing_months(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    return month_spine(df, keys, month).join(df, [*keys, month], "left_anti")


def lag_features(spine: DataFrame, keys: list[str], values: list[str], lags=LAGS, windows=(3, 6), month: str = "month") -> DataFrame:
    """Lags and lagged rolling means of every predictor on the month spine, with seasonality.

    A rolling mean needs half its window (rounded down) and never includes the current month.
    """
    order = Window.partitionBy(*keys).orderBy(month)
    made: dict[str, Column] = {}
    for v in values:
        for k in lags:
            made[f"{v}_lag{k}"] = F.lag(v, k).over(order)
        for n in windows:
            frame = order.rowsBetween(-n, -1)
            made[f"{v}_roll{n}m"] = F.when(F.count(v).over(frame) >= n // 2, F.avg(v).over(frame))
    out = spine.select(*keys, month, *[c.alias(n) for n, c in made.items()])
    m = F.month(month)
    out = out.withColumns({"month_sin": season_sin(m), "month_cos": season_cos(m)})
    return out


def centred_smooth(spine: DataFrame, keys: list[str], value: str, size: int = 3, reducer: str = "mean", month: str = "month") -> DataFrame:
    """Centred smoothing, null unless the whole window has data."""
    half = size // 2
    frame = Window.partitionBy(*keys).orderBy(month).rowsBetween(-half, size - 1 - half)
    mid = F.avg(value).over(frame) if reducer == "mean" else F.percentile(value, F.lit(0.5)).over(frame)
    return spine.withColumn("smooth", F.when(F.count(value).over(frame) == size, mid))


def trailing_mean(spine: DataFrame, keys: list[str], value: str, size: int, month: str = "month", min_count: int = 1) -> DataFrame:
    """Mean of the last ``size`` rows, null with fewer than ``min_count`` values among them."""
    frame = Window.partitionBy(*keys).orderBy(month).rowsBetween(-(size - 1), 0)
    return spine.withColumn("trailing", F.when(F.count(value).over(frame) >= min_count, F.avg(value).over(frame)))


def rolling_days(readings: DataFrame, keys: list[str], value: str, time: str, days: int = 30, min_count: int = 10) -> DataFrame:
    """Mean over ``(t - days, t]`` of raw readings, null below ``min_count`` of them.

    Readings are first summed per key and second, which bounds a window chunk by its seconds
    however many readings a key has; the result is joined back on (key, second).
    """
    timed = readings.withColumn("_s", F.unix_seconds(F.col(time).cast("timestamp")))
    sums = timed.groupBy(*keys, "_s").agg(F.sum(value).alias("_t"), F.count(value).alias("_n"))
    width = days * 86400
    out = trailing_frame(sums, keys, "_s", width, {"_wt": F.sum("_t"), "_wn": F.sum("_n")}, 2 * width)
    mean = F.when(F.col("_wn") >= min_count, F.col("_wt") / F.col("_wn"))
    return timed.join(out.select(*keys, "_s", mean.alias("rolling")), [*keys, "_s"], "left").drop("_s")


def step_change(df: DataFrame, keys: list[str], value: str, date: str = "month", max_days: int = 45) -> DataFrame:
    """Difference to the previous row, null when the step is longer than ``max_days``."""
    order = Window.partitionBy(*keys).orderBy(date)
    close = F.datediff(date, F.lag(date).over(order)) <= max_days
    return df.withColumn("change", F.when(close, F.col(value) - F.lag(value).over(order)))


def gap_lengths(spine: DataFrame, keys: list[str], value: str, month: str = "month") -> DataFrame:
    """Island number (running count of values) and the number of nulls in each island."""
    order = Window.partitionBy(*keys).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    marked = spine.withColumn("gap_id", F.count(value).over(order))
    size = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys, "gap_id"))
    return marked.withColumn("gap_length", size)


def gap_breaks(df: DataFrame, keys: list[str], value: str, date: str, max_days: int, at: str = "middle") -> DataFrame:
    """Insert a null row in every longer gap, in its middle or one day before its end.

    The rows are ``(keys, time, value, is_break)`` with ``time`` a timestamp.
    """
    order = Window.partitionBy(*keys).orderBy(date)
    stamp = F.col(date).cast("timestamp")
    rows = df.select(*keys, stamp.alias("time"), value, F.lag(stamp).over(order).alias("_prev"))
    gap = F.expr("unix_seconds(time) - unix_seconds(_prev)")
    if at == "middle":
        wide = F.floor(gap / 86400) > max_days
        where = F.timestamp_seconds(F.expr("unix_seconds(_prev)") + gap / 2)
    else:
        wide = gap > max_days * 86400
        where = F.expr("time - interval 1 day")
    null = F.lit(None).cast("double")
    breaks = rows.where(wide).select(*keys, where.alias("time"), null.alias(value), F.lit(True).alias("is_break"))
    return rows.select(*keys, "time", value, F.lit(False).alias("is_break")).unionByName(breaks)


def year_segments(df: DataFrame, keys: list[str], value: str, year: str = "year") -> DataFrame:
    """Number the runs of consecutive years that have a value."""
    order = Window.partitionBy(*keys).orderBy(year)
    rows = df.where(F.col(value).isNotNull()).withColumn("_k", F.col(year) - F.row_number().over(order))
    return rows.withColumn("segment", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_k"))).drop("_k")


def anomalies(df: DataFrame, keys: list[str], value: str, month: str = "month") -> DataFrame:
    """Value minus its calendar-month mean; the means are one small aggregate joined back."""
    tagged = df.withColumn("_m", F.month(month))
    means = tagged.groupBy(*keys, "_m").agg(F.avg(value).alias("_mean"))
    return tagged.join(means, [*keys, "_m"]).withColumn("anomaly", F.col(value) - F.col("_mean")).drop("_m", "_mean")


def min_max_scaled(df: DataFrame, keys: list[str], value: str, constant: float | None = 0.0) -> DataFrame:
    """Scale to 0..1 per key; a constant series gives ``constant`` (zero, or None for the raw form)."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if keys else None
    if keys:
        joined = df.join(ends, keys)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        one = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        joined, lo, hi = df, one["lo"], one["hi"]
    scaled = F.try_divide(F.col(value) - lo, hi - lo)
    if constant is not None:
        scaled = F.when(hi == lo, F.when(F.col(value).isNotNull(), F.lit(constant))).otherwise(scaled)
    return joined.withColumn("scaled", scaled).drop("_lo", "_hi")


def z_scored(df: DataFrame, keys: list[str], value: str, train: Column, epsilon: float = 1e-9) -> DataFrame:
    """z-score with the mean and population deviation of the training rows only."""
    part = F.when(train, F.col(value))
    stats = df.groupBy(*keys).agg(F.avg(part).alias("_m"), F.stddev_pop(part).alias("_s"))
    return df.join(stats, keys).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def exp_reservoir(series: DataFrame, keys: list[str], value: str, taus: list[float], month: str = "month", block: int = 64) -> DataFrame:
    """Exponential reservoir r = a x + (1 - a) r_before with nothing stored at the start, per tau.

    A key is cut into blocks of rows: arrays never exceed a block, or the list of block ends. The
    state entering a block decays into its rows in closed form.
    """
    order = Window.partitionBy(*keys).orderBy(month)
    past = Window.partitionBy(*keys, "_b").orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    a = 1 - F.exp(-1 / F.col("tau"))
    keep = F.exp(-1 / F.col("tau"))
    rows = series.withColumn("_k", F.row_number().over(order) - 1)
    rows = rows.withColumn("_b", F.floor(F.col("_k") / block)).withColumn("_xs", F.collect_list(F.coalesce(value, F.lit(0.0))).over(past))
    rows = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus])))
    rows = rows.withColumn("_r", F.aggregate("_xs", F.lit(0.0), lambda r, x: a * x + (1 - a) * r))
    ends = rows.groupBy(*keys, "tau", "_b").agg(F.max_by("_r", "_k").alias("_r"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys, "tau").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_es", F.collect_list(F.struct("_r", "_n")).over(before))
    carry = F.aggregate("_es", F.lit(0.0), lambda r, e: e["_r"] + r * F.pow(keep, e["_n"]))
    carried = ends.select(*keys, "tau", "_b", carry.alias("_carry"))
    out = rows.join(carried, [*keys, "tau", "_b"])
    step = F.col("_k") - F.col("_b") * block + 1
    return out.withColumn("reservoir", F.col("_r") + F.col("_carry") * F.pow(keep, step)).drop("_k", "_b", "_xs", "_r", "_carry")


def water_year_peaks(df: DataFrame, keys: list[str], value: str, start_month: int = 10, month: str = "month") -> DataFrame:
    seen = df.where(F.col(value).isNotNull())
    return seen.groupBy(*keys, water_year(month, start_month).alias("water_year")).agg(F.max(value).alias("peak"))


def arrival_months(
    df: DataFrame, keys: list[str], value: str, quantile: float = 0.4, months=FLOOD_MONTHS,
    fraction_of_peak: float | None = None, start_month: int = 10, month: str = "month",
) -> DataFrame:
    """First flood-season month of each water year above a level; years that never reach it drop out.

    The level is a quantile of the key's whole series, found without holding it in one buffer, or a fraction of the year's peak.
    """
    seen = df.where(F.col(value).isNotNull()).withColumn("water_year", water_year(month, start_month))
    if fraction_of_peak is None:
        level = exact_quantiles(seen, keys, value, {"_level": quantile})
        tagged = seen.join(level, keys)
    else:
        level = seen.groupBy(*keys, "water_year").agg((F.max(value) * fraction_of_peak).alias("_level"))
        tagged = seen.join(level, [*keys, "water_year"])
    hit = F.month(month).isin(*months) & (F.col(value) > F.col("_level"))
    return tagged.where(hit).groupBy(*keys, "water_year").agg(F.min(F.month(month)).alias("arrival_month"))


def preseason_features(features: DataFrame, keys: list[str], values: list[str], month: str = "month") -> DataFrame:
    """Mean and maximum of each predictor from October to the next March, per water year.

    A month of October..December belongs to the coming season, January..March to the running one;
    other months to none. No range join is needed.
    """
    m, y = F.month(month), F.year(month)
    season = F.when(m >= 10, y + 1).when(m <= 3, y)
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean_pre"), F.max(v).alias(f"{v}_max_pre")]
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return features.where(season.isNotNull() & some).groupBy(*keys, season.alias("water_year")).agg(*aggs)


def phase_loops(points: DataFrame, keys: list[str], x: str, y: str, order: str, normalize: bool = False) -> DataFrame:
    """Turning direction and circularity of the closed loop of each key (one loop is one season)."""
    ok = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(order).alias("_o"), finite(x).alias("_x"), finite(y).alias("_y")
    ).where("_x is not null and _y is not null")
    if normalize:
        ends = ok.groupBy(*keys).agg(*[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])
        scale = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}"))).otherwise(F.col(c))
        ok = ok.join(ends, keys).withColumns({"_x": scale("_x"), "_y": scale("_y")})
    w = Window.partitionBy(*keys).orderBy("_o")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    steps = ok.withColumns({"_nx": nxt("_x"), "_ny": nxt("_y")})
    sums = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        (F.sum(F.col("_x") * F.col("_ny") - F.col("_nx") * F.col("_y")) / 2).alias("area"),
        F.sum(F.hypot(F.col("_nx") - F.col("_x"), F.col("_ny") - F.col("_y"))).alias("perimeter"),
    )
    enough = F.col("points") >= 3
    turn = F.when(enough & (F.col("area") > 0), "CCW").when(enough & (F.col("area") < 0), "CW").otherwise("NA")
    ratio = F.least(F.lit(1.0), 4 * pi * F.abs("area") / (F.col("perimeter") * F.col("perimeter")))
    return sums.select(*keys, turn.alias("direction"), F.when(enough & (F.col("perimeter") > 0), ratio).alias("circularity"))


def correlation_matrix(wide: DataFrame, names: list[str], keys: list[str] = ()) -> DataFrame:
    """Pairwise-complete correlations in long form, rounded to two places; one aggregate."""
    pairs = [(a, b) for a in names for b in names]
    made = wide.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = made.unpivot(list(keys), [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(
        *keys, F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), F.round("r", 2).alias("r")
    )


def ensemble_median(products: DataFrame, value: str, month: str = "month", product: str = "dataset") -> DataFrame:
    """Median per product and month, then across products; products number a handful."""
    each = products.groupBy(month, product).agg(F.median(value).alias(value))
    return each.groupBy(month).agg(F.median(value).alias(value))


def product_ranking(products: DataFrame, value: str, product: str = "dataset") -> DataFrame:
    """Mean, annualised mean and spread per product, highest mean first."""
    return (
        products.groupBy(product)
        .agg(F.avg(value).alias("mean"), (F.avg(value) * 12).alias("per_year"), (F.max(value) - F.min(value)).alias("spread"))
        .orderBy(F.desc("mean"), product)
    )


def by_month_box(df: DataFrame, value: str, month: str = "month") -> DataFrame:
    """Quartiles and mean per calendar month (one value per year and month)."""
    by = df.withColumn("calendar_month", F.month(month))
    boxes = exact_quantiles(by, ["calendar_month"], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return by.groupBy("calendar_month").agg(F.avg(value).alias("mean")).join(boxes, "calendar_month", "left").select("calendar_month", "q1", "median", "q3", "mean")


def most_common(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per key, counted before anything is compared; ties take the smallest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label)))
    return counts.groupBy(*keys).agg(best.alias(label))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by an explicit order, as a partial aggregate instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def best_by_abs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Row with the largest magnitude per key."""
    return first_per_key(df.withColumn("_a", -F.abs(F.col(value))), keys, ["_a", *[c for c in df.columns if c not in keys]]).drop("_a")
