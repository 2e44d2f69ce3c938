"""Time-series operators: moving averages, exponential filters, climatologies, anomalies, rolling agreement.

Windows are time ranges in microseconds or seconds by location, dealt over stretches of time that overlap by the window's
reach, so a long series is many partitions' work; see `windows` for what is added up there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.moments import correlation, known
from ..functions.special import correlation_p
from .collocate import DAY_US, STRETCH, US, micros
from .ranks import medians
from .windows import window_moments, window_sums

MISSING = -999999.0


def present(c: str | Column, sentinel: float | None = MISSING) -> Column:
    """The value as double; null for NaN, infinities and the sentinel."""
    v = known(c)
    return v if sentinel is None else F.when(v != sentinel, v)


def _stretched(df: DataFrame, us: Column, reach: int) -> tuple[DataFrame, Column]:
    """df with each row in every stretch that its reach touches (__b), and whether it's at home there."""
    size = max(STRETCH * reach, DAY_US)
    home = F.floor(us / size)
    dealt = df.withColumn("__b", F.explode(F.sequence(F.floor((us - reach) / size), F.floor((us + reach) / size))))
    return dealt, F.col("__b") == home


def moving_average(
    df: DataFrame, value: str, window_days: float, fillna: bool = False, min_obs: int = 1, keys: list[str] | None = None, ts: str = "ts", out: str | None = None, sentinel: float | None = MISSING
) -> DataFrame:
    """df with the mean of the known values within window_days / 2 on either side (inclusive), in whole seconds.

    Null where the own value is missing, unless fillna, and where fewer than min_obs values are in the window.
    """
    keys = ["loc_id"] if keys is None else keys
    out = out or value
    us = F.floor(micros(ts) / US) * US
    half = round(window_days * DAY_US / 2)
    rows, home = _stretched(df.withColumn("__us", us).withColumn("__v", present(value, sentinel)), F.col("__us"), half)
    by = [*keys, "__b"]
    sums = {"__n": F.col("__v").isNotNull().cast("int"), "__sum": F.col("__v")}
    found = window_sums(rows.repartition(*by), by, "__us", sums, home, -half, half)
    mean = F.when((F.col("__n") >= min_obs) & (F.col("__n") > 0), F.col("__sum") / F.col("__n"))
    found = found.withColumn("__m", mean if fillna else F.when(F.col("__v").isNotNull(), mean))
    return found.withColumn(out, F.col("__m")).select(*dict.fromkeys([*df.columns, out]))


def exponential_filter(df: DataFrame, value: str, ctime_days: float, keys: list[str] | None = None, ts: str = "ts", out: str | None = None) -> DataFrame:
    """The recursive exponential filter with characteristic time ctime_days; missing values stay missing and are skipped.

    By its closed form, the filter is the mean of earlier values weighted with exp(-age / ctime). Each row's weights are
    anchored at its stretch's start; the sums of the stretch before are carried over by a small window over the stretches'
    totals, so a series isn't one task. Weights under exp(-700) count as zero.
    """
    keys = ["loc_id"] if keys is None else keys
    out = out or value
    tau = ctime_days * DAY_US
    size = max(DAY_US, int(256 * tau))
    rows = df.withColumn("__us", micros(ts)).withColumn("__v", present(value)).withColumn("__b", F.floor(F.col("__us") / size))
    age = (F.col("__us") - F.col("__b") * size) / tau  # 0 to 256: its exponential is finite
    w = F.when(F.col("__v").isNotNull(), F.exp(age))
    rows = rows.withColumn("__w", w).withColumn("__wv", F.col("__w") * F.col("__v"))
    totals = rows.groupBy(*keys, "__b").agg(F.sum("__w").alias("__tw"), F.sum("__wv").alias("__twv"))
    last_known = Window.partitionBy(*keys).orderBy("__b")
    # a stretch is 256 characteristic times long: of what came before, only the last stretch with values can weigh anything
    older = totals.select(*keys, "__b", F.lag(F.when(F.col("__tw").isNotNull(), F.struct("__b", "__tw", "__twv")), 1).over(last_known).alias("__x"))
    older = older.select(*keys, "__b", F.last("__x", ignorenulls=True).over(last_known).alias("__x"))
    decay = F.exp(-F.least(F.lit(700.0), (F.col("__b") - F.col("__x.__b")) * float(size / tau)))
    older = older.select(*keys, "__b", (F.col("__x.__tw") * decay).alias("__pw"), (F.col("__x.__twv") * decay).alias("__pwv"))
    running = Window.partitionBy(*keys, "__b").orderBy("__us").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sw", F.sum("__w").over(running)).withColumn("__swv", F.sum("__wv").over(running)).join(older, [*keys, "__b"], "left")
    zero = F.lit(0.0)
    top, bottom = F.coalesce("__swv", zero) + F.coalesce("__pwv", zero), F.coalesce("__sw", zero) + F.coalesce("__pw", zero)
    return rows.withColumn("__y", F.when(F.col("__v").isNotNull(), top / F.nullif(bottom, zero))).withColumn(out, F.col("__y")).select(*dict.fromkeys([*df.columns, out]))


def climatology(
    df: DataFrame,
    value: str,
    moving_avg_orig: float | None = 5,
    moving_avg_clim: float | None = None,
    statistic: str = "mean",
    std: bool = False,
    timespan: tuple[str, str] | None = None,
    fill: float | None = None,
    wraparound: bool = True,
    respect_leap_years: bool = False,
    interpolate_leapday: bool = False,
    fillna: bool = True,
    min_obs_orig: int = 1,
    min_obs_clim: int = 1,
    output_freq: str = "day",
    keys: list[str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """(keys, slot, climatology[, climatology_std]) for each of the 366 days or 12 months of a year.

    The series is smoothed (moving_avg_orig days, inclusive of both ends of the window), grouped by slot with its mean or
    median, and the slots are smoothed around the turn of the year (35 days or 3 months by default). Days are numbered as in
    leap years, or with respect_leap_years as they fall. `fill` stands in slots that stay empty.
    """
    keys = ["loc_id"] if keys is None else keys
    if output_freq not in ("day", "month"):
        raise ValueError(f"no such frequency: {output_freq}")
    n = 366 if output_freq == "day" else 12
    width = moving_avg_clim if moving_avg_clim is not None else (35 if n == 366 else 3)
    rows = df.filter(F.col(ts).between(*(F.lit(x).cast("timestamp_ntz") for x in timespan))) if timespan else df
    if moving_avg_orig:
        rows = moving_average(rows, value, moving_avg_orig, fillna, min_obs_orig, keys, ts)
    slot = F.month(ts) if n == 12 else (F.dayofyear(ts) if respect_leap_years else cal.leap_doy(F.col(ts)))
    v = present(value)
    rows = rows.withColumn("slot", slot)
    stats = rows.groupBy(*keys, "slot").agg(F.avg(v).alias("climatology"), *([F.stddev_samp(v).alias("climatology_std")] if std else []))
    if statistic == "median":
        stats = stats.drop("climatology").join(medians(rows, v, [*keys, "slot"], "climatology"), [*keys, "slot"])
    slots = rows.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    full = slots.join(stats, [*keys, "slot"], "left")
    half = width / 2 if width else 0
    names = ["climatology", *(["climatology_std"] if std else [])]
    if width:
        turns = F.explode(F.array(F.lit(-n), F.lit(0), F.lit(n))) if wraparound else F.explode(F.array(F.lit(0)))
        around = full.withColumn("__t", turns).withColumn("__at", F.col("slot") + F.col("__t"))
        near = Window.partitionBy(*keys).orderBy("__at").rangeBetween(-int(half), int(half))  # slots are whole: the window's edge rounds down
        for c in names[:1]:
            mean = F.when(F.count(c).over(near) >= min_obs_clim, F.avg(c).over(near))
            around = around.withColumn(f"__{c}", mean if fillna else F.when(F.col(c).isNotNull(), mean))
        full = around.filter("__t = 0").withColumn("climatology", F.col("__climatology")).drop("__t", "__at", "__climatology")
    if interpolate_leapday and n == 366:
        at, a, b = (366, 365, 1) if respect_leap_years else (60, 59, 61)
        mean = F.avg(F.when(F.col("slot").isin(a, b), F.col("climatology"))).over(Window.partitionBy(*keys))
        full = full.withColumn("climatology", F.when(F.col("slot") == at, mean).otherwise(F.col("climatology")))
    if fill is not None:
        full = full.na.fill(fill, names)
    return full.select(*keys, "slot", *names)


def anomaly(df: DataFrame, value: str, window_size: float = 35, clim: DataFrame | None = None, respect_leap_years: bool = True, monthly: bool = False, return_clim: bool = False, keys: list[str] | None = None, ts: str = "ts", out: str | None = None) -> DataFrame:
    """df with the value's distance from its moving average, or from a climatology(keys, slot, climatology)."""
    keys = ["loc_id"] if keys is None else keys
    out = out or value
    if clim is None:
        smooth = moving_average(df, value, window_size, keys=keys, ts=ts, out="__smooth")
        return smooth.withColumn(out, present(value) - F.col("__smooth")).drop("__smooth")
    slot = F.month(ts) if monthly else (F.dayofyear(ts) if respect_leap_years else cal.leap_doy(F.col(ts)))
    found = df.withColumn("slot", slot).join(clim, [*keys, "slot"], "left").drop("slot")
    found = found.withColumn(out, present(value) - F.col("climatology"))
    return found if return_clim else found.drop("climatology")


def rolling_agreement(df: DataFrame, x: str, y: str, window_days: float, center: bool = True, min_periods: int = 2, keys: list[str] | None = None, ts: str = "ts", with_p: bool = True) -> DataFrame:
    """For every complete row, R (and its p-value) and RMSD over [t - w, t + w] if centred, else over (t - w, t].

    Null with fewer than min_periods rows in the window, R also where a variance is zero.
    """
    keys = ["loc_id"] if keys is None else keys
    w = round(window_days * DAY_US)
    full = df.withColumn("__us", micros(ts)).withColumn("__x", known(x)).withColumn("__y", known(y)).filter("__x is not null and __y is not null")
    rows, home = _stretched(full, F.col("__us"), w)
    by = [*keys, "__b"]
    rows = window_moments(rows.repartition(*by), by, "__us", F.col("__x"), F.col("__y"), home, *((-w, w) if center else (-(w - 1), 0)))
    enough = F.col("__n") >= min_periods
    r = F.when(enough, correlation(*(F.col(f"__{c}") for c in ("vx", "vy", "cxy"))))
    out = rows.select(*keys, ts, F.col("__n").alias("n_obs"), r.alias("R"), F.when(enough, F.sqrt("__msd")).alias("RMSD"))
    return out.withColumn("p_R", correlation_p(F.col("R"), F.col("n_obs").cast("double"))) if with_p else out


def by_day_bins(df: DataFrame, aggregates: list[Column], bins: tuple[int, ...] = (1, 11, 21, 32), start: bool = False, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Aggregates by parts of months; a part is named by its last day, or by its first with start."""
    keys = ["loc_id"] if keys is None else keys
    return df.groupBy(*keys, cal.bin_label(F.col(ts), bins, start).alias("label")).agg(*aggregates)
