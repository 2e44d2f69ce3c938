"""Temporal collocation: as-of joins of series onto a reference's time stamps, by location.

All forms are one shuffle: reference and other rows are put together, dealt by location and by stretches of time, and read
in order of time by window functions. A stretch is much longer than the tolerance, and rows near its edges are in both
stretches, so one location's series, however long, is many partitions' work. Times are compared in microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import window_sums

US = 1_000_000
DAY_US = 86_400 * US
#: A stretch of time is so many tolerances long, and at least one day.
STRETCH = 32
#: The length of a stretch where no tolerance gives one.
UNLIMITED_STRETCH_US = 32 * DAY_US


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970, of a naive or zoned time stamp (naive ones count as UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def window_us(window: timedelta | float) -> int:
    """A tolerance in microseconds; numbers are days."""
    return round(window.total_seconds() * US) if isinstance(window, timedelta) else round(window * DAY_US)


def first_per_stamp(df: DataFrame, keys: list[str], ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """One row for each key and time stamp: the first by the tie columns (Spark tables have no order of their own)."""
    others = [c for c in df.columns if c not in (*keys, ts)]
    if not others:
        return df.distinct()
    order = F.struct(*(tie or others))
    best = df.groupBy(*keys, ts).agg(F.min_by(F.struct(*others), order).alias("__first"))
    return best.select(*keys, ts, *(F.col(f"__first.{c}").alias(c) for c in others)).select(*df.columns)


@dataclass
class Other:
    """A series to be matched: its frame, value columns, and the prefix of its result columns."""

    df: DataFrame
    values: list[str]
    prefix: str = ""
    valid: str | None = None  # a SQL predicate: rows that may match
    use_invalid: bool = False  # fall back on invalid rows


def stretches(us: Column, size: int, around: int) -> Column:
    return F.explode(F.sequence(F.floor((us - around) / size), F.floor((us + around) / size)))


def _both_ways(partition: list[str]):
    """Frames of the rows up to the present one, in order of time and in the reverse order.

    A frame that runs to the partition's end would be added up anew for every row; one that begins at its start isn't.
    """
    by = Window.partitionBy(*partition)
    return tuple(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in ((F.col("__us"), F.col("__kind")), (F.col("__us").desc(), F.col("__kind").desc())))


def nearest(
    reference: DataFrame,
    others: list[Other] | Other,
    window: timedelta | float,
    keys: list[str] | None = None,
    ts: str = "ts",
    tie: list[str] | None = None,
    return_index: bool = False,
    return_distance: bool = False,
    dropna: str | None = None,
    bounds: str = "both",
) -> DataFrame:
    """Reference rows, each with the nearest row of every other series within the window (inclusive), else nulls.

    Of two equally near rows the later one counts; of rows with one time stamp the first by `tie`. A row matches even if its
    values are null. dropna: None, "any" or "all" over the others' values. bounds: "both", "<=" (others before the reference
    by less than the window, or after it by at most the window) or ">=" (the reverse).
    """
    keys = ["loc_id"] if keys is None else keys
    others = [others] if isinstance(others, Other) else others
    tolerance = window_us(window)
    size = max(STRETCH * tolerance, DAY_US)
    ref_cols = reference.columns
    lead = [F.col(c) for c in tie or []]
    ref = reference.withColumn("__us", micros(ts)).withColumn("__b", F.floor(F.col("__us") / size))
    found = ref.select(*keys, "__us", "__b", F.lit(-1).alias("__series"), F.lit(1).alias("__kind"), F.struct(*ref_cols).alias("__ref"), F.struct(*(c for c in (*lead, *ref_cols))).alias("__r"))
    names = []
    if bounds not in ("both", "<=", ">="):
        raise ValueError(f"no such bounds: {bounds}")
    for k, o in enumerate(others):
        versions = [("v", o.valid)] + ([("i", f"not coalesce({o.valid}, false)")] if o.valid and o.use_invalid else [])
        for tag, predicate in versions:
            name = f"__{tag}{k}"
            rows = (o.df.filter(predicate) if predicate else o.df).withColumn("__us", micros(ts)).filter("__us is not null")
            rows = rows.withColumn("__b", stretches(F.col("__us"), size, tolerance))
            rows = rows.select(*keys, "__us", "__b", F.lit(len(names)).alias("__series"), F.lit(0).alias("__kind"), F.struct("__us", ts, *o.values).alias(name), *([F.struct(*lead).alias(f"{name}t")] if lead else []))
            found = found.unionByName(rows, allowMissingColumns=True)
            names.append(name)
    # one exchange: the windows' keys all begin with these columns
    found = found.repartition(*keys, "__b")
    order = [c for n in names for c in ([f"{n}t", n] if lead else [n])]
    copies = F.row_number().over(Window.partitionBy(*keys, "__b", "__series", "__us").orderBy("__r", *order))
    found = found.withColumn("__copy", copies).filter("__copy = 1").drop("__copy", "__series", "__r", *(c for c in order if c.endswith("t") and c not in names))
    before, after = _both_ways([*keys, "__b"])
    found = found.select("*", *(F.last(n, ignorenulls=True).over(before).alias(f"{n}p") for n in names), *(F.last(n, ignorenulls=True).over(after).alias(f"{n}f") for n in names))
    found = found.filter("__kind = 1")

    def chosen(n: str) -> Column:
        p, f = F.col(f"{n}p"), F.col(f"{n}f")
        dp, df_ = F.col("__us") - p["__us"], f["__us"] - F.col("__us")
        low = dp < tolerance if bounds == "<=" else dp <= tolerance
        high = df_ < tolerance if bounds == ">=" else df_ <= tolerance
        p, f = F.when(low, p), F.when(high, f)
        return F.when(f.isNull(), p).when(p.isNull(), f).when(df_ <= dp, f).otherwise(p)

    found = found.select("__ref", "__us", *(chosen(n).alias(n) for n in names))
    out, values = [F.col(f"__ref.{c}").alias(c) for c in ref_cols], []
    for k, o in enumerate(others):
        v, i = F.col(f"__v{k}"), F.col(f"__i{k}") if f"__i{k}" in names else None
        for c in o.values:
            out.append((F.coalesce(v[c], i[c]) if i is not None else v[c]).alias(o.prefix + c))
            values.append(o.prefix + c)
        if return_index or return_distance:
            out.append((F.coalesce(v[ts], i[ts]) if i is not None else v[ts]).alias(f"{o.prefix}index_other"))
        if return_distance:
            at = F.coalesce(v["__us"], i["__us"]) if i is not None else v["__us"]
            out.append(((at - F.col("__us")) / DAY_US).alias(f"{o.prefix}distance_other"))
    matched = found.select(*out)
    return matched.dropna(dropna, subset=values) if dropna else matched


def windowed_mean(
    reference: DataFrame, other: DataFrame, values: list[str], window: timedelta | float, keys: list[str] | None = None, ts: str = "ts", prefix: str = "", dropna: str | None = None, valid: str | None = None
) -> DataFrame:
    """Reference rows, each with the mean of the other's known values in [t - window, t + window]; null where there is none."""
    keys = ["loc_id"] if keys is None else keys
    w = window_us(window)
    size = max(STRETCH * w, DAY_US)
    ref = reference.withColumn("__us", micros(ts)).withColumn("__b", F.floor(F.col("__us") / size))
    ref = ref.select(*keys, "__us", "__b", F.struct(*reference.columns).alias("__ref"))
    rows = (other.filter(valid) if valid else other).select(*keys, micros(ts).alias("__us"), *(F.col(c).cast("double").alias(f"__{c}") for c in values))
    rows = rows.filter("__us is not null").withColumn("__b", stretches(F.col("__us"), size, w))
    by = [*keys, "__b"]
    both = ref.unionByName(rows, allowMissingColumns=True).repartition(*keys, "__b")
    first = F.row_number().over(Window.partitionBy(*keys, "__b", "__us", F.col("__ref").isNull()).orderBy("__ref"))
    both = both.withColumn("__copy", F.when(F.col("__ref").isNotNull(), first).otherwise(1)).filter("__copy = 1")
    present = {c: F.nanvl(f"__{c}", F.lit(None).cast("double")) for c in values}
    sums = {f"__n_{c}": v.isNotNull().cast("int") for c, v in present.items()} | {f"__s_{c}": v for c, v in present.items()}
    both = window_sums(both, by, "__us", sums, F.col("__ref").isNotNull(), -w, w)
    both = both.select("__ref", *((F.col(f"__s_{c}") / F.nullif(f"__n_{c}", F.lit(0.0))).alias(prefix + c) for c in values))
    matched = both.select("__ref.*", *(prefix + c for c in values))
    return matched.dropna(dropna, subset=[prefix + c for c in values]) if dropna else matched


def resample_mean(reference: DataFrame, other: DataFrame, values: list[str], full_window: timedelta | float, **kw) -> DataFrame:
    """windowed_mean with the full width of the window."""
    half = full_window / 2
    return windowed_mean(reference, other, values, half, **kw)


def combined(reference: DataFrame, others: dict[str, tuple[DataFrame, list[str]]], window: timedelta | float, keys: list[str] | None = None, ts: str = "ts", method: str = "nearest", combined_dropna: str | bool = False, add_ref_data: bool = True, ref_values: list[str] | None = None) -> DataFrame:
    """All others matched to the reference at once: one column `name__value` for each.

    combined_dropna: False keeps every reference stamp; "any" or True keeps complete rows; "all" drops rows without anything.
    """
    keys = ["loc_id"] if keys is None else keys
    ref_values = [c for c in reference.columns if c not in (*keys, ts)] if ref_values is None else ref_values
    base = reference.select(*keys, ts, *ref_values)
    if method == "nearest":
        found = nearest(base, [Other(df, values, f"{name}__") for name, (df, values) in others.items()], window, keys, ts)
    elif method == "mean":
        found = base
        for name, (df, values) in others.items():
            found = windowed_mean(found, df, values, window, keys, ts, f"{name}__")
    else:
        raise ValueError(f"no such method: {method}")
    if not add_ref_data:
        found = found.drop(*ref_values)
    if combined_dropna:
        found = found.dropna("all" if combined_dropna == "all" else "any", subset=[c for c in found.columns if c not in (*keys, ts)])
    return found


def unlimited_nearest(reference: DataFrame, other: DataFrame, values: list[str], window: float | None = None, bounds: str = "both", keys: list[str] | None = None, ts: str = "ts", dropduplicates: bool = False) -> DataFrame:
    """The nearest row of other however far away, its time (`index`) and signed distance in days.

    Values of rows further than the window are null; bounds "<=" or ">=" makes the window half open. With dropduplicates an
    other row stays matched only to the reference row that is nearest to it.

    Rows are dealt by location and stretch of time. Where a stretch has no row before or after, the last one of the stretches
    before, or the first one of those after, is the neighbour: they come from a table with a row for each stretch.
    """
    keys = ["loc_id"] if keys is None else keys
    stretch = F.coalesce(F.floor(F.col("__us") / UNLIMITED_STRETCH_US), F.lit(0))
    ref = reference.withColumn("__us", micros(ts)).select(*keys, "__us", F.struct(*reference.columns).alias("__ref"), F.lit(1).alias("__kind"))
    rows = first_per_stamp(other.select(*keys, ts, *values), keys, ts).withColumn("__us", micros(ts)).select(*keys, "__us", F.struct("__us", ts, *values).alias("__o"), F.lit(0).alias("__kind"))
    both = ref.unionByName(rows, allowMissingColumns=True).withColumn("__b", stretch)
    ends = both.groupBy(*keys, "__b").agg(F.min("__o").alias("__lo"), F.max("__o").alias("__hi"))
    past = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__b", F.last("__hi", True).over(past).alias("__p"), F.last("__lo", True).over(coming).alias("__f"))
    before, after = _both_ways([*keys, "__b"])
    both = both.select("*", F.last("__o", True).over(before).alias("p"), F.last("__o", True).over(after).alias("f")).filter("__kind = 1").join(ends, [*keys, "__b"])
    p, f, us = F.coalesce("p", "__p"), F.coalesce("f", "__f"), F.col("__us")
    best = F.when(f.isNull(), p).when(p.isNull(), f).when(f["__us"] - us <= us - p["__us"], f).otherwise(p)
    both = both.select(*keys, "__ref", us, best.alias("__o")).withColumn("__d", F.col("__o.__us") - us)
    if dropduplicates:
        # the row that another row keeps, by partial minima: many rows of the reference may want the same one
        mine = F.struct(F.abs("__d").alias("d"), us.alias("us"), "__ref")
        first = both.filter("__o is not null").groupBy(*keys, F.col("__o.__us").alias("__at")).agg(F.min(mine).alias("__first"))
        first = first.select(*keys, "__at", F.col("__first.us").alias("__us"), F.col("__first.__ref").alias("__winner"))
        both = both.join(first, [*keys, "__us"], "left")
        won = (F.col("__at") == F.col("__o.__us")) & F.col("__winner").eqNullSafe(F.col("__ref"))
        both = both.withColumn("__o", F.when(won, F.col("__o"))).withColumn("__d", F.col("__o.__us") - us)
    near = F.lit(True)
    if window is not None:
        w = window_us(window)
        d = F.col("__d")
        near = {"both": F.abs(d) <= w, "<=": (d > -w) & (d <= w), ">=": (d >= -w) & (d < w)}[bounds]
    return both.select("__ref.*", *(F.when(near, F.col(f"__o.{c}")).alias(f"{c}" if c not in reference.columns else f"{c}_other") for c in values), F.when(near, F.col(f"__o.{ts}")).alias("index"), F.when(near, F.col("__d") / DAY_US).alias("distance"))


def matching(reference: DataFrame, others: dict[str, tuple[DataFrame, list[str]]], window: float | None = None, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Reference rows that have their nearest row in every other series, each other row used once; columns `name__value`."""
    keys = ["loc_id"] if keys is None else keys
    out = reference
    for name, (df, values) in others.items():
        renamed = df.select(*keys, ts, *(F.col(c).alias(f"{name}__{c}") for c in values))
        names = [f"{name}__{c}" for c in values]
        got = unlimited_nearest(reference.select(*keys, ts).distinct(), renamed, names, window, keys=keys, ts=ts, dropduplicates=True)
        out = out.join(got.dropna("any", subset=names).select(*keys, ts, *names), [*keys, ts])
    return out
