"""Bias correction: scaling series to a reference by moments, regression, extrema or distributions, by location.

Parameters are one row for each location from a groupBy with partial sums; they are joined back. CDF matching needs values at
some places in sorted order: locations are whole in a task, many in one call, but for very frequent ones. These are split over
tasks (see `splits`); only the regressions of their end bins take the rows of these bins into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import known
from ..sources.results import table_at
from .shared import kept, whole_groups
from .splits import Split, join_split, parted, values_at, weighted

PERCENTILES = (0, 5, 10, 30, 50, 70, 90, 95, 100)


def moment_parameters(df: DataFrame, src: str, ref: str, keys: list[str]) -> DataFrame:
    """One row for each key: extrema, means, deviations, slope and intercept of the regression of ref on src."""
    x, y = known(src), known(ref)
    both = x.isNotNull() & y.isNotNull()
    bx, by = F.when(both, x), F.when(both, y)
    found = df.groupBy(*keys).agg(
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_pop(x).alias("std_x"), F.stddev_pop(y).alias("std_y"),
        F.covar_pop(bx, by).alias("cxy"), F.var_pop(bx).alias("vx"), F.avg(bx).alias("bx"), F.avg(by).alias("by"),
    )
    slope = F.col("cxy") / F.nullif(F.col("vx"), F.lit(0.0))
    return found.withColumn("slope", slope).withColumn("intercept", F.col("by") - F.col("slope") * F.col("bx"))


#: name -> expression of the value and a parameter's column.
MOMENT_METHODS: dict[str, Callable[[Column, Callable[[str], Column]], Column]] = {
    "min_max": lambda x, p: (x - p("min_x")) / F.nullif(p("max_x") - p("min_x"), F.lit(0.0)) * (p("max_y") - p("min_y")) + p("min_y"),
    "mean_std": lambda x, p: (x - p("mean_x")) / F.nullif(p("std_x"), F.lit(0.0)) * p("std_y") + p("mean_y"),
    # the slope's size only, as is usual for this operator
    "linreg": lambda x, p: F.abs(p("slope")) * x + p("intercept"),
}


def scaled(df: DataFrame, src: str, ref: str, method: str, keys: list[str] | None = None, out: str | None = None, **kw) -> DataFrame:
    """df with src scaled to ref, as column `out` (default: src itself). Constant series give null. Unknown methods raise KeyError."""
    keys = ["loc_id"] if keys is None else keys
    out = out or src
    if method in ("cdf_match", "cdf_beta_match"):
        return cdf_match(df, src, ref, keys, out, **kw)
    function = MOMENT_METHODS[method]
    stats = moment_parameters(df, src, ref, keys)
    # one struct column holds the parameters, so that df's own names can't clash with theirs
    stats = stats.select(*keys, F.struct(*(c for c in stats.columns if c not in keys)).alias("__s"))
    value = function(known(src), lambda name: F.col(f"__s.{name}"))
    return df.join(stats, keys, "left").select(*(c for c in df.columns if c != out), value.alias(out))


def scaled_all(df: DataFrame, columns: list[str], ref: str, method: str, keys: list[str], **kw) -> DataFrame:
    """df with all the columns scaled to ref at once: all parameters come from one pass and are one row for each key."""
    if method in ("cdf_match", "cdf_beta_match"):
        kw = {"nbins": 100, "minobs": 20, "linear_edge_scaling": True} | kw
        limits = {k: kw.pop(k, None) for k in ("max_val", "min_val")}
        df = kept(df)  # its values are read for the parameters and again to be carried over
        sides = F.explode(F.array(*(F.struct(F.lit(i).alias("__i"), known(c).alias("__c")) for i, c in enumerate(columns))))
        long = df.select(*keys, known(ref).alias("__r"), sides.alias("__s")).select(*keys, "__r", "__s.*")
        params = kept(cdf_parameters(long, "__c", "__r", [*keys, "__i"], **kw))
        for i, c in enumerate(columns):
            df = apply_parameters(df, params.filter(F.col("__i") == i).drop("__i"), c, keys, **limits, most=_edges_for(kw["nbins"], kw.get("percentiles")))
        return df
    function = MOMENT_METHODS[method]
    pairs = [F.struct(F.lit(i).alias("__i"), known(c).alias("__c")) for i, c in enumerate(columns)]
    long = df.select(*keys, known(ref).alias("__r"), F.explode(F.array(*pairs)).alias("__s")).select(*keys, "__r", "__s.*")
    stats = moment_parameters(long, "__c", "__r", [*keys, "__i"])
    one = F.struct(*(c for c in stats.columns if c not in (*keys, "__i")))
    stats = stats.groupBy(*keys).agg(*(F.first(F.when(F.col("__i") == i, one), True).alias(f"__s{i}") for i in range(len(columns))))
    values = {c: function(known(c), lambda name, i=i: F.col(f"__s{i}.{name}")) for i, c in enumerate(columns)}
    return df.join(stats, keys, "left").select(*(values[c].alias(c) if c in values else F.col(c) for c in df.columns))


def linreg_stored(df: DataFrame, src: str, slope: str, intercept: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or src, F.abs(F.col(slope)) * known(src) + F.col(intercept))


def scale(df: DataFrame, columns: list[str], method: str, reference: str, keys: list[str] | None = None, **kw) -> DataFrame:
    """Every column but the reference scaled to it, one after another."""
    for c in columns:
        if c != reference:
            df = scaled(df, c, reference, method, keys, **kw)
    return df


def add_scaled(df: DataFrame, src: str, ref: str, method: str = "linreg", keys: list[str] | None = None, **kw) -> DataFrame:
    return scaled(df, src, ref, method, keys, f"{src}_scaled_{method}", **kw)


# ---- distributions ----


def bins_for(n: Column, nbins: int = 100, percentiles=None, minobs: int | None = None) -> Column:
    """The percentiles for n values: as given unless the narrowest bin would hold fewer than minobs; then equal ones."""
    p = _given(nbins, percentiles)
    given = F.expr(f"array({', '.join(f'{v!r}D' for v in p.tolist())})")
    if minobs is None:
        return given
    bins = F.greatest(F.lit(1), F.least(F.floor(n / minobs), F.lit(len(p) - 1))).cast("int")
    equal = F.transform(F.sequence(F.lit(0), bins), lambda i: F.when(i == bins, 100.0).otherwise(i * (F.lit(100.0) / bins)))
    return F.when(n * float(np.diff(p).min()) / 100 < minobs, equal).otherwise(given)


def _given(nbins: int, percentiles) -> np.ndarray:
    return np.linspace(0, 100, nbins + 1) if percentiles is None else np.asarray(percentiles, float)


def _edges_for(nbins: int, percentiles) -> int:
    """The most edges that a key may get."""
    return max(2, len(_given(nbins, percentiles)))


def bins_of(n: int, given: np.ndarray, minobs: int | None) -> np.ndarray:
    """bins_for() of one number."""
    if minobs is None or n * float(np.diff(given).min()) / 100 >= minobs:
        return given
    bins = max(1, min(n // minobs, len(given) - 1))
    return np.append(np.arange(bins) * (100.0 / bins), 100.0)


def hazen(runs: np.ndarray, weights: np.ndarray, percentiles: np.ndarray) -> np.ndarray:
    """Values at percentiles by plotting positions 100 (i + 0.5) / n, constant beyond the first and last one; each of the
    rising runs occurs as often as its weight says."""
    ends = np.cumsum(weights)
    n = int(ends[-1])
    at = np.clip(np.asarray(percentiles) / 100 * n - 0.5, 0, n - 1)
    low = np.floor(at).astype(np.int64)
    a, b = (runs[np.searchsorted(ends, np.minimum(k, n - 1), side="right")] for k in (low, low + 1))
    return a + (at - low) * (b - a)


def line(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Piecewise linear through (x, y), going on straight beyond both ends. x is strictly increasing."""
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    return y[k] + (at - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])


def untied(values: np.ndarray, percentiles: np.ndarray) -> np.ndarray:
    """Equal values at several percentiles are spread: the first of each value stays, the last value moves to the last percentile."""
    first = np.flatnonzero(np.r_[True, np.diff(values) > 0])
    if len(first) in (1, len(values)):
        return values
    knots = percentiles[first].astype(float)
    knots[-1] = percentiles[-1]
    return line(knots, values[first], percentiles)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _spread(values: pd.Series, percentiles: pd.Series) -> pd.Series:
    """untied() of a key's few percentile values."""
    return pd.Series([untied(np.asarray(v, float), np.asarray(p, float)) if v is not None and len(v) else v for v, p in zip(values, percentiles, strict=True)])


def edge_slope(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Slope through the origin of y on x, both rising runs of values, coupled rank by rank; where they aren't equally many, x is
    first brought to y's number by its own distribution."""
    if not len(x) or not len(y):
        return 0.0
    n = int(wy.sum())
    if int(wx.sum()) != n:
        p = np.linspace(0, 100, n) if n > 1 else np.array([0.0])
        x, wx = untied(hazen(x, wx, p), p), np.ones(n, np.int64)
    ex, ey = np.cumsum(wx), np.cumsum(wy)
    ends = np.union1d(ex, ey)
    starts = np.r_[0, ends[:-1]]
    a, b, w = x[np.searchsorted(ex, starts, side="right")], y[np.searchsorted(ey, starts, side="right")], ends - starts
    square = float((w * a * a).sum())
    return float((w * a * b).sum()) / square if square else 0.0


def fitted(x: np.ndarray, y: np.ndarray, given: np.ndarray, minobs: int | None, combine_invalid: bool, linear_edge_scaling: bool) -> tuple[np.ndarray, np.ndarray]:
    """cdf_parameters() of one key's rows, where NaN is a missing value."""
    full = ~(np.isnan(x) | np.isnan(y))
    (vx, wx), (vy, wy) = (np.unique(v[full if combine_invalid else ~np.isnan(v)], return_counts=True) for v in (x, y))
    nx, ny = int(wx.sum()), int(wy.sum())
    if not nx or not ny:
        return np.zeros(0), np.zeros(0)
    p = bins_of(min(nx, ny), given, minobs)
    px, py = untied(hazen(vx, wx, p), p), untied(hazen(vy, wy, p), p)
    if linear_edge_scaling and len(p) > 2:
        low, high = (vx <= px[1], vy <= py[1]), (vx >= px[-2], vy >= py[-2])
        first, last = (edge_slope(vx[a] - px[k], wx[a], vy[b] - py[k], wy[b]) for k, (a, b) in ((1, low), (-2, high)))
        py = py.copy()
        py[0], py[-1] = py[1] + first * (px[0] - px[1]), py[-2] + last * (px[-1] - px[-2])
    elif linear_edge_scaling and len(p) == 2 and nx == ny:
        px, py = np.array([0.0, 1.0]), np.full(2, np.nan)
        if full.any():
            # from the first value on, so that equal ones have no variance at all
            dx, my = x[full] - x[full][0], float(y[full].mean())
            mx, square = float(dx.mean()), float(dx.var())
            b = float(((dx - mx) * (y[full] - my)).mean()) / square if square else np.nan
            start = my - b * (mx + float(x[full][0]))
            py = np.array([start, start + b])
    return px, py


def _whole_parameters(rows: DataFrame, keys: list[str], *how) -> DataFrame:
    """(keys, x_perc, y_perc) of rows (keys, __x, __y) that are in order of their keys, each key whole in a task."""
    edges = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("x_perc", edges), T.StructField("y_perc", edges)])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first in whole_groups(batches, keys):
            x, y = (part.column(c).to_numpy() for c in ("__x", "__y"))
            found = [fitted(x[a:b], y[a:b], *how) for a, b in zip(first, np.r_[first[1:], len(x)], strict=True)]
            out = part.select(keys).take(first)
            for name, column in zip(("x_perc", "y_perc"), zip(*found, strict=True), strict=True):
                out = out.append_column(name, pa.array(column, pa.list_(pa.float64())))
            yield from out.to_batches()

    return rows.mapInArrow(fit, schema)


def _positions(sizes: DataFrame, percentiles: Column) -> DataFrame:
    """sizes(..., __n) with a row for each percentile (__k, __p) and for the one or two sorted places that its value lies between."""
    wanted = sizes.select("*", F.posexplode(percentiles).alias("__k", "__p"))
    at = F.greatest(F.lit(0.0), F.least(F.col("__p") / 100 * F.col("__n") - 0.5, F.col("__n") - 1.0))
    wanted = wanted.withColumn("__at", at).withColumn("__low", F.floor("__at"))
    return wanted.withColumn("__pos", F.explode(F.array_distinct(F.array(F.col("__low"), F.least(F.col("__low") + 1, F.col("__n") - 1)))))


def _percentile_values(split: Split, wanted: DataFrame, value: str) -> DataFrame:
    """(keys, __k, __p, __value): the values at wanted percentiles."""
    met = values_at(split, value, wanted)
    low, high = F.max(F.when(F.col("__pos") == F.col("__low"), F.col(value))), F.max(value)
    return met.groupBy(*split.keys, "__k", "__p").agg((low + F.max(F.col("__at") - F.col("__low")) * (high - low)).alias("__value"))


def _edges(split: Split, params: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """(keys, __low, __high): slopes over the values up to the second percentile and from the last but one on.

    Only these end bins meet in a task for each key and end, as distinct values with their weights.
    """
    inner = params.filter(F.size("__pc") > 2).select(*keys, F.array(F.element_at("x_perc", 2), F.element_at("y_perc", 2)).alias("__a"), F.array(F.element_at("x_perc", -2), F.element_at("y_perc", -2)).alias("__b"), F.col("__n").alias("__size"))
    near = join_split(split, inner, F.col("__size"))
    v = F.col("__v")
    low, high = (F.get(F.col(c), F.col("__side")) for c in ("__a", "__b"))
    ends = F.array_compact(F.array(F.when(v <= low, F.struct(F.lit(0).alias("__end"), (v - low).alias("__d"))), F.when(v >= high, F.struct(F.lit(1).alias("__end"), (v - high).alias("__d")))))
    near = near.select(*keys, "__side", "__w", F.explode(ends).alias("__e")).select(*keys, "__side", "__w", "__e.*")
    out = T.StructType([*(schema[k] for k in keys), T.StructField("__end", T.IntegerType()), T.StructField("__slope", T.DoubleType())])

    def fit(part: pa.Table) -> pa.Table:
        side, d, w = (part.column(c).to_numpy() for c in ("__side", "__d", "__w"))
        runs = []
        for k in (0, 1):
            mine = np.flatnonzero(side == k)
            mine = mine[np.argsort(d[mine], kind="stable")]
            runs += [d[mine], w[mine]]
        one = part.slice(0, 1).select([*keys, "__end"])
        return one.append_column("__slope", pa.array([edge_slope(*runs)], pa.float64()))

    slopes = near.groupBy(*keys, "__end").applyInArrow(fit, out)
    return slopes.groupBy(*keys).agg(F.max(F.when(F.col("__end") == 0, F.col("__slope"))).alias("__low"), F.max(F.when(F.col("__end") == 1, F.col("__slope"))).alias("__high"))


def _split_parameters(both: DataFrame, keys: list[str], combine_invalid: bool, nbins: int, percentiles, minobs: int | None, linear_edge_scaling: bool) -> DataFrame:
    """(keys, x_perc, y_perc) of rows (keys, __x, __y) of very frequent keys, which are split over tasks."""
    full = both.dropna(subset=["__x", "__y"])
    sides = F.explode(F.array(F.struct(F.lit(0).alias("__side"), F.col("__x").alias("__v")), F.struct(F.lit(1).alias("__side"), F.col("__y").alias("__v"))))
    long = (full if combine_invalid else both).select(*keys, sides.alias("__s")).select(*keys, "__s.*").filter("__v is not null")
    split = weighted(long, [*keys, "__side"], ["__v"])
    counts = split.rows.groupBy(*keys).agg(*(F.sum(F.when(F.col("__side") == k, F.col("__w"))).alias(f"__n{k}") for k in (0, 1)))
    counts = counts.dropna(subset=["__n0", "__n1"]).withColumn("__least", F.least("__n0", "__n1"))
    sizes = counts.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__side")).withColumn("__n", F.when(F.col("__side") == 0, F.col("__n0")).otherwise(F.col("__n1")))
    wanted = _positions(sizes.drop("__n0", "__n1"), bins_for(F.col("__least"), nbins, percentiles, minobs))
    values = _percentile_values(split, wanted, "__v")

    def listed(name: str, side: int) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col("__side") == side, F.struct("__k", name))))
        return F.transform(picked, lambda s: s[name])

    found = values.groupBy(*keys).agg(listed("__p", 0).alias("__pc"), listed("__value", 0).alias("__px"), listed("__value", 1).alias("__py"))
    found = found.join(counts, keys).withColumn("__n", F.col("__n0") + F.col("__n1"))
    found = kept(found.select(*keys, "__pc", _spread("__px", "__pc").alias("x_perc"), _spread("__py", "__pc").alias("y_perc"), "__n", "__n0", "__n1"))
    if linear_edge_scaling:
        m = full.groupBy(*keys).agg((F.covar_pop("__x", "__y") / F.nullif(F.var_pop("__x"), F.lit(0.0))).alias("__b"), F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"))
        found = found.join(_edges(split, found, keys, both.schema), keys, "left").join(m, keys, "left")
        px, py, n = F.col("x_perc"), F.col("y_perc"), F.size("__pc")

        def end(k: int, inner: int, slope: str) -> Column:
            return F.element_at(py, inner) + F.coalesce(slope, F.lit(0.0)) * (F.element_at(px, k) - F.element_at(px, inner))

        tilted = F.concat(F.array(end(1, 2, "__low")), F.slice(py, F.lit(2), n - 2), F.array(end(-1, -2, "__high")))
        start = F.col("__my") - F.col("__b") * F.col("__mx")
        nan = F.lit(float("nan"))
        straight = (n == 2) & (F.col("__n0") == F.col("__n1"))
        found = found.withColumn("__yp", F.when(n > 2, tilted).when(straight, F.array(F.coalesce(start, nan), F.coalesce(start + F.col("__b"), nan))).otherwise(py))
        found = found.withColumn("x_perc", F.when(straight, F.array(F.lit(0.0), F.lit(1.0))).otherwise(px)).withColumn("y_perc", F.col("__yp"))
    return found.select(*keys, "x_perc", "y_perc")


def cdf_parameters(df: DataFrame, src: str, ref: str, keys: list[str] | None = None, combine_invalid: bool = True, nbins: int = 100, percentiles=None, minobs: int | None = None, linear_edge_scaling: bool = False) -> DataFrame:
    """(keys, x_perc, y_perc): the values of src and of ref between which a value is carried over; empty without values.

    A key is whole in a task, and many keys are one call; one with more rows than a task should hold is split over tasks. With
    combine_invalid only complete cases count. With linear_edge_scaling the first and last values of y lie on lines fitted to
    the end bins; if there is but one bin, the line is that of the regression of complete cases.
    """
    keys = ["loc_id"] if keys is None else keys
    both = df.select(*keys, known(src).alias("__x"), known(ref).alias("__y"))
    x, y = F.col("__x").isNotNull(), F.col("__y").isNotNull()
    counted = x & y if combine_invalid else x | y
    for k in keys:  # a null key meets no parameters
        counted = counted & F.col(k).isNotNull()
    sizes = kept(both.groupBy(*keys).agg(F.count_if(counted).alias("__rows")))
    whole, many = parted(both.filter(counted), keys, sizes)
    found = _whole_parameters(whole, keys, _given(nbins, percentiles), minobs, combine_invalid, linear_edge_scaling)
    if many is not None:
        found = found.unionByName(_split_parameters(many, keys, combine_invalid, nbins, percentiles, minobs, linear_edge_scaling))
    none = F.array().cast("array<double>")
    return sizes.join(found, keys, "left").select(*keys, F.coalesce("x_perc", none).alias("x_perc"), F.coalesce("y_perc", none).alias("y_perc"))


def apply_parameters(df: DataFrame, params: DataFrame, src: str, keys: list[str] | None = None, out: str | None = None, max_val: float | None = None, min_val: float | None = None, most: int | None = None) -> DataFrame:
    """df with src carried over by stored parameters; null for keys without any, and where they can't be used. No key has more than
    `most` edges; where that isn't known, the parameters are read for it."""
    keys = ["loc_id"] if keys is None else keys
    px, py, v, k = F.col("x_perc"), F.col("y_perc"), F.col("__v"), F.col("__k")
    n = F.size(px)
    if most is None:
        most = params.agg(F.max(n)).first()[0] or 0
    # what concerns a key's parameters alone is worked out once for each key
    rising = F.forall(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.coalesce(F.element_at(px, i) > F.element_at(px, i - 1), F.lit(False)))
    usable = params.filter(n >= 2).select(*keys, px, py, F.when(rising, 0).alias("__k"))
    rows = df.join(usable, keys, "left").withColumn("__v", known(src))
    # how many edges the value has reached, by halves; one expression, since a filter on the result is pushed through chained ones
    steps = F.array(*(F.lit(2**bit) for bit in reversed(range(max(1, most.bit_length())))))
    reached = F.aggregate(steps, F.lit(0), lambda found, step: found + F.when(F.get(px, found + step - 1) <= v, step).otherwise(0))
    rows = rows.withColumn("__k", F.when(k.isNotNull(), F.greatest(F.lit(1), F.least(n - 1, reached))))
    a, b, c, d = F.element_at(px, k), F.element_at(px, k + 1), F.element_at(py, k), F.element_at(py, k + 1)
    got = F.when(k.isNotNull(), c + (v - a) * (d - c) / F.nullif(b - a, F.lit(0.0)))
    if max_val is not None:
        got = F.when(got.isNotNull(), F.least(got, F.lit(float(max_val))))
    if min_val is not None:
        got = F.when(got.isNotNull(), F.greatest(got, F.lit(float(min_val))))
    name = out or src
    return rows.select(*(c for c in df.columns if c != name), got.alias(name))


def cdf_match(df: DataFrame, src: str, ref: str, keys: list[str] | None = None, out: str | None = None, nbins: int = 100, minobs: int | None = 20, linear_edge_scaling: bool = True, percentiles=None, combine_invalid: bool = True, max_val: float | None = None, min_val: float | None = None) -> DataFrame:
    """df with src carried over to ref's distribution, key by key."""
    params = cdf_parameters(df, src, ref, keys, combine_invalid, nbins=nbins, minobs=minobs, linear_edge_scaling=linear_edge_scaling, percentiles=percentiles)
    return apply_parameters(df, params, src, keys, out, max_val, min_val, _edges_for(nbins, percentiles))


def rank_percentiles(df: DataFrame, value: str, percentiles=PERCENTILES, keys: list[str] | None = None) -> DataFrame:
    """(keys, percentile, value): Hazen percentiles from places in sorted order, in expressions only."""
    keys = ["loc_id"] if keys is None else keys
    split = weighted(df.select(*keys, known(value).alias("__v")).filter("__v is not null"), keys, ["__v"])
    sizes = split.rows.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    wanted = _positions(sizes, F.array(*(F.lit(float(p)) for p in percentiles)))
    return _percentile_values(split, wanted, "__v").select(*keys, F.col("__p").alias("percentile"), F.col("__value").alias("value"))


class StoredCdf:
    """CDF parameters that are fitted once for each location and kept in a Parquet table."""

    def __init__(self, spark, path: str, percentiles=PERCENTILES, **kw):
        self.spark, self.path, self.kw = spark, path, {"percentiles": list(percentiles), **kw}

    def load(self, keys: list[str]) -> DataFrame | None:
        return table_at(self.spark, self.path)

    def store(self, params: DataFrame) -> None:
        params.write.mode("append").parquet(self.path)

    def scale(self, df: DataFrame, src: str, ref: str, keys: list[str] | None = None, out: str | None = None) -> DataFrame:
        """src scaled to ref; locations without parameters for this pair are fitted and stored first.

        Nothing is written if no location lacks any. If two runs stored the same location, its parameters count once.
        """
        keys = ["loc_id"] if keys is None else keys
        pair = f"{src}->{ref}"
        known_ = self.load(keys)
        missing = df if known_ is None else df.join(known_.filter(F.col("pair") == pair).select(*keys), keys, "left_anti")
        if known_ is None or not missing.isEmpty():
            self.store(cdf_parameters(missing, src, ref, keys, **self.kw).withColumn("pair", F.lit(pair)))
        once = self.load(keys).filter(F.col("pair") == pair).groupBy(*keys).agg(F.min(F.struct("x_perc", "y_perc")).alias("__p"))
        return apply_parameters(df, once.select(*keys, "__p.x_perc", "__p.y_perc"), src, keys, out)
