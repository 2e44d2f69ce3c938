"""Upscaling: the series of several points as one series of the area that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import known
from .collocate import DAY_US, STRETCH, micros, stretches, window_us
from .shared import kept
from .spatial import by_lookup


def _nearest_values(stamps: DataFrame, rows: DataFrame, value: str, tolerance: int, keys: list[str], ts: str) -> DataFrame:
    """stamps(keys, ts), distinct, with the value of each key's row that is nearest within the tolerance, as `collocate.nearest` has it.

    What there is of a key at one time is one row before anything is sorted, and one order of time serves both directions.
    """
    size = max(STRETCH * tolerance, DAY_US)
    # a row whose value isn't known matches too: it's told from no row by NaN, which no known value is
    v = F.coalesce(known(value), F.lit(float("nan")))
    dealt = rows.select(*keys, micros(ts).alias("__us"), v.alias("__v")).filter("__us is not null").withColumn("__b", stretches(F.col("__us"), size, tolerance))
    marks = stamps.select(*keys, ts, micros(ts).alias("__us"), F.lit(1).alias("__mark")).withColumn("__b", F.floor(F.col("__us") / size))
    by = [*keys, "__b"]
    both = marks.unionByName(dealt, allowMissingColumns=True).repartition(*by)
    # of rows at one time the first by content: one without a value, else the smallest value
    unknown = F.max(F.isnan("__v").cast("int")) == 1
    both = both.groupBy(*by, "__us").agg(F.max("__mark").alias("__mark"), F.min(ts).alias(ts), F.when(unknown, float("nan")).otherwise(F.min("__v")).alias("__v"))
    both = both.withColumn("__at", F.when(F.col("__v").isNotNull(), F.col("__us")))
    upto = Window.partitionBy(*by).orderBy("__us").rowsBetween(Window.unboundedPreceding, 0)
    over = f"over (partition by {', '.join(f'`{c}`' for c in by)} order by __us)"
    both = both.select(*keys, ts, "__us", "__mark", *(F.last(c, True).over(upto).alias(f"{c}_p") for c in ("__at", "__v")), *(F.expr(f"lead({c}) ignore nulls {over}").alias(f"{c}_f") for c in ("__at", "__v")))
    dp, df = F.col("__us") - F.col("__at_p"), F.col("__at_f") - F.col("__us")
    found = F.when((df <= tolerance) & F.coalesce(df <= dp, F.lit(True)), F.col("__v_f")).when(dp <= tolerance, F.col("__v_p"))
    return both.filter("__mark = 1").select(*keys, ts, F.nanvl(found, F.lit(None).cast("double")).alias(value))


def temporally_matched(points: DataFrame, value: str, hours: float = 6, keys: list[str] | None = None, point: str = "point_id", ts: str = "ts", drop_missing: bool = False) -> DataFrame:
    """(keys, point, ts, value): every point's values on the time stamps of the area's fullest series.

    The fullest series has the most known values (the smallest point id of equals); other points give their nearest value
    within `hours`. Points without any value drop out; with drop_missing only stamps at which every point has one stay.
    """
    keys = ["loc_id"] if keys is None else keys
    rows = kept(points.select(*keys, point, ts, known(value).alias(value)))
    counts = kept(rows.groupBy(*keys, point).agg(F.count(value).alias("__n")).filter("__n > 0"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("__n"), F.col(point))).getField(point).alias(point))
    ref = rows.join(best, [*keys, point], "left_semi")
    stamps = ref.select(*keys, ts).distinct().join(counts.select(*keys, point), keys)
    found = _nearest_values(stamps, rows, value, window_us(hours / 24), [*keys, point], ts)
    if drop_missing:
        whole = found.groupBy(*keys, ts).agg(F.count(value).alias("__m"), F.count("*").alias("__all")).filter("__m = __all").select(*keys, ts)
        found = found.join(whole, [*keys, ts], "left_semi")
    return found.select(*keys, point, ts, value)


def stable_points(matched: DataFrame, value: str, r_min: float = 0.6, see_max: float = 0.05, min_n: int = 4, keys: list[str] | None = None, point: str = "point_id", ts: str = "ts") -> DataFrame:
    """matched without the points that don't follow their area: R with the area's mean under r_min, or the standard error of
    the slope over see_max. Areas with fewer than min_n points keep all; so do points whose R is undefined."""
    keys = ["loc_id"] if keys is None else keys
    matched = kept(matched)  # read for the points' figures and again for what stays
    mean = matched.withColumn("__e", F.avg(value).over(Window.partitionBy(*keys, ts)))
    x, y = F.col("__e"), F.col(value)
    both = F.when(y.isNotNull(), x)
    stats = mean.groupBy(*keys, point).agg(F.count(y).alias("n"), F.var_pop(both).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(both, y).alias("c"))
    r = F.col("c") / F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0))
    see = F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * F.col("vy") / F.nullif(F.col("vx"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0)))
    stats = kept(stats)
    areas = stats.groupBy(*keys).agg(F.count("*").alias("points"))
    good = stats.join(areas, keys).filter((F.col("points") < min_n) | r.isNull() | ((r >= r_min) & F.coalesce(see <= see_max, F.lit(True))))
    return matched.join(good.select(*keys, point), [*keys, point], "left_semi")


def averaged(matched: DataFrame, value: str, keys: list[str] | None = None, ts: str = "ts", method: str = "average") -> DataFrame:
    """(keys, ts, value): the mean over the points that have a value."""
    keys = ["loc_id"] if keys is None else keys
    function = {"average": F.avg}[method]
    return matched.groupBy(*keys, ts).agg(function(value).alias(value))


def upscaled(obs: DataFrame, lookup: DataFrame, value: str, method: str = "average", temporal_stability: bool = False, hours: float = 6, ref_id: str = "loc_id", other_id: str = "other_id", ts: str = "ts", **stability) -> DataFrame:
    """(ref_id, ts, value) for the areas of lookup(ref_id, other_id), from the observations of its points."""
    points = obs.withColumn("point_id", F.col(ref_id))
    rows = by_lookup(points, lookup, ref_id, other_id)
    matched = temporally_matched(rows, value, hours, [ref_id], "point_id", ts)
    if temporal_stability:
        matched = stable_points(matched, value, keys=[ref_id], ts=ts, **stability)
    return averaged(matched, value, [ref_id], ts, method)
