"""Queries of temporal and spatial matching."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.moments import pairwise
from ..operators import collocate, spatial
from .inputs import SERIES_SQL, round_all, series, table

H12, H6 = timedelta(hours=12), timedelta(hours=6)

_NEAREST = """
with r as ({ref}), o as ({other}),
c as (select r.loc_id, r.ts, r.value as ref_value, r.event_id, o.ts as ots, o.value as ov,
  row_number() over (partition by r.loc_id, r.ts, r.event_id order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn
  from r left join o on r.loc_id = o.loc_id and o.ts between r.ts - interval {w} and r.ts + interval {w})
"""
_CLICK_VIEW = _NEAREST.format(ref=SERIES_SQL.format(kind="click"), other=SERIES_SQL.format(kind="view"), w="12 hours")


def _click_view(spark, sf_dir, **kw):
    click, view = series(spark, sf_dir, "click"), series(spark, sf_dir, "view")
    ref = click.select("loc_id", "ts", F.col("value").alias("ref_value"), "event_id")
    return collocate.nearest(ref, collocate.Other(view, ["value"], "view_"), H12, **kw)


_MOMENTS = """
m as (select loc_id, count(*) as n_obs, avg(x) as mx, avg(y) as my, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x, y) as c,
  sum((x-y)*(x-y)) as rss, avg(abs(x-y)) as aad, var_pop(x-y) as vd, least(min(x), min(y)) as lo, greatest(max(x), max(y)) as hi
  from p where x is not null and y is not null group by loc_id)
select loc_id, n_obs, round(mx-my, 9) as bias, round(rss, 5) as rss, round(rss/n_obs, 9) as msd, round(sqrt(rss/n_obs), 9) as rmsd,
  round(sqrt(rss/n_obs)/(hi-lo), 9) as nrmsd, round(sqrt(vd), 9) as ubrmsd, round((mx-my)*(mx-my), 9) as mse_bias,
  round((sqrt(vx)-sqrt(vy))*(sqrt(vx)-sqrt(vy)), 9) as mse_var, round(greatest(2*sqrt(vx)*sqrt(vy)-2*c, 0), 9) as mse_corr,
  round((mx-my)*(mx-my) + (sqrt(vx)-sqrt(vy))*(sqrt(vx)-sqrt(vy)) + greatest(2*sqrt(vx)*sqrt(vy)-2*c, 0), 9) as mse,
  round(aad, 9) as aad, round(1-rss/(n_obs*vx), 9) as nash_sutcliffe, round(c/sqrt(vx*vy), 9) as pearson_r from m
"""


@query(_CLICK_VIEW + ", p as (select loc_id, ref_value as x, ov as y from c where rn = 1), " + _MOMENTS)
def collocated_agreement(spark, sf_dir):
    """Clicks with the nearest view within 12 hours, and all agreement metrics by location."""
    got = round_all(pairwise(_click_view(spark, sf_dir), ["loc_id"], "ref_value", "view_value"), 9)
    return got.withColumn("rss", F.round("rss", 5))


@query(_CLICK_VIEW + "select loc_id, ts, ref_value, event_id, ov as view_value, ots as view_index_other, round((epoch_us(ots) - epoch_us(ts)) / 86400e6, 8) as view_distance_other from c where rn = 1")
def nearest_collocation(spark, sf_dir):
    return round_all(_click_view(spark, sf_dir, return_distance=True), 8)


@query(_CLICK_VIEW + "select loc_id, ts, ref_value, event_id, ov as view_value from c where rn = 1 and ov is not null")
def nearest_collocation_dropna(spark, sf_dir):
    return _click_view(spark, sf_dir, dropna="any")


@query(
    "with r as (" + SERIES_SQL.format(kind="click") + "), o as (" + SERIES_SQL.format(kind="view") + ") "
    "select r.loc_id, r.ts, r.event_id, round(avg(o.value), 6) as view_value from r left join o on r.loc_id = o.loc_id "
    "and o.ts between r.ts - interval 6 hours and r.ts + interval 6 hours group by 1, 2, 3"
)
def windowed_mean_collocation(spark, sf_dir):
    click, view = series(spark, sf_dir, "click"), series(spark, sf_dir, "view")
    return round_all(collocate.windowed_mean(click.select("loc_id", "ts", "event_id"), view, ["value"], H6, prefix="view_"))


@query(
    "with r as (" + SERIES_SQL.format(kind="click") + "), o as (" + SERIES_SQL.format(kind="view") + ") "
    "select r.loc_id, r.ts, r.event_id, round(avg(o.value), 6) as view_value from r left join o on r.loc_id = o.loc_id "
    "and o.ts between r.ts - interval 90 minutes and r.ts + interval 90 minutes group by 1, 2, 3"
)
def resample_mean(spark, sf_dir):
    click, view = series(spark, sf_dir, "click"), series(spark, sf_dir, "view")
    return round_all(collocate.resample_mean(click.select("loc_id", "ts", "event_id"), view, ["value"], timedelta(hours=3), prefix="view_"))


def _flag_sql(kind, name, where):
    return f"""{name} as (select r.loc_id, r.ts, o.value, row_number() over (partition by r.loc_id, r.ts order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn
  from r join o on r.loc_id = o.loc_id and o.ts between r.ts - interval 12 hours and r.ts + interval 12 hours and {where})"""


@query(
    "with r as (" + SERIES_SQL.format(kind="click") + "), o as (" + SERIES_SQL.format(kind="view") + "), "
    + _flag_sql("view", "v", "o.event_id % 3 != 0") + ", " + _flag_sql("view", "i", "o.event_id % 3 = 0")
    + " select r.loc_id, r.ts, r.value as ref_value, coalesce(v.value, i.value) as view_value from r left join v on r.loc_id = v.loc_id and r.ts = v.ts and v.rn = 1 left join i on r.loc_id = i.loc_id and r.ts = i.ts and i.rn = 1"
)
def flagged_collocation(spark, sf_dir):
    """Rows flagged invalid match only where no valid one does."""
    click, view = series(spark, sf_dir, "click"), series(spark, sf_dir, "view")
    other = collocate.Other(view, ["value"], "view_", valid="event_id % 3 != 0", use_invalid=True)
    return collocate.nearest(click.select("loc_id", "ts", F.col("value").alias("ref_value")), other, H12)


def _many(name, kind):
    return f"""{name} as (select loc_id, ts, event_id, v from (select r.loc_id, r.ts, r.event_id, o.value as v, row_number() over (partition by r.loc_id, r.ts order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn
  from r join ({SERIES_SQL.format(kind=kind)}) o on r.loc_id = o.loc_id and o.ts between r.ts - interval 12 hours and r.ts + interval 12 hours) where rn = 1)"""


_COMBINED = "with r as (" + SERIES_SQL.format(kind="click") + "), " + ", ".join(_many(n, k) for n, k in (("v", "view"), ("e", "error"), ("p", "purchase"))) + (
    " select r.loc_id, r.ts, r.value, v.v as view__value, e.v as error__value, p.v as purchase__value from r left join v on r.event_id = v.event_id left join e on r.event_id = e.event_id left join p on r.event_id = p.event_id"
)


def _combined(spark, sf_dir, **kw):
    others = {k: (series(spark, sf_dir, k), ["value"]) for k in ("view", "error", "purchase")}
    return collocate.combined(series(spark, sf_dir, "click").drop("event_id"), others, H12, **kw)


@query(_COMBINED)
def combined_collocation(spark, sf_dir):
    """Three series matched to a reference in one shuffle."""
    return _combined(spark, sf_dir)


@query(_COMBINED + " where v.v is not null and e.v is not null and p.v is not null")
def combined_collocation_inner(spark, sf_dir):
    return _combined(spark, sf_dir, combined_dropna="any")


@query(_COMBINED + " where (r.value is not null or v.v is not null or e.v is not null or p.v is not null)")
def combined_collocation_left(spark, sf_dir):
    return _combined(spark, sf_dir, combined_dropna="all")


_UNLIMITED = (
    "with r as (" + SERIES_SQL.format(kind="signup") + "), o as (" + SERIES_SQL.format(kind="purchase") + "), c as (select r.loc_id, r.ts, r.event_id, o.ts as ots, o.value as v, "
    "row_number() over (partition by r.loc_id, r.event_id order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn, (epoch_us(o.ts) - epoch_us(r.ts)) / 86400e6 as d from r join o on r.loc_id = o.loc_id) "
)


def _unlimited(spark, sf_dir, **kw):
    ref = series(spark, sf_dir, "signup").select("loc_id", "ts", "event_id")
    return round_all(collocate.unlimited_nearest(ref, series(spark, sf_dir, "purchase"), ["value"], **kw), 8)


@query(_UNLIMITED + "select loc_id, ts, event_id, v as value, ots as \"index\", round(d, 8) as distance from c where rn = 1")
def unlimited_nearest_match(spark, sf_dir):
    return _unlimited(spark, sf_dir)


@query(_UNLIMITED + "select loc_id, ts, event_id, case when d > -0.1 and d <= 0.1 then v end as value, case when d > -0.1 and d <= 0.1 then ots end as \"index\", case when d > -0.1 and d <= 0.1 then round(d, 8) end as distance from c where rn = 1")
def asymmetric_window_match(spark, sf_dir):
    return _unlimited(spark, sf_dir, window=0.1, bounds="<=")


@query(
    _UNLIMITED + ", k as (select *, row_number() over (partition by loc_id, ots order by abs(d), ts) as again from c where rn = 1) "
    "select loc_id, ts, event_id, case when again = 1 then v end as value, case when again = 1 then ots end as \"index\", case when again = 1 then round(d, 8) end as distance from k"
)
def deduplicated_match(spark, sf_dir):
    return _unlimited(spark, sf_dir, dropduplicates=True)


_POINTS = (
    "with s as (select s_suppkey as loc_id, ((s_suppkey * 37) % 3600) / 10.0 - 180 as lon, ((s_suppkey * 53) % 1700) / 10.0 - 85 as lat from supplier), "
    "c as (select c_custkey as other_id, ((c_custkey * 41) % 3600) / 10.0 - 180 as lon, ((c_custkey * 59) % 1700) / 10.0 - 85 as lat from customer) "
)


def _grids(spark, sf_dir):
    def grid(name, key, alias, a, b):
        k = F.col(key)
        return table(spark, sf_dir, name).select(k.alias(alias), ((k * a % 3600) / 10.0 - 180).alias("lon"), ((k * b % 1700) / 10.0 - 85).alias("lat"))

    return grid("supplier", "s_suppkey", "loc_id", 37, 53), grid("customer", "c_custkey", "other_id", 41, 59)


@query(
    _POINTS + ", d as (select s.loc_id, c.other_id, 12742017.6 * asin(least(1, sqrt(pow(sin(radians(c.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - s.lon) / 2), 2)))) as m from s, c), "
    "b as (select *, row_number() over (partition by loc_id order by m, other_id) as rn from d where m <= 300000) "
    "select s.loc_id, coalesce(b.other_id, -1) as other_id, round(b.m, 2) as distance from s left join b on s.loc_id = b.loc_id and b.rn = 1"
)
def spatial_nearest_lookup(spark, sf_dir):
    """For each point of a grid the nearest of another within 300 km, else -1."""
    ref, other = _grids(spark, sf_dir)
    return round_all(spatial.nearest_lookup(ref, other, 300_000.0), 2)


@query(
    _POINTS + ", d as (select s.loc_id, c.other_id, 12742017.6 * asin(least(1, sqrt(pow(sin(radians(c.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - s.lon) / 2), 2)))) as m from s, c), "
    "w as (select *, 0.54 + 0.46 * cos(pi() * m / 800000) as w, other_id % 17 as v from d where m <= 800000), g as (select loc_id, count(*) as n_obs, round(sum(w * v) / sum(w), 5) as v from w group by 1) "
    "select s.loc_id, coalesce(n_obs, 0) as n_obs, v from s left join g on s.loc_id = g.loc_id"
)
def swath_to_grid(spark, sf_dir):
    """Weighted means of scattered values around the points of a grid."""
    grid, points = _grids(spark, sf_dir)
    return round_all(spatial.resample_to_grid(points.withColumn("v", F.col("other_id") % 17), grid, ["v"], 800_000.0), 5)


_DEDUP = (
    "{0}c as (select r.loc_id, r.ts, r.value as value, o.ts as ots, o.v, row_number() over (partition by r.loc_id, r.ts order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn, abs(epoch_us(o.ts) - epoch_us(r.ts)) as d from r join (select loc_id, ts, value as v from ("
    + SERIES_SQL.format(kind="{1}") + ")) o on r.loc_id = o.loc_id), {0} as (select loc_id, ts, v from (select *, row_number() over (partition by loc_id, ots order by d, ts) as again from {0}c where rn = 1) where again = 1)"
)


@query("with r as (" + SERIES_SQL.format(kind="signup") + "), " + _DEDUP.format("a", "purchase") + ", " + _DEDUP.format("b", "view") + " select r.loc_id, r.ts, r.event_id, a.v as purchase__value, b.v as view__value from r join a on r.loc_id = a.loc_id and r.ts = a.ts join b on r.loc_id = b.loc_id and r.ts = b.ts")
def matching_of_many(spark, sf_dir):
    """Rows whose nearest rows in two other series are matched to no nearer row."""
    others = {k: (series(spark, sf_dir, k), ["value"]) for k in ("purchase", "view")}
    return collocate.matching(series(spark, sf_dir, "signup").select("loc_id", "ts", "event_id"), others)
