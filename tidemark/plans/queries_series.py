"""Queries of time-series and calendar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import calendar as cal
from ..operators import adapters, series as ops
from . import statistics_sql as statistics
from .inputs import DAILY, SERIES_SQL, daily, round_all, series, table

_D = f"with d as ({DAILY}) "


def _boxcar(days: int, fillna: bool, min_obs: int, digits: int = 6) -> str:
    half = days / 2 * 24
    inner = f"select a.loc_id, a.ts, any_value(a.value) as own, count(b.value) as n, avg(b.value) as m from d a left join d b on a.loc_id = b.loc_id and b.ts between a.ts - interval {int(half)} hours and a.ts + interval {int(half)} hours group by 1, 2"
    kept = "true" if fillna else "own is not null"
    return f"select loc_id, ts, own as value, round(case when n >= {min_obs} and {kept} then m end, {digits}) as smooth from ({inner})"


@query(_D + "select loc_id, ts, round(value, 6) as value, smooth from (" + _boxcar(7, False, 1) + ")")
def moving_average(spark, sf_dir):
    return round_all(ops.moving_average(daily(spark, sf_dir), "value", 7, out="smooth"))


@query(_D + "select loc_id, ts, round(value, 6) as value, smooth from (" + _boxcar(5, True, 3) + ")")
def moving_average_fillna(spark, sf_dir):
    return round_all(ops.moving_average(daily(spark, sf_dir), "value", 5, fillna=True, min_obs=3, out="smooth"))


@query(
    _D + "select a.loc_id, a.ts, round(case when any_value(a.value) is not null then sum(b.value * exp(-date_diff('day', b.ts, a.ts) / 10.0)) / sum(exp(-date_diff('day', b.ts, a.ts) / 10.0)) filter (b.value is not null) end, 5) as value "
    "from d a left join d b on a.loc_id = b.loc_id and b.ts <= a.ts group by 1, 2"
)
def exponential_filter(spark, sf_dir):
    return round_all(ops.exponential_filter(daily(spark, sf_dir), "value", 10), 5)


_LEAP = "dayofyear(make_date(2000, month({0}), day({0})))"


def _clim(orig: int, clim: float, agg: str, slots: int, slot: str) -> str:
    half = int(orig / 2 * 24)
    return (
        f"s as (select a.loc_id, a.ts, avg(b.value) as v from d a left join d b on a.loc_id = b.loc_id and b.ts between a.ts - interval {half} hours and a.ts + interval {half} hours group by 1, 2), "
        f"g as (select loc_id, {slot} as slot, {agg} as c, stddev_samp(v) as sd from s group by 1, 2), l as (select distinct loc_id from d), "
        f"f as (select l.loc_id, r.slot, g.c, g.sd from l cross join (select unnest(range(1, {slots + 1}))::int as slot) r left join g on l.loc_id = g.loc_id and r.slot = g.slot), "
        f"w as (select f.loc_id, f.slot, avg(x.c) as climatology, any_value(f.sd) as climatology_std from f left join f x on f.loc_id = x.loc_id and "
        f"least(abs(f.slot - x.slot), {slots} - abs(f.slot - x.slot)) <= {int(clim / 2)} group by 1, 2) "
    )


@query(_D + ", " + _clim(5, 35, "avg(v)", 366, _LEAP.format("ts")) + "select loc_id, slot, round(climatology, 6) as climatology, round(climatology_std, 6) as climatology_std from w")
def climatology_daily(spark, sf_dir):
    return round_all(ops.climatology(daily(spark, sf_dir), "value", std=True))


@query(_D + ", " + _clim(5, 3, "median(v)", 12, "month(ts)") + "select loc_id, slot::int as slot, round(climatology, 6) as climatology from w")
def climatology_monthly_median(spark, sf_dir):
    return round_all(ops.climatology(daily(spark, sf_dir), "value", statistic="median", output_freq="month"))


@query(_D + ", " + _clim(5, 35, "avg(v)", 366, "dayofyear(ts)") + ", p as (select loc_id, avg(climatology) as m from w where slot in (365, 1) group by 1) select w.loc_id, slot, round(case when slot = 366 then m else climatology end, 6) as climatology from w join p on w.loc_id = p.loc_id")
def climatology_true_days(spark, sf_dir):
    return round_all(ops.climatology(daily(spark, sf_dir), "value", respect_leap_years=True, interpolate_leapday=True))


@query(_D + "select loc_id, ts, round(value - smooth, 8) as value from (" + _boxcar(35, False, 1, 13) + ")")
def anomaly_moving_average(spark, sf_dir):
    return round_all(ops.anomaly(daily(spark, sf_dir), "value"), 8)


@query(_D + ", " + _clim(5, 35, "avg(v)", 366, _LEAP.format("ts")) + "select d.loc_id, d.ts, round(d.value - w.climatology, 6) as value, round(w.climatology, 6) as climatology from d left join w on d.loc_id = w.loc_id and w.slot = " + _LEAP.format("d.ts"))
def anomaly_climatology(spark, sf_dir):
    d = daily(spark, sf_dir)
    return round_all(ops.anomaly(d, "value", clim=ops.climatology(d, "value"), respect_leap_years=False, return_clim=True))


_PAIRS = "with q as (select (l_suppkey % 8) as loc_id, l_shipdate as ts, avg(l_quantity) as x, avg(l_discount * 100 + l_tax * 50) as y from lineitem group by 1, 2) "


def _pairs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy((F.col("l_suppkey") % 8).alias("loc_id"), F.col("l_shipdate").alias("ts")).agg(F.avg("l_quantity").alias("x"), F.avg(F.col("l_discount") * 100 + F.col("l_tax") * 50).alias("y"))


def _rolling(low: str, high: str, least: int) -> str:
    return (
        "select a.loc_id, a.ts, count(*) as n_obs, round(case when count(*) >= {2} and var_pop(b.x) > 1e-15 and var_pop(b.y) > 1e-15 then covar_pop(b.x, b.y) / sqrt(var_pop(b.x) * var_pop(b.y)) end, 5) + 0.0 as R, "
        "round(case when count(*) >= {2} then sqrt(avg((b.x-b.y)*(b.x-b.y))) end, 5) as RMSD from q a join q b on a.loc_id = b.loc_id and b.ts {0} and b.ts {1} group by 1, 2"
    ).format(low, high, least)


@query(_PAIRS + _rolling(">= a.ts - interval 30 days", "<= a.ts + interval 30 days", 5))
def rolling_agreement_centred(spark, sf_dir):
    return round_all(ops.rolling_agreement(_pairs(spark, sf_dir), "x", "y", 30, True, 5, with_p=False), 5)


@query(_PAIRS + _rolling("> a.ts - interval 20 days", "<= a.ts", 5))
def rolling_agreement_trailing(spark, sf_dir):
    return round_all(ops.rolling_agreement(_pairs(spark, sf_dir), "x", "y", 20, False, 5, with_p=False), 5)


@query(
    _PAIRS + ", w as (select a.loc_id, a.ts, count(*) as n, case when count(*) >= 2 and var_pop(b.x) > 1e-15 and var_pop(b.y) > 1e-15 then covar_pop(b.x, b.y) / sqrt(var_pop(b.x) * var_pop(b.y)) end as r, sqrt(avg((b.x-b.y)*(b.x-b.y))) as d "
    "from q a join q b on a.loc_id = b.loc_id and b.ts >= a.ts - interval 30 days and b.ts <= a.ts + interval 30 days group by 1, 2) "
    f"select loc_id, ts, n as n_obs, round(r, 5) + 0.0 as R, round(case when n >= 2 then d end, 5) as RMSD, round({statistics.correlation_p('r', 'n')}, 5) + 0.0 as p_R from w"
)
def rolling_agreement_p_values(spark, sf_dir):
    return round_all(ops.rolling_agreement(_pairs(spark, sf_dir), "x", "y", 30), 5)


_LABEL = "cast(make_date(year({0}), month({0}), case when day({0}) < 11 then {1} when day({0}) < 21 then {2} else {3} end) as timestamp)"
_END = _LABEL.format("{0}", 10, 20, "day(last_day({0}))")
_START = _LABEL.format("{0}", 1, 11, 21)


@query(_D + "select loc_id, " + _END.format("ts") + " as label, round(avg(value), 6) as mean, count(value) as n from d group by 1, 2")
def dekad_means(spark, sf_dir):
    return round_all(ops.by_day_bins(daily(spark, sf_dir), [F.avg("value").alias("mean"), F.count("value").alias("n")]).withColumn("label", F.col("label").cast("timestamp_ntz")))


@query(_D + "select loc_id, " + _START.format("ts") + " as label, count(*) as n from d group by 1, 2")
def dekad_starts(spark, sf_dir):
    return ops.by_day_bins(daily(spark, sf_dir), [F.count("*").alias("n")], start=True).withColumn("label", F.col("label").cast("timestamp_ntz"))


@query(
    "with o as (select cast(o_orderdate as timestamp) as ts from orders), d as (select unnest(generate_series((select min(ts) from o), (select max(ts) from o), interval 1 day)) as day), "
    "b as (select distinct " + _END.format("day") + " as label from d), n as (select " + _END.format("ts") + " as label, count(*) as n from o group by 1) select b.label, coalesce(n, 0) as n from b left join n on b.label = n.label"
)
def dekads_between(spark, sf_dir):
    """Every dekad from the first order to the last one, with its orders, also where there are none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"))
    first, last = orders.agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    counts = orders.groupBy(cal.dekad_end(F.col("ts")).alias("label")).agg(F.count("*").alias("n"))
    found = cal.labels_between(spark, str(first), str(last)).join(counts, "label", "left")
    return found.select(F.col("label").cast("timestamp_ntz").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select event_id, ts, value from events")
def naive_utc_times(spark, sf_dir):
    """Zoned time stamps, made from microseconds since 1970, as naive UTC ones."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    zoned = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(us).alias("ts"), "value")
    return adapters.naive_utc(zoned)


@query(
    "select distinct o_orderdate as ts, cast((month(o_orderdate) - 1) * 3 + least(3, (day(o_orderdate) - 1) // 10 + 1) as int) as dekad_index, " + _END.format("o_orderdate") + " as dekad_end, " + _START.format("o_orderdate") + " as dekad_start, "
    "cast(cast(o_orderdate as date) as timestamp) = " + _END.format("o_orderdate") + " as is_end, dayofyear(o_orderdate)::int as doy, " + _LEAP.format("o_orderdate") + "::int as leap_doy, "
    "epoch_us(o_orderdate) / 86400e6 + 2440587.5 as julian from orders"
)
def calendar_fields(spark, sf_dir):
    ts = F.col("ts")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return dates.select(ts, cal.dekad_index(ts).cast("int").alias("dekad_index"), cal.dekad_end(ts).cast("timestamp_ntz").alias("dekad_end"), cal.dekad_start(ts).cast("timestamp_ntz").alias("dekad_start"), cal.is_dekad_end(ts).alias("is_end"), F.dayofyear(ts).alias("doy"), cal.leap_doy(ts).alias("leap_doy"), cal.to_julian(ts).alias("julian"))


@query("select event_id, ts, ts as back from events")
def julian_round_trip(spark, sf_dir):
    """Time stamps to Julian dates and back; doubles hold them to some tens of microseconds."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    back = cal.from_julian(cal.to_julian(F.col("ts")))
    close = F.abs(F.timestamp_diff("MICROSECOND", F.col("ts"), back)) <= 50
    return ev.select("event_id", "ts", F.when(close, F.col("ts")).otherwise(back).alias("back"))


_WINTER = (
    "with d as (" + DAILY + "), y as (select loc_id, min(year(ts)) as y0 from d group by 1) "
    "select d.loc_id, d.ts, round(value, 6) as value from d join y on d.loc_id = y.loc_id where (month(ts) * 100 + day(ts) >= 1220) or (month(ts) * 100 + day(ts) < 210 and year(ts) > y0) or (month(ts) * 100 + day(ts) = 210 and year(ts) > y0)"
)


@query(_WINTER)
def yearless_range_select(spark, sf_dir):
    """December 20 to February 10 of every year of the data."""
    part = adapters.Distributor(yearless_ranges=[(cal.Yearless(12, 20), cal.Yearless(2, 10))])
    return round_all(part.select(daily(spark, sf_dir)))


@query(_D + "select loc_id, ts, round(case when ts between timestamp '1996-02-01' and timestamp '1996-03-15' or (month(ts) = 7 and day(ts) = 4) or ts = timestamp '1997-05-05' then value end, 6) as value from d")
def distributor_set_null(spark, sf_dir):
    part = adapters.Distributor(dates=["1997-05-05"], ranges=[("1996-03-15", "1996-02-01")], yearless_dates=[(7, 4)])
    return round_all(part.select(daily(spark, sf_dir), set_nan=True))


_V = SERIES_SQL.format(kind="view")


@query(f"select loc_id, ts, value, event_id from ({_V}) where value >= 10 and value < 100 and event_id & 2 != 0")
def advanced_masking(spark, sf_dir):
    rules = [("value", ">=", 10), ("value", "<", 100), ("event_id", lambda c, t: c.bitwiseAND(t) != 0, 2)]
    return adapters.keep_where(series(spark, sf_dir, "view"), rules)


@query(f"select loc_id, ts, event_id, coalesce(value < 20, false) as value from ({_V})")
def boolean_mask(spark, sf_dir):
    return adapters.mask_frame(series(spark, sf_dir, "view"), "<", 20, ["value"])


@query(f"select loc_id, ts, event_id, round((value + event_id) / 2, 6) as merged from ({_V})")
def combined_columns(spark, sf_dir):
    got = adapters.combine_columns(series(spark, sf_dir, "view"), adapters.row_mean, ["value", "event_id"], "merged")
    return round_all(got.drop("value"))


@query("select event_id, loc_id, ts + to_seconds((event_id % 1000)::int) + to_minutes((event_id % 7)::int) as exact from (" + _V + ")")
def exact_timestamps(spark, sf_dir):
    """A base time plus offsets of two units."""
    rows = series(spark, sf_dir, "view").select("event_id", "loc_id", "ts", (F.col("event_id") % 1000).cast("double").alias("sec"), (F.col("event_id") % 7).cast("double").alias("min"))
    return adapters.exact_time(rows, ["sec", "min"], ["s", "m"], output_field="exact").select("event_id", "loc_id", "exact")


@query(
    "with r as (" + SERIES_SQL.format(kind="click") + "), m as (select loc_id, ts, value < 15 as flag from (" + SERIES_SQL.format(kind="error") + ")), "
    "c as (select r.loc_id, r.ts, r.value, r.event_id, m.flag, row_number() over (partition by r.loc_id, r.ts order by abs(epoch_us(m.ts) - epoch_us(r.ts)), m.ts desc) as rn from r left join m on r.loc_id = m.loc_id and m.ts between r.ts - interval 6 hours and r.ts + interval 6 hours) "
    "select loc_id, ts, value, event_id from c where rn = 1 and not coalesce(flag, false)"
)
def masked_series(spark, sf_dir):
    """Clicks without those whose nearest error within six hours has a value under 15."""
    mask = series(spark, sf_dir, "error").select("loc_id", "ts", (F.col("value") < 15).alias("flag"))
    return adapters.drop_masked(series(spark, sf_dir, "click"), {"m": (mask, "flag")}, 0.25)


@query("with e as (select user_id % 16 as loc_id, ts, event_type, value from events where event_type in ('click', 'view', 'error')) select loc_id, ts, event_type, value from e where ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
def period_filter(spark, sf_dir):
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "error"))
    ev = ev.select((F.col("user_id") % 16).alias("loc_id"), "ts", "event_type", "value")
    return adapters.in_period(ev, ("2024-01-05", "2024-01-20"))
