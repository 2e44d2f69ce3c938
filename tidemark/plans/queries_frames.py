"""Queries of whole validations, upscaling and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import calculators, upscale
from ..sources.datasets import Dataset, frame
from ..sources.results import CellResults, Results, from_days, to_days
from .inputs import SERIES_SQL, fresh_folder, round_all, rounded, series, table
from .queries_scaling import carried_sql, cdf_sql
from .queries_metrics import _triple_cells
from .validation import Validation

KINDS = ("click", "error", "view")
KINDS_BY_REF = KINDS  # a combination's names are sorted: click is the reference


def _validation(spark, sf_dir, **kw):
    sets = {k: Dataset(frame(series(spark, sf_dir, k).select("loc_id", "ts", "value")), ["value"]) for k in KINDS}
    run = calculators.pairwise("ref", "k1", calc_spearman=False, analytical_cis=False)
    return Validation(sets, "click", {(3, 2): run}, temporal_window=0.5, **kw)


def _locations(spark, sf_dir):
    """All locations that have events, and one that has none."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("loc_id")).distinct()
    return ids.unionAll(ids.agg((F.max("loc_id") + 84).alias("loc_id")))


def _match_cte(name: str, kind: str) -> str:
    return f"""{name} as (select event_id, v from (select r.event_id, o.value as v, row_number() over (partition by r.loc_id, r.ts order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn
  from r join ({SERIES_SQL.format(kind=kind)}) o on r.loc_id = o.loc_id and o.ts between r.ts - interval 12 hours and r.ts + interval 12 hours) where rn = 1)"""


_WIDE = (
    "with r as (" + SERIES_SQL.format(kind="click") + "), " + _match_cte("e", "error") + ", " + _match_cte("v", "view")
    + ", w as (select r.loc_id, r.value as click, e.v as error, v.v as view from r join e on r.event_id = e.event_id join v on r.event_id = v.event_id), "
    "l as (select distinct user_id % 16 as loc_id from events union all select max(user_id % 16) + 84 from events), "
)


def _pair_sql(a: str, b: str, x: str, y: str) -> str:
    return (
        f"select l.loc_id, '{a}.value_with_{b}.value' as combo, m.n_obs, m.\"BIAS\", m.\"RMSD\", m.\"R\", m.urmsd, case when m.n_obs is null then 7 when m.n_obs < 10 then 1 else 0 end as status from l left join "
        f"(select loc_id, count(*)::int as n_obs, round(avg({x} - {y}), 10) + 0.0 as \"BIAS\", round(sqrt(avg(({x}-{y})*({x}-{y}))), 10) as \"RMSD\", round(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})), 10) as \"R\", round(sqrt(var_pop({x} - {y})), 10) as urmsd from w group by 1) m on l.loc_id = m.loc_id"
    )


_PAIRS = (("click", "error"), ("click", "view"), ("error", "view"))
_COLUMNS = ["loc_id", "combo", "n_obs", "BIAS", "RMSD", "R", "urmsd", "status"]


@query(_WIDE.rstrip(", ") + " " + " union all ".join(_pair_sql(a, b, a, b) for a, b in _PAIRS))
def validation_unscaled(spark, sf_dir):
    """Three datasets matched at once, every pair compared, a status for every location."""
    return round_all(_validation(spark, sf_dir, scaling=None).calc(spark, _locations(spark, sf_dir)).select(*_COLUMNS), 10)


_STATS = "s as (select loc_id, " + ", ".join(f"avg({k}) as m_{k}, stddev_pop({k}) as s_{k}" for k in KINDS) + " from w group by 1), "
_SCALED = "z as (select w.loc_id, click, (error - m_error) / s_error * s_click + m_click as error, (view - m_view) / s_view * s_click + m_click as view from w join s on w.loc_id = s.loc_id) "


@query(_WIDE + _STATS + _SCALED + " union all ".join(_pair_sql(a, b, a, b).replace("from w group", "from z group") for a, b in _PAIRS))
def validation_mean_std(spark, sf_dir):
    return round_all(_validation(spark, sf_dir, scaling="mean_std").calc(spark, _locations(spark, sf_dir)).select(*_COLUMNS), 10)


_PARAMETERS = "ev as (select loc_id, 'error' as kind, error as x, click as y from w union all select loc_id, 'view', view, click from w), " + cdf_sql("ev", "loc_id, kind")
_CARRIED = (
    "cw as (select w.*, e.px as pe, e.py as qe, v.px as pv, v.py as qv from w join cdf e on w.loc_id = e.loc_id and e.kind = 'error' join cdf v on w.loc_id = v.loc_id and v.kind = 'view'), "
    f"z1 as (select *, pe as px, qe as py from cw), z2 as (select * exclude (px, py), pv as px, qv as py, {carried_sql('error')} as error2 from z1), "
    f"z as (select loc_id, click, error2 as error, {carried_sql('view')} as view from z2) "
)


@query(_WIDE + _PARAMETERS + ", " + _CARRIED + " union all ".join(_pair_sql(a, b, a, b).replace("from w group", "from z group").replace(", 10)", ", 8)") for a, b in _PAIRS))
def validation_cdf_matched(spark, sf_dir):
    """The default scaling, by combination, as validation_mean_std."""
    return round_all(_validation(spark, sf_dir, scaling="cdf_match").calc(spark, _locations(spark, sf_dir)).select(*_COLUMNS), 8)


def _triple_rows() -> str:
    """The triple of all three datasets by location; locations without rows have one row without a dataset, status 7."""
    cov = ", ".join(f"covar_samp({KINDS_BY_REF[i]}, {KINDS_BY_REF[j]}) as c{i}{j}" for i in range(3) for j in range(i, 3))
    rows = []
    for i in range(3):
        snr, err, beta = _triple_cells(i)
        rows.append(f"select loc_id, '{('ref', 'k1', 'k2')[i]}' as dataset, n, round({snr}, 4) as snr, round({err}, 4) as err_std, round({beta}, 4) as beta, case when n < 10 then 1 when {snr} is null or {err} is null or {beta} is null then 2 else 0 end as st from c")
    name = "_with_".join(f"{k}.value" for k in KINDS_BY_REF)
    return (
        f"c as (select loc_id, count(*) as n, {cov} from w group by 1), t as ({' union all '.join(rows)}) "
        f"select l.loc_id, t.dataset, t.n as n_obs, case when n >= 10 then snr end as snr, case when n >= 10 then err_std end as err_std, case when n >= 10 then beta end as beta, coalesce(st, 7) as status, '{name}' as combo from l left join t on l.loc_id = t.loc_id"
    )


@query(_WIDE + _triple_rows())
def validation_triple(spark, sf_dir):
    sets = {k: Dataset(frame(series(spark, sf_dir, k).select("loc_id", "ts", "value")), ["value"]) for k in KINDS}
    run = calculators.triple_collocation(["ref", "k1", "k2"], "ref")
    v = Validation(sets, "click", {(3, 3): run}, temporal_window=0.5, scaling=None)
    return round_all(v.calc(spark, _locations(spark, sf_dir)), 4)


def _by_extrema(df, columns, reference):
    """A scaler as a function: every column from 0 to 1 by its location's extrema."""
    at = Window.partitionBy("loc_id")
    scaled = {c: (F.col(c) - F.min(c).over(at)) / F.nullif(F.max(c).over(at) - F.min(c).over(at), F.lit(0.0)) for c in columns}
    return df.withColumns(scaled)


def _same_day(frames, reference):
    """A matcher as a function: the means of a day, for the days that all datasets have."""
    days = [df.groupBy("loc_id", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias(f"{n}__value")) for n, df in frames.items()]
    return reduce(lambda a, b: a.join(b, ["loc_id", "ts"]), days)


_EXTREMA = "s as (select loc_id, " + ", ".join(f"min({k}) as a_{k}, max({k}) as b_{k}" for k in KINDS) + " from w group by 1), "
_UNIT = "z as (select w.loc_id, " + ", ".join(f"({k} - a_{k}) / (b_{k} - a_{k}) as {k}" for k in KINDS) + " from w join s on w.loc_id = s.loc_id) "


@query(_WIDE + _EXTREMA + _UNIT + " union all ".join(_pair_sql(a, b, a, b).replace("from w group", "from z group") for a, b in _PAIRS if "click" in (a, b)))
def validation_own_scaler(spark, sf_dir):
    """A scaler of the user's own, and only the combinations that have the reference."""
    v = _validation(spark, sf_dir, scaling=_by_extrema)
    return round_all(v.calc(spark, _locations(spark, sf_dir), only_with_reference=True).select(*_COLUMNS), 10)


_DAYS = ", ".join(f"d_{k} as (select user_id % 16 as loc_id, date_trunc('day', ts) as ts, avg(value) as v from events where event_type = '{k}' group by 1, 2)" for k in KINDS)


@query(
    "with " + _DAYS + ", w as (select a.loc_id, a.v as click, b.v as error, c.v as view from d_click a join d_error b on a.loc_id = b.loc_id and a.ts = b.ts join d_view c on a.loc_id = c.loc_id and a.ts = c.ts), "
    "l as (select distinct user_id % 16 as loc_id from events union all select max(user_id % 16) + 84 from events) "
    + " union all ".join(_pair_sql(a, b, a, b).replace("then 7 when", "then case when l.loc_id < 16 then 4 else 7 end when") for a, b in _PAIRS)
)
def validation_own_matcher(spark, sf_dir):
    """A matcher of the user's own: datasets meet on the same day, by their means."""
    v = _validation(spark, sf_dir, scaling=None, matcher=_same_day)
    return round_all(v.calc(spark, _locations(spark, sf_dir)).select(*_COLUMNS), 10)


_MASK = (
    "m as (select event_id from (select r.event_id, o.value < 15 as flag, row_number() over (partition by r.loc_id, r.ts order by abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts desc) as rn from r join ("
    + SERIES_SQL.format(kind="signup") + ") o on r.loc_id = o.loc_id and o.ts between r.ts - interval 12 hours and r.ts + interval 12 hours) where rn = 1 and flag)"
)


@query(_WIDE.replace(", w as (", ", " + _MASK + ", w as (").replace("join v on r.event_id = v.event_id)", "join v on r.event_id = v.event_id where r.event_id not in (select event_id from m))").rstrip(", ") + " " + " union all ".join(_pair_sql(a, b, a, b) for a, b in _PAIRS))
def validation_masked(spark, sf_dir):
    mask = series(spark, sf_dir, "signup").select("loc_id", "ts", (F.col("value") < 15).alias("flag"))
    v = _validation(spark, sf_dir, scaling=None, masking_datasets={"m": (Dataset(frame(mask), ["flag"]), "flag")})
    return round_all(v.calc(spark, _locations(spark, sf_dir)).select(*_COLUMNS), 10)


_UP = (
    "with o as (select l_suppkey as p, l_shipdate as ts, avg(l_quantity) as value from lineitem group by 1, 2), k as (select {area} as loc_id, p, ts, value from o), "
    "n as (select loc_id, p, count(value) as n from k group by 1, 2), b as (select loc_id, p from (select *, row_number() over (partition by loc_id order by n desc, p) as rn from n) where rn = 1), "
    "s as (select distinct k.loc_id, k.ts from k join b on k.loc_id = b.loc_id and k.p = b.p), "
    "c as (select s.loc_id, s.ts, q.p, q.value, row_number() over (partition by s.loc_id, s.ts, q.p order by abs(epoch_us(q.ts) - epoch_us(s.ts)), q.ts desc) as rn from s join k q on s.loc_id = q.loc_id and q.ts between s.ts - interval 36 hours and s.ts + interval 36 hours), "
    "f as (select s.loc_id, s.ts, n.p, c.value from s join n on s.loc_id = n.loc_id left join c on c.loc_id = s.loc_id and c.ts = s.ts and c.p = n.p and c.rn = 1) "
)
_AVERAGED = "select loc_id, ts, round(avg(value), 6) as value from {0} group by 1, 2"
#: Points that don't follow their area's mean go.
_STABLE = (
    ", e as (select *, avg(value) over (partition by loc_id, ts) as m from f), t as (select loc_id, p, count(value) as n, corr(value, m) as r, var_pop(value) as vy, var_pop(case when value is not null then m end) as vx from e group by 1, 2), "
    "u as (select *, count(*) over (partition by loc_id) as points, sqrt(greatest(1 - r * r, 0) * vy / nullif(vx, 0) / nullif(n - 2, 0)) as see from t), "
    "g as (select f.* from f join u on f.loc_id = u.loc_id and f.p = u.p where points < 4 or r is null or (r >= 0.2 and coalesce(see <= 0.2, true))) "
)


def _upscaled(spark, sf_dir, area, **kw):
    """The points are all suppliers; neighbouring keys are the points of an area."""
    t = table(spark, sf_dir, "lineitem")
    obs = t.groupBy(F.col("l_suppkey").alias("loc_id"), F.col("l_shipdate").alias("ts")).agg(F.avg("l_quantity").alias("value"))
    lookup = t.select(F.col("l_suppkey").alias("loc_id")).distinct().select(area.alias("loc_id"), F.col("loc_id").alias("other_id"))
    return upscale.upscaled(obs, lookup, "value", hours=36, **kw)


@query(_UP.format(area="p // 4") + _AVERAGED.format("f"))
def upscaled_average(spark, sf_dir):
    """Points of an area on the times of its fullest point, averaged: four suppliers are an area."""
    return round_all(_upscaled(spark, sf_dir, F.floor(F.col("loc_id") / 4)))


@query(_UP.format(area="p // 6") + _AVERAGED.format("f"))
def upscaled_average_all(spark, sf_dir):
    """Six suppliers are an area; the number of areas grows with the suppliers."""
    return round_all(_upscaled(spark, sf_dir, F.floor(F.col("loc_id") / 6)))


@query(_UP.format(area="p // 6") + _STABLE + _AVERAGED.format("g"))
def upscaled_stable(spark, sf_dir):
    """As upscaled_average_all, without the points that don't follow their area."""
    return round_all(_upscaled(spark, sf_dir, F.floor(F.col("loc_id") / 6), temporal_stability=True, r_min=0.2, see_max=0.2))


_MEANS = "m as (select user_id % 16 as loc_id, event_type as combo, count(*) as n, avg(value) as mean from events group by 1, 2), i as (select *, row_number() over (partition by combo order by loc_id) - 1 as idx from m)"


def _stored(spark, sf_dir) -> Results:
    """Result tables: means by location and kind of event, added in two goes, and the daily series of every location."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("loc_id"), F.col("event_type").alias("combo"), "ts", "value")
    kept = Results(spark, fresh_folder(spark, "results"))
    means = events.groupBy("loc_id", "combo").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    kept.add_metrics(means.filter("loc_id < 8"))
    kept.add_metrics(means.filter("loc_id >= 8"), {"mean": {"unit": "1"}})
    days = events.groupBy("loc_id", "combo", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("total"))
    kept.add_series(days.join(kept.read_locations(None).select("loc_id", "combo", "idx"), ["loc_id", "combo"]))
    return kept


@query("with " + _MEANS + " select loc_id, idx::int as idx, combo, n, round(mean, 6) as mean from i")
def stored_results(spark, sf_dir):
    """Location rows of all combinations, numbered as they were added, read back from their tables."""
    return round_all(_stored(spark, sf_dir).read_locations(None).select("loc_id", "idx", "combo", "n", "mean"))


@query(
    "with " + _MEANS + ", d as (select user_id % 16 as loc_id, event_type as combo, date_trunc('day', ts) as ts, round(sum(value), 4) as total from events group by 1, 2, 3) "
    "select d.loc_id, combo, idx::int as idx, ts, total, round(date_diff('day', date '1900-01-01', cast(ts as date)), 6)::double as days from d join i using (loc_id, combo)"
)
def stored_series(spark, sf_dir):
    """The series of all locations and combinations, read back with their times as days since 1900."""
    got = _stored(spark, sf_dir).read_all_series()
    return got.select("loc_id", "combo", "idx", from_days(to_days(F.col("ts"))).alias("ts"), rounded("total", 4).alias("total"), to_days(F.col("ts")).alias("days"))


@query("with " + _MEANS + " select loc_id, combo, loc_id * 20.0 - 150 as lon, loc_id % 7 * 10.0 - 30 as lat, idx::int as idx from i")
def stored_lookup(spark, sf_dir):
    """Result rows found again by their coordinates."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("loc_id"), F.col("event_type").alias("combo")).distinct()
    places = events.withColumns({"lon": F.col("loc_id") * 20.0 - 150, "lat": F.col("loc_id") % 7 * 10.0 - 30})
    kept = Results(spark, fresh_folder(spark, "results"))
    kept.add_metrics(places)
    points = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("loc_id")).distinct().select("loc_id", (F.col("loc_id") * 20.0 - 150).alias("lon"), (F.col("loc_id") % 7 * 10.0 - 30).alias("lat"))
    return kept.indices_of(points.select("lon", "lat"), None).join(points, ["lon", "lat"]).select("loc_id", "combo", "lon", "lat", "idx")


@query("select user_id % 16 as loc_id, (user_id % 16) // 3 as cell, event_type as combo, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2, 3")
def resumed_results(spark, sf_dir):
    """Results by cell of a run that stops half-way and of another that completes it: each location and combination once."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("loc_id"), F.col("event_type").alias("combo"), "value")
    places = events.select("loc_id").distinct().withColumn("cell", F.floor(F.col("loc_id") / 3))
    kept = CellResults(spark, fresh_folder(spark, "cells"))

    def means(locations):
        return events.join(F.broadcast(locations.select("loc_id")), "loc_id").groupBy("loc_id", "combo").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))

    kept.complete(places, means, "first", batches=4, most=2)
    kept.complete(places, means, "second", batches=3)
    return round_all(kept.read().select("loc_id", F.col("cell").cast("long").alias("cell"), "combo", "n", "mean"))


@query(
    "with l as (select l_suppkey as loc_id, l_quantity as x, l_extendedprice / 1999.7 as y from lineitem) select l.loc_id, count(*)::int as n_obs, round(avg(x - y), 8) as \"BIAS\", any_value(s_name) as s_name, any_value(s_nationkey) as s_nationkey "
    "from l left join supplier on l.loc_id = s_suppkey group by 1"
)
def metadata_calculator(spark, sf_dir):
    """A calculator's rows with fields of the locations' table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("loc_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1999.7).alias("y"))
    places = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "loc_id")
    run = calculators.with_metadata(calculators.basic("x", "y"), places, ["s_name", "s_nationkey"])
    return round_all(run(rows, ["loc_id"]).select("loc_id", "n_obs", "BIAS", "s_name", "s_nationkey"), 8)
