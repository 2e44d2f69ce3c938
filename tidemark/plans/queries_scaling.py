"""Queries of bias correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import scaling
from .inputs import fresh_folder, round_all, rounded, table

_P = "with p as (select l_orderkey, l_linenumber, l_suppkey as loc_id, l_quantity as x, l_extendedprice / 1000 as y from lineitem), s as (select loc_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, avg(x) as mx, avg(y) as my, stddev_pop(x) as sx, stddev_pop(y) as sy, regr_slope(y, x) as b, regr_intercept(y, x) as a from p group by 1) "
_OUT = "select p.l_orderkey, p.l_linenumber, p.loc_id, p.y, round({0}, 6) as x from p join s on p.loc_id = s.loc_id"


def pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("loc_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(_P + _OUT.format("(x - x0) / (x1 - x0) * (y1 - y0) + y0"))
def scale_min_max(spark, sf_dir):
    got = scaling.scaled(pairs(spark, sf_dir), "x", "y", "min_max")
    return got.withColumn("x", F.round("x", 6))


@query(_P + _OUT.format("(x - mx) / sx * sy + my"))
def scale_mean_std(spark, sf_dir):
    got = scaling.scaled(pairs(spark, sf_dir), "x", "y", "mean_std")
    return got.withColumn("x", F.round("x", 6))


@query(_P + _OUT.format("abs(b) * x + a"))
def scale_linreg(spark, sf_dir):
    got = scaling.scaled(pairs(spark, sf_dir), "x", "y", "linreg")
    return got.withColumn("x", F.round("x", 6))


@query(_P + "select loc_id, round(b, 8) as slope, round(a, 6) as intercept from s")
def linreg_parameters(spark, sf_dir):
    got = scaling.moment_parameters(pairs(spark, sf_dir), "x", "y", ["loc_id"])
    return got.select("loc_id", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _hazen(value: str, percentiles: str, name: str) -> str:
    """CTEs up to name(loc_id, percentile, k, value): Hazen percentiles of a column of p; k numbers the percentiles from 0."""
    return (
        f"{name}_r as materialized (select loc_id, {value} as v, row_number() over (partition by loc_id order by {value}) - 1 as i, count(*) over (partition by loc_id) as n from p), "
        f"{name}_a as materialized (select *, cast(floor(pos) as bigint) as low, least(cast(floor(pos) as bigint) + 1, n - 1) as high from (select loc_id, n, percentile, k, greatest(0.0, least(percentile / 100 * n - 0.5, n - 1.0)) as pos "
        f"from (select distinct loc_id, n from {name}_r), (select unnest({percentiles})::double as percentile, generate_subscripts({percentiles}, 1) - 1 as k))), "
        f"{name} as (select a.loc_id, a.percentile, a.k, l.v + (a.pos - a.low) * (h.v - l.v) as value from {name}_a a join {name}_r l on a.loc_id = l.loc_id and l.i = a.low join {name}_r h on a.loc_id = h.loc_id and h.i = a.high)"
    )


def _untied(name: str) -> str:
    """CTE {name}_u(loc_id, k, value): equal values spread on a line from the first of them to the next value; the last value belongs to the last percentile."""
    return (
        f"{name}_f as (select loc_id, k, percentile, value from (select *, lag(value) over (partition by loc_id order by k) as before from {name}) where before is null or value > before), "
        f"{name}_g as (select loc_id, count(*) as kinds, max(k) as last from {name}_f group by 1), "
        f"{name}_k as (select f.loc_id, f.value, case when f.k = g.last then (select max(percentile) from {name}) else f.percentile end as at, lead(f.value) over w as v2, lead(case when f.k = g.last then (select max(percentile) from {name}) else f.percentile end) over w as at2 "
        f"from {name}_f f join {name}_g g on f.loc_id = g.loc_id window w as (partition by f.loc_id order by f.k)), "
        f"{name}_u as (select h.loc_id, h.k, case when g.kinds = 1 then h.value else (select min(z.value + (h.percentile - z.at) * (z.v2 - z.value) / (z.at2 - z.at)) from {name}_k z where z.loc_id = h.loc_id and z.at2 is not null and h.percentile >= z.at and (h.percentile < z.at2 or (h.percentile = z.at2 and z.at2 = 100))) end as value "
        f"from {name} h join {name}_g g on h.loc_id = g.loc_id)"
    )


_NINE = "[0.0, 5.0, 10.0, 30.0, 50.0, 70.0, 90.0, 95.0, 100.0]"


@query(_P + ", " + _hazen("y", _NINE, "h") + " select loc_id, percentile, round(value, 9) as value from h")
def hazen_percentiles(spark, sf_dir):
    return round_all(scaling.rank_percentiles(pairs(spark, sf_dir), "y"), 9)


_CDF = f"{_P}, {_hazen('x', _NINE, 'hx')}, {_hazen('y', _NINE, 'hy')}, {_untied('hx')}, {_untied('hy')}"


@query(_CDF + " select a.loc_id, a.k::int as k, round(a.value, 9) as x_perc, round(b.value, 9) as y_perc from hx_u a join hy_u b on a.loc_id = b.loc_id and a.k = b.k")
def cdf_parameters(spark, sf_dir):
    """The parameters of every location, a row for each percentile."""
    got = scaling.cdf_parameters(pairs(spark, sf_dir), "x", "y", percentiles=list(scaling.PERCENTILES))
    return round_all(got.select("loc_id", F.posexplode(F.arrays_zip("x_perc", "y_perc")).alias("k", "c")).select("loc_id", "k", "c.x_perc", "c.y_perc"), 9)


_CARRIED = (
    _CDF + ", c as (select a.loc_id, a.k, a.value as x1, b.value as y1, lead(a.value) over w as x2, lead(b.value) over w as y2 from hx_u a join hy_u b on a.loc_id = b.loc_id and a.k = b.k window w as (partition by a.loc_id order by a.k)), "
    "seg as (select *, row_number() over (partition by loc_id order by k) as first, row_number() over (partition by loc_id order by k desc) as last from c where x2 is not null) "
    "select p.l_orderkey, p.l_linenumber, p.loc_id, p.y, round(s.y1 + (p.x - s.x1) * (s.y2 - s.y1) / (s.x2 - s.x1), 9) as x from p join seg s on p.loc_id = s.loc_id and (p.x >= s.x1 or first = 1) and (p.x < s.x2 or last = 1)"
)


@query(_CARRIED)
def stored_cdf(spark, sf_dir):
    """CDF parameters fitted in two goes and kept in a table: the second go fits only the locations that lack some."""
    df = pairs(spark, sf_dir)
    kept = scaling.StoredCdf(spark, fresh_folder(spark, "cdf"))
    kept.scale(df.filter("loc_id % 2 = 0"), "x", "y")
    return kept.scale(df, "x", "y").withColumn("x", F.round("x", 9))


def _hazen_list(v: str, n: str, at: str) -> str:
    """Hazen percentiles of a sorted list v of n values, at percentiles in a list."""
    place = f"greatest(0.0, least(c / 100 * {n} - 0.5, {n} - 1.0))"
    low = f"cast(floor({place}) as bigint)"
    return f"list_transform({at}, lambda c: {v}[{low} + 1] + ({place} - {low}) * ({v}[least({low} + 2, {n})] - {v}[{low} + 1]))"


def _untied_lists(name: str, source: str, by: str) -> str:
    """CTEs up to name(by, h, pc): percentile values h of source(by, h, pc) with equal ones spread."""
    return (
        f"{name}_f as (select *, list_filter(range(1, len(h) + 1), lambda i: i = 1 or h[i] > h[i - 1]) as f from {source}), "
        f"{name}_k as (select *, list_transform(f, lambda i: case when i = f[len(f)] then pc[len(pc)] else pc[i] end) as kx, list_transform(f, lambda i: h[i]) as ky from {name}_f), "
        f"{name}_j as (select *, list_transform(pc, lambda c: greatest(1, least(len(f) - 1, len(list_filter(kx, lambda t: t <= c))))) as js from {name}_k), "
        f"{name} as (select {by}, pc, case when len(f) in (1, len(h)) then h else list_transform(range(1, len(pc) + 1), lambda i: ky[js[i]] + (pc[i] - kx[js[i]]) * (ky[js[i] + 1] - ky[js[i]]) / (kx[js[i] + 1] - kx[js[i]])) end as h from {name}_j)"
    )


def cdf_sql(source: str, by: str) -> str:
    """CTEs up to cdf(by, px, py): the default parameters of CDF matching for source(by, x, y), of rows without nulls."""
    return (
        f"ca as (select {by}, list_sort(list(x)) as x, list_sort(list(y)) as y, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a from {source} group by {by}), "
        "cb as (select *, case when n / 100.0 < 20 then least(greatest(1, n // 20), 100) else 100 end as m from ca), "
        "cq as (select *, list_transform(range(m + 1), lambda i: case when i = m then 100.0::double else i * (100.0::double / m) end) as pc from cb), "
        f"ch as (select {by}, side, pc, {_hazen_list('v', 'n', 'pc')} as h from (select {by}, n, pc, 'x' as side, x as v from cq union all select {by}, n, pc, 'y', y from cq)), "
        + _untied_lists("cu", "ch", f"{by}, side") + ", "
        f"cp as (select cq.*, u.h as px, w.h as py from cq join cu u using ({by}) join cu w using ({by}) where u.side = 'x' and w.side = 'y'), "
        f"ce as (select {by}, 0 as tail, list_transform(list_filter(x, lambda t: t <= px[2]), lambda t: t - px[2]) as u, list_transform(list_filter(y, lambda t: t <= py[2]), lambda t: t - py[2]) as w from cp where m > 1 "
        f"union all select {by}, 1, list_transform(list_filter(x, lambda t: t >= px[m]), lambda t: t - px[m]), list_transform(list_filter(y, lambda t: t >= py[m]), lambda t: t - py[m]) from cp where m > 1), "
        f"cr as (select {by}, tail, {_hazen_list('u', 'len(u)', 'pc')} as h, pc from (select *, case when len(w) = 1 then [0.0::double] else list_transform(range(len(w)), lambda i: i * (100.0::double / (len(w) - 1))) end as pc from ce) where len(u) != len(w)), "
        + _untied_lists("ct", "cr", f"{by}, tail") + ", "
        f"cs as (select {by}, tail, case when len(u) = len(w) then u else h end as u, w from ce left join ct using ({by}, tail)), "
        f"cd as (select {by}, tail, coalesce(list_dot_product(u, w) / nullif(list_dot_product(u, u), 0), 0) as slope from cs), "
        f"cdf as (select cp.* exclude (px, py), case when m = 1 then [0.0::double, 1.0::double] else px end as px, case when m = 1 then [a, a + b] else list_concat([py[2] + l.slope * (px[1] - px[2])], py[2:m], [py[m] + r.slope * (px[m + 1] - px[m])]) end as py "
        f"from cp left join (select * from cd where tail = 0) l using ({by}) left join (select * from cd where tail = 1) r using ({by}))"
    )


def carried_sql(x: str) -> str:
    """x carried over by the lists px and py; null where px doesn't increase."""
    j = f"greatest(1, least(len(px) - 1, len(list_filter(px, lambda t: t <= {x}))))"
    return f"case when len(list_filter(range(2, len(px) + 1), lambda i: not px[i] > px[i - 1])) = 0 then py[{j}] + ({x} - px[{j}]) * (py[{j} + 1] - py[{j}]) / (px[{j} + 1] - px[{j}]) end"


@query(_P + ", " + cdf_sql("p", "loc_id") + f" select p.l_orderkey, p.l_linenumber, p.loc_id, p.y, round({carried_sql('p.x')}, 8) + 0.0 as x from p join cdf using (loc_id)")
def cdf_matching(spark, sf_dir):
    """Every row carried over by its location's default parameters, ends by regression."""
    return scaling.cdf_match(pairs(spark, sf_dir), "x", "y").withColumn("x", rounded("x", 8))
