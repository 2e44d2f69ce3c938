"""Queries of agreement metrics, triple collocation and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import moments
from ..operators import calculators, frames, intervals, ranks, triple
from . import statistics_sql as statistics
from .inputs import round_all, table
from .queries_matching import _MOMENTS

COLUMNS = ["qty", "price", "disc", "tax"]
_L = "with l as (select l_suppkey as loc_id, l_shipdate as ts, l_quantity as qty, l_extendedprice / 1999.7 as price, l_discount * 397.1 as disc, l_tax * 501.3 as tax from lineitem)"

_LR = _L.replace("with l", "with recursive l", 1)


def items(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_suppkey").alias("loc_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / 1999.7).alias("price"), (F.col("l_discount") * 397.1).alias("disc"), (F.col("l_tax") * 501.3).alias("tax"))


@query(_L + ", p as (select loc_id, qty as x, price as y from l), " + _MOMENTS)
def pairwise_metrics(spark, sf_dir):
    got = round_all(moments.pairwise(items(spark, sf_dir), ["loc_id"], "qty", "price"), 9)
    return got.withColumn("rss", F.round("rss", 5))


@query(_L + "select loc_id, round(sqrt(sum((qty-price)*(qty-price)) / (count(*) - 1)), 6) as rmsd from l group by 1")
def rmsd_ddof(spark, sf_dir):
    return round_all(moments.rmsd(items(spark, sf_dir), ["loc_id"], "qty", "price", 1))


@query(_L + "select loc_id, round(median(abs(qty - price)), 6) as mad from l group by 1")
def median_absolute_difference(spark, sf_dir):
    return round_all(ranks.mad(items(spark, sf_dir), ["loc_id"], "qty", "price"))


@query(_L + ", a as (select *, avg(qty) over (partition by loc_id) as m from l) select loc_id, round(1 - sum((qty-price)*(qty-price)) / sum(pow(abs(price-m) + abs(qty-m), 2)), 6) as index_of_agreement from a group by 1")
def index_of_agreement(spark, sf_dir):
    return round_all(moments.index_of_agreement(items(spark, sf_dir), ["loc_id"], "qty", "price"))


def _cov_sql(source: str, names: list[str], by: str = "loc_id") -> str:
    """Subquery (by, n, c00, c01, ...) of sample covariances. Ratios of them magnify the errors of sums, so that digits would depend on
    the order of adding up: deviations are those from a rounded mean, and sums are compensated ones."""
    of = range(len(names))
    middles = ", ".join(f"least(greatest(avg({c})::float::double, min({c})), max({c})) as m{i}" for i, c in enumerate(names))
    sums = ", ".join([f"fsum({c} - m{i}) as s{i}" for i, c in enumerate(names)] + [f"fsum(({names[i]} - m{i}) * ({names[j]} - m{j})) as s{i}{j}" for i in of for j in of if i <= j])
    cells = ", ".join(f"(s{i}{j} - s{i} * s{j} / n) / (n - 1) as c{i}{j}" for i in of for j in of if i <= j)
    return f"(select {by}, n, {cells} from (select {by}, count(*) as n, {sums} from {source} join (select {by}, {middles} from {source} group by all) using ({by}) group by {by}))"


def _triple_cells(i: int, ref: int = 0, absolute: bool = True) -> tuple[str, str, str]:
    """SQL of snr, err_std and beta of the i-th of three datasets, by covariances c00 to c22."""

    def c(a, b):
        return f"c{min(a, b)}{max(a, b)}"

    j, k = (x for x in range(3) if x != i)
    share = f"{c(i, i)} * {c(j, k)} / ({c(i, j)} * {c(i, k)})"
    noise = f"abs(abs({share}) - 1)" if absolute else f"({share} - 1)"
    var = f"({c(i, i)} - {c(i, j)} * {c(i, k)} / {c(j, k)})"
    other = next(x for x in range(3) if x not in (i, ref))
    beta = "1.0::double" if i == ref else f"({c(ref, other)} / {c(i, other)})"
    return f"case when {noise} > 0 then -10 * log10({noise}) end", f"case when {var} >= 0 then sqrt(greatest({var}, 0)) * {beta} end", beta


def _triple_sql(i: int, ref: int = 0, absolute: bool = True, more: str = "") -> str:
    snr, err, beta = _triple_cells(i, ref, absolute)
    return f"select loc_id, '{COLUMNS[i]}' as dataset, n as n_obs, round({snr}, 4) as snr, round({err}, 4) as err_std, round({beta}, 4) as beta{more} from c"


_TRIPLE = _L + f", c as {_cov_sql('l', COLUMNS[:3])} "


@query(_TRIPLE + " union all ".join(_triple_sql(i) for i in range(3)))
def triple_collocation(spark, sf_dir):
    return round_all(triple.triple_collocation(items(spark, sf_dir), COLUMNS[:3]), 4)


@query(_TRIPLE + " union all ".join(_triple_sql(i, 0, False) for i in range(3)))
def triple_snr_signed(spark, sf_dir):
    return round_all(triple.triple_collocation(items(spark, sf_dir), COLUMNS[:3], absolute=False), 4)


@query(_L + "select loc_id, round(sqrt(abs(avg((qty-price)*(qty-disc)))), 6) as err_qty, round(sqrt(abs(avg((price-qty)*(price-disc)))), 6) as err_price, round(sqrt(abs(avg((disc-qty)*(disc-price)))), 6) as err_disc from l group by 1")
def triple_errors(spark, sf_dir):
    return round_all(triple.triple_error(items(spark, sf_dir), "qty", "price", "disc"))


#: The errors of qty and price are correlated: signals by hand from the covariances that no correlated pair is in.
_EXTENDED = (
    f"c as {_cov_sql('l', COLUMNS)}, "
    "s as (select *, c02 * c03 / c23 as s0, c12 * c13 / c23 as s1, (c02 * c23 / c03 + c12 * c23 / c13) / 2 as s2, (c03 * c23 / c02 + c13 * c23 / c12) / 2 as s3, (c02 * c13 / c23 + c03 * c12 / c23) / 2 as s01 from c), "
    "e as (select loc_id, " + ", ".join(f"abs(s{i}) as sig_{c}, abs(c{i}{i} - s{i}) as err_{c}" for i, c in enumerate(COLUMNS)) + ", c01 - s01 as cov from s) "
)


@query(
    _L + ", " + _EXTENDED + "select loc_id, " + ", ".join(f"round(sig_{c}, 4) as sig_{c}, round(err_{c}, 4) as err_{c}, round(10 * log10(sig_{c} / err_{c}), 4) as snr_{c}" for c in COLUMNS)
    + ", round(cov, 4) as err_cov_qty_price, round(cov / sqrt(err_qty * err_price), 4) as err_corr_qty_price from e"
)
def extended_collocation(spark, sf_dir):
    return round_all(triple.extended_collocation(items(spark, sf_dir), COLUMNS, [("qty", "price")]), 4)


def _rank(c: str) -> str:
    return f"rank() over (partition by loc_id order by {c}) + (count(*) over (partition by loc_id, {c}) - 1) / 2.0"


@query(_L + f", r as (select loc_id, {_rank('qty')} as a, {_rank('price')} as b from l) select loc_id, count(*) as n_obs, round(covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)), 6) as rho from r group by 1")
def spearman_rho(spark, sf_dir):
    return round_all(ranks.spearman(items(spark, sf_dir), "qty", "price", with_p=False))


def _tau(x: str, y: str) -> str:
    """Tables k(loc_id, n_obs) and p: by location, the pairs' signs added up. Distinct value pairs are joined, not rows."""
    return (
        f"c as (select loc_id, {x} as x, {y} as y, count(*) as w from l group by 1, 2, 3), k as (select loc_id, count(*) as n_obs from l group by 1), "
        "p as (select a.loc_id, sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) as s, sum(a.w * b.w * abs(sign(a.x - b.x))) as x, sum(a.w * b.w * abs(sign(a.y - b.y))) as y "
        "from c a join c b on a.loc_id = b.loc_id and (a.x, a.y) < (b.x, b.y) group by 1)"
    )


@query(_L + ", " + _tau("disc", "tax") + " select k.loc_id, n_obs, round(s / nullif(sqrt(x::double * y), 0), 6) as tau from k left join p on k.loc_id = p.loc_id")
def kendall_tau(spark, sf_dir):
    """tau of every location from all its rows, nearly all of them tied (11 x 9 distinct pairs)."""
    return round_all(ranks.kendall(items(spark, sf_dir), "disc", "tax").drop("p_tau"))


@query(_L + ", " + _tau("qty", "disc") + " select k.loc_id, n_obs, round(s / nullif(sqrt(x::double * y), 0), 6) as tau from k left join p on k.loc_id = p.loc_id")
def kendall_tau_all(spark, sf_dir):
    """tau of every location from all its rows (50 x 11 distinct pairs)."""
    return round_all(ranks.kendall(items(spark, sf_dir), "qty", "disc").drop("p_tau"))


def _ties(c: str) -> str:
    """Of each location: pairs that are equal in c, and the sums that the variance of tau needs."""
    return f"t{c} as (select loc_id, sum(t * (t - 1) / 2) as pairs, sum(t * (t - 1) * (t - 2)) as three, sum(t * (t - 1) * (2 * t + 5)) as five from (select loc_id, count(*)::double as t from l group by loc_id, {c}) group by 1)"


#: By n up to 33, the chances that a random order has 0, 1, ... pairs in the wrong order, added up.
_ORDERS = (
    "o as (select 1 as n, list_prepend(1.0::double, list_transform(range(528), lambda x: 0.0::double)) as c union all "
    "select n + 1, list_transform(range(1, 530), lambda i: list_sum(c[greatest(1, i - n):i]) / (n + 1)) from o where n < 33), "
    "exact as (select n, list_transform(range(1, 530), lambda i: list_sum(c[1:i])) as upto from o)"
)


@query(
    "with recursive l as (select c_custkey % 97 as loc_id, cast(c_custkey * 7919 % 10007 as double) as x, c_acctbal as y from customer), " + _tau("x", "y") + ", " + _ties("x") + ", " + _ties("y") + ", " + _ORDERS
    + ", z as (select k.loc_id, n_obs, s / nullif(sqrt(x::double * y), 0) as tau, tx.pairs + ty.pairs as tied, cast((n_obs * (n_obs - 1) / 2 - abs(s)) / 2 as bigint) as fewer, "
    "abs(s) / sqrt((n_obs * (n_obs - 1.0) * (2 * n_obs + 5) - tx.five - ty.five) / 18 + 2 * tx.pairs * ty.pairs / (n_obs * (n_obs - 1.0)) + case when n_obs > 2 then tx.three * ty.three / (9.0 * n_obs * (n_obs - 1.0) * (n_obs - 2)) else 0 end) as z "
    "from k left join p on k.loc_id = p.loc_id left join tx on k.loc_id = tx.loc_id left join ty on k.loc_id = ty.loc_id) "
    "select loc_id, n_obs, round(tau, 6) as tau, round(case when tau is null then null when tied = 0 and n_obs <= 33 then case when 4 * fewer = n_obs * (n_obs - 1) then 1 else least(1, 2 * upto[fewer + 1]) end "
    f"else {statistics.erfc('(z / sqrt(2))')} end, 6) + 0.0 as p_tau from z left join exact on exact.n = z.n_obs"
)
def kendall_tau_untied(spark, sf_dir):
    """tau and its p-value of columns nearly without ties: exact for locations of up to 33 rows."""
    t = table(spark, sf_dir, "customer")
    rows = t.select((F.col("c_custkey") % 97).alias("loc_id"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y"))
    return round_all(ranks.kendall(rows, "x", "y"))


_RHO = f"r as (select loc_id, {_rank('qty')} as a, {_rank('{0}')} as b from l), rho as (select loc_id, count(*) as n, covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) as rho from r group by 1)"


@query(
    _L + ", " + _tau("qty", "disc") + ", " + _ties("qty") + ", " + _ties("disc") + ", " + _RHO.format("disc")
    + ", z as (select p.loc_id, n_obs, s / sqrt(x::double * y) as tau, abs(s) / sqrt((n_obs * (n_obs - 1.0) * (2 * n_obs + 5) - a.five - b.five) / 18 + 2 * a.pairs * b.pairs / (n_obs * (n_obs - 1.0)) + a.three * b.three / (9.0 * n_obs * (n_obs - 1.0) * (n_obs - 2))) as z "
    "from p join k on p.loc_id = k.loc_id join tqty a on p.loc_id = a.loc_id join tdisc b on p.loc_id = b.loc_id) "
    f"select z.loc_id, n_obs, round(rho, 6) as rho, round({statistics.correlation_p('rho', 'n')}, 6) + 0.0 as p_rho, round(tau, 6) as tau, round({statistics.erfc('(z / sqrt(2))')}, 6) + 0.0 as p_tau from z join rho on z.loc_id = rho.loc_id"
)
def rank_p_values(spark, sf_dir):
    df = items(spark, sf_dir)
    tau = ranks.kendall(df, "qty", "disc").select("loc_id", "tau", "p_tau")
    return round_all(ranks.spearman(df, "qty", "disc").join(tau, "loc_id"))


@query(_L + ", m as (select loc_id, count(*) as n, covar_pop(qty, price) / sqrt(var_pop(qty) * var_pop(price)) as r from l group by 1) select loc_id, n as n_obs, round(r, 6) as pearson_r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) as lower, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) as upper from m")
def pearson_interval(spark, sf_dir):
    return round_all(intervals.analytical(items(spark, sf_dir), "qty", "price", "pearson_r"))


_M = "m as (select loc_id, count(*) as n, count(*) - 1 as nu, avg(qty - price) as b, var_pop(qty - price) as v, covar_pop(qty, price) / sqrt(var_pop(qty) * var_pop(price)) as r from l group by 1)"


@query(_LR + f", {_M}, {statistics.t_quantiles('t', 'm')} select loc_id, n as n_obs, round(b, 6) as bias, round(b - sqrt(v / m.nu) * sqrt(m.nu) * tan(lo), 6) as lower, round(b + sqrt(v / m.nu) * sqrt(m.nu) * tan(lo), 6) as upper from m join t on m.nu = t.nu and t.i = 60")
def bias_interval(spark, sf_dir):
    return round_all(intervals.analytical(items(spark, sf_dir), "qty", "price", "bias"))


@query(
    _LR + f", {_M}, {statistics.chi2_quantiles('h', 'm', 0.975)}, {statistics.chi2_quantiles('d', 'm', 0.025)} "
    "select loc_id, n as n_obs, round(sqrt(v), 6) as ubrmsd, round(sqrt(n * v / h.lo), 6) as lower, round(sqrt(n * v / d.lo), 6) as upper from m join h on m.nu = h.nu and h.i = 60 join d on m.nu = d.nu and d.i = 60"
)
def ubrmsd_interval(spark, sf_dir):
    return round_all(intervals.analytical(items(spark, sf_dir), "qty", "price", "ubrmsd"))


@query(None)
def bootstrap_interval(spark, sf_dir):
    return intervals.bootstrapped(items(spark, sf_dir), "qty", "price", "rmsd", nsamples=200, seed=7)


@query(_L + " select loc_id, count(*) as n_obs, round(avg(qty - price), 6) + 0.0 as bias, round(sqrt(avg((qty - price) * (qty - price))), 6) as rmsd, round(covar_pop(qty, price) / sqrt(var_pop(qty) * var_pop(price)), 6) as r, true as inside from l group by 1")
def bootstrap_values(spark, sf_dir):
    """What is certain of resampled metrics: their values, and that these lie within their intervals of 99.9 %."""
    names = {"bias": "bias", "rmsd": "rmsd", "r": "pearson_r"}
    got = intervals.bootstrapped_many(items(spark, sf_dir), "qty", "price", names, alpha=0.001, nsamples=200, seed=7)
    within = [F.col(n).between(F.col(f"{n}_lower"), F.col(f"{n}_upper")) for n in names]
    return round_all(got.select("loc_id", "n_obs", *names, (within[0] & within[1] & within[2]).alias("inside")))


@query(None)
def bootstrap_triple(spark, sf_dir):
    return intervals.bootstrapped_triple(items(spark, sf_dir), COLUMNS[:3], nsamples=100, seed=7)


_PAIRWISE_LONG = " union all ".join(
    f"select loc_id, '{a}_and_{b}' as pair, count(*) as n_obs, round(avg({a} - {b}), 6) as bias, round(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})), 6) as pearson_r, round(sqrt(avg(({a}-{b})*({a}-{b}))), 6) as rmsd from l group by 1"
    for i, a in enumerate(COLUMNS)
    for b in COLUMNS[i + 1 :]
)


@query(_L + _PAIRWISE_LONG)
def all_pairs(spark, sf_dir):
    """Metrics of every pair of columns in one shuffle, as long rows."""
    return round_all(frames.pairwise_long(items(spark, sf_dir), COLUMNS, ["n_obs", "bias", "pearson_r", "rmsd"], ["loc_id"]))


@query(_L + "select loc_id, v.row, round(case v.row when 'qty' then 0.0 when 'price' then avg(price-qty) else avg(disc-qty) end, 6) as qty, round(case v.row when 'qty' then avg(qty-price) when 'price' then 0.0 else avg(disc-price) end, 6) as price, round(case v.row when 'qty' then avg(qty-disc) when 'price' then avg(price-disc) else 0.0 end, 6) as disc from l cross join (select unnest(['qty', 'price', 'disc']) as row) v group by 1, 2")
def pairwise_matrix(spark, sf_dir):
    """The bias of every ordered pair as a matrix by location."""
    return round_all(frames.pairwise_matrix(items(spark, sf_dir), COLUMNS[:3], "bias", ["loc_id"]))


def _all_triples_sql() -> str:
    parts = []
    for other in ((1, 2), (1, 3), (2, 3)):
        names = [COLUMNS[0], *(COLUMNS[k] for k in other)]
        for i, name in enumerate(names):
            snr, err, beta = _triple_cells(i)
            parts.append(f"select loc_id, '{name}' as dataset, n as n_obs, round({snr}, 4) as snr, round({err}, 4) as err_std, round({beta}, 4) as beta, '{'_'.join(names)}' as triple from {_cov_sql('l', names)}")
    return " union all ".join(parts)


@query(_L + _all_triples_sql())
def all_triples(spark, sf_dir):
    return round_all(triple.all_triples(items(spark, sf_dir), COLUMNS, "qty"), 4)


_SEASON = "case when month(ts) in (12, 1, 2) then 'DJF' when month(ts) in (3, 4, 5) then 'MAM' when month(ts) in (6, 7, 8) then 'JJA' else 'SON' end"
_SUBSET = _L + f", s as (select *, {_SEASON} as subset from l union all select *, 'ALL' as subset from l) select loc_id, subset, count(*)::int as n_obs, {{0}} from s group by 1, 2"


@query(
    _SUBSET.format("round(avg(qty - price), 6) as \"BIAS\", round(sqrt(avg((qty-price)*(qty-price))), 6) as \"RMSD\", round(covar_pop(qty, price) / sqrt(var_pop(qty) * var_pop(price)), 6) as \"R\", round(sqrt(var_pop(qty - price)), 6) as urmsd, case when count(*) < 10 then 1 else 0 end as status")
)
def seasonal_pairwise(spark, sf_dir):
    """The pairwise calculator by season and for all the year, in one plan."""
    run = calculators.months(calculators.pairwise("qty", "price", calc_spearman=False, analytical_cis=False))
    return round_all(run(items(spark, sf_dir), ["loc_id"]).select("loc_id", "subset", "n_obs", "BIAS", "RMSD", "R", "urmsd", "status"))


def _pair_cells(x: str, y: str) -> dict[str, str]:
    """SQL of the metrics of two columns, as aggregates."""
    sx, sy, r = f"stddev_pop({x})", f"stddev_pop({y})", f"covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y}))"
    parts = {"mse_corr": f"2 * {sx} * {sy} - 2 * covar_pop({x}, {y})", "mse_var": f"pow({sx} - {sy}, 2)", "mse_bias": f"pow(avg({x}) - avg({y}), 2)"}
    whole = f"avg(({x} - {y}) * ({x} - {y}))"
    return {"R": r, "BIAS": f"avg({x} - {y})", "mse": whole, **parts, "RSS": f"sum(({x} - {y}) * ({x} - {y}))", "RMSD": f"sqrt({whole})", "urmsd": f"sqrt(var_pop({x} - {y}))"}


_CELLS = ", ".join(f'{v} as "{k}"' for k, v in _pair_cells("qty", "price").items())
_CALCULATED = f"m as (select loc_id, count(*) as n, count(*) - 1 as nu, {_CELLS} from l group by 1)"
_HALF = "1.959963984540054 / sqrt(m.n - 3)"


def _rounded(names) -> str:
    return ", ".join(f'round("{k}", {8 if k == "BIAS" else 5}) + 0.0 as "{k}"' for k in names)


@query(
    _LR + f", {_CALCULATED}, {_RHO.format('price')}, {statistics.t_quantiles('t', 'm')}, {statistics.chi2_quantiles('h', 'm', 0.975)}, {statistics.chi2_quantiles('d', 'm', 0.025)} "
    f"select m.loc_id, m.n::int as n_obs, {_rounded(_pair_cells('qty', 'price'))}, 0 as status, round({statistics.correlation_p(chr(34) + 'R' + chr(34), 'm.n')}, 5) + 0.0 as \"p_R\", round(rho, 5) as rho, round({statistics.correlation_p('rho', 'm.n')}, 5) + 0.0 as p_rho, "
    'round("BIAS" - urmsd * tan(t.lo), 8) as "BIAS_ci_lower", round("BIAS" + urmsd * tan(t.lo), 8) as "BIAS_ci_upper", round(sqrt(m.n / h.lo) * urmsd, 5) as urmsd_ci_lower, round(sqrt(m.n / d.lo) * urmsd, 5) as urmsd_ci_upper, '
    f'round(tanh(atanh("R") - {_HALF}), 5) as "R_ci_lower", round(tanh(atanh("R") + {_HALF}), 5) as "R_ci_upper", round(tanh(atanh(rho) - sqrt(1 + rho * rho / 2) * {_HALF}), 5) as rho_ci_lower, round(tanh(atanh(rho) + sqrt(1 + rho * rho / 2) * {_HALF}), 5) as rho_ci_upper '
    "from m join rho on m.loc_id = rho.loc_id join t on m.nu = t.nu and t.i = 60 join h on m.nu = h.nu and h.i = 60 join d on m.nu = d.nu and d.i = 60"
)
def pairwise_calculator(spark, sf_dir):
    return round_all(calculators.pairwise("qty", "price")(items(spark, sf_dir), ["loc_id"]), 5, "bias")


@query(
    _L + f", {_CALCULATED}, {_RHO.format('price')} select m.loc_id, m.n::int as n_obs, {_rounded(['R', 'RMSD', 'BIAS', 'mse', 'mse_corr', 'mse_bias', 'mse_var'])}, 0 as status, "
    f"round({statistics.correlation_p(chr(34) + 'R' + chr(34), 'm.n')}, 5) + 0.0 as \"p_R\", round(rho, 5) as rho, round({statistics.correlation_p('rho', 'm.n')}, 5) + 0.0 as p_rho from m join rho on m.loc_id = rho.loc_id"
)
def basic_calculator(spark, sf_dir):
    return round_all(calculators.basic("qty", "price", mse=True)(items(spark, sf_dir), ["loc_id"]), 5, "bias")


def _between_sql(more: str = "", cells: str = "") -> str:
    """The wide rows of three columns' pairs; urmsd is that of series scaled to each other. more: CTEs, cells: further columns."""
    pairs = [(a, b) for i, a in enumerate(COLUMNS[:3]) for b in COLUMNS[i + 1 : 3]]
    aggregates, out, ranked = [], [], []
    for a, b in pairs:
        got = {k.lower() if k in ("RSS", "RMSD", "BIAS") else k: v for k, v in _pair_cells(a, b).items()}
        got["urmsd"] = f"sqrt(greatest(2 * var_pop({a}) * (1 - {got['R']}), 0))"
        at = f"between_{a}_and_{b}"
        aggregates += [f'{v} as "{k}_{at}"' for k, v in got.items()]
        out += [f'round("{k}_{at}", {8 if k == "bias" else 5}) + 0.0 as "{k}_{at}"' for k in got]
        out.append(f"round({statistics.correlation_p(f'{chr(34)}R_{at}{chr(34)}', 'm.n')}, 5) + 0.0 as \"p_R_{at}\"")
        ranked.append(f"covar_pop(r_{a}, r_{b}) / sqrt(var_pop(r_{a}) * var_pop(r_{b})) as rho_{at}")
        out += [f"round(rho_{at}, 5) + 0.0 as rho_{at}", f"round({statistics.correlation_p(f'rho_{at}', 'm.n')}, 5) + 0.0 as p_rho_{at}"]
    ranks_of = ", ".join(f"{_rank(c)} as r_{c}" for c in COLUMNS[:3])
    return (
        _L + f", m as (select loc_id, count(*) as n, {', '.join(aggregates)} from l group by 1), q as (select loc_id, {ranks_of} from l), rho as (select loc_id, {', '.join(ranked)} from q group by 1){more} "
        f"select m.loc_id, m.n::int as n_obs, {', '.join(out)}{cells} from m join rho on m.loc_id = rho.loc_id" + (" join c on m.loc_id = c.loc_id" if more else "")
    )


@query(_between_sql())
def intercomparison_calculator(spark, sf_dir):
    return round_all(calculators.intercomparison(COLUMNS[:3], "qty", metrics_between_nonref=True)(items(spark, sf_dir), ["loc_id"]), 5, "bias")


def _wide_triple(name: str) -> str:
    return "".join(f", round({cell}, 5) + 0.0 as {metric}_{c}_between_{name}" for i, c in enumerate(COLUMNS[:3]) for metric, cell in zip(("snr", "err_std", "beta"), _triple_cells(i), strict=True))


@query(_between_sql(f", c as {_cov_sql('l', COLUMNS[:3])}", _wide_triple("_and_".join(COLUMNS[:3]))))
def triple_and_pairs_calculator(spark, sf_dir):
    """The intercomparison's rows with the metrics of the triple."""
    return round_all(calculators.triple_and_pairs(COLUMNS[:3], "qty", metrics_between_nonref=True)(items(spark, sf_dir), ["loc_id"]), 5, "bias")


def _seasonal_triple_sql() -> str:
    """Triple rows have a dataset, pair rows a pair; the second of a pair is first scaled to the first by the season's extrema."""
    parts = [f"select loc_id, '{COLUMNS[i]}' as dataset, n as n_obs, round({snr}, 4) as snr, round({err}, 4) as err_std, round({beta}, 4) as beta, subset, null::varchar as pair, null::double as \"R\", null::double as bias, null::double as ubrmsd, null::double as rho, case when n < 3 then 1 when {snr} is null or {err} is null or {beta} is null then 2 else 0 end as status from c" for i, (snr, err, beta) in ((i, _triple_cells(i)) for i in range(3))]
    for i, a in enumerate(COLUMNS[:3]):
        for b in COLUMNS[i + 1 : 3]:
            scaled = f"select loc_id, subset, {a} as x, ({b} - min({b}) over w) / (max({b}) over w - min({b}) over w) * (max({a}) over w - min({a}) over w) + min({a}) over w as y, rank() over (partition by loc_id, subset order by {a}) + (count(*) over (partition by loc_id, subset, {a}) - 1) / 2.0 as rx, rank() over (partition by loc_id, subset order by {b}) + (count(*) over (partition by loc_id, subset, {b}) - 1) / 2.0 as ry from s window w as (partition by loc_id, subset)"
            parts.append(f"select loc_id, null as dataset, count(*) as n_obs, null as snr, null as err_std, null as beta, subset, '{a}_and_{b}' as pair, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 4) + 0.0, round(avg(x - y), 8) + 0.0, round(sqrt(var_pop(x - y)), 4), round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 4) + 0.0, case when count(*) < 3 then 1 else 0 end from ({scaled}) group by loc_id, subset")
    return _L + f", s as (select *, {_SEASON} as subset from l union all select *, 'ALL' as subset from l), c as {_cov_sql('s', COLUMNS[:3], 'loc_id, subset')} " + " union all ".join(parts)


@query(_seasonal_triple_sql())
def seasonal_triple_calculator(spark, sf_dir):
    return round_all(calculators.seasonal_triple(COLUMNS[:3], "qty")(items(spark, sf_dir), ["loc_id"]), 4, "bias")


@query(
    "with l as (select l_suppkey as loc_id, l_linenumber as ref, l_quantity - 25 as k1 from lineitem) select loc_id, count_if(ref = 2 and k1 < 0)::int as ssf_fr_temp_un, count_if(ref = 2 and k1 >= 0)::int as ssf_fr_temp_ab, "
    "count_if(ref != 2 and k1 < 0)::int as ssf_un_temp_un, count_if(ref != 2 and k1 >= 0)::int as ssf_un_temp_ab, count(*)::int as n_obs from l group by 1"
)
def freeze_thaw_counts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("loc_id"), F.col("l_linenumber").alias("ref"), (F.col("l_quantity") - 25).alias("k1"))
    return calculators.freeze_thaw()(t, ["loc_id"])


@query(_L + "select loc_id, count(*) as n_obs, round(covar_pop(qty, price) / sqrt(var_pop(qty) * var_pop(price)), 6) as pearson_r from l group by 1")
def pearson_of_daily_sums(spark, sf_dir):
    """Sums kept by day, added up to correlations of any longer time."""
    by_day = items(spark, sf_dir).groupBy("loc_id", "ts").agg(*moments.sums("qty", "price"))
    return round_all(moments.pearson_of_sums(by_day, ["loc_id"]))


@query(
    _L + ", m as (select loc_id, stddev_samp(qty) as sx, stddev_samp(price) as sy, avg(qty) - avg(price) as b, covar_pop(qty, price) / sqrt(var_pop(qty) * var_pop(price)) as r from l group by 1) "
    "select loc_id, round(2*sx*sy*(1-r), 6) as mse_corr, round(b*b, 6) as mse_bias, round((sx-sy)*(sx-sy), 6) as mse_var, round(2*sx*sy*(1-r) + b*b + (sx-sy)*(sx-sy), 6) as mse from m"
)
def mse_with_ddof(spark, sf_dir):
    return round_all(moments.mse_with_ddof(items(spark, sf_dir), ["loc_id"], "qty", "price", 1))


@query(
    _L + f", {_RHO.format('disc')}, " + _tau("qty", "disc") + ", t as (select p.loc_id, s / sqrt(x::double * y) as tau from p) "
    "select rho.loc_id, round(rho, 6) as spearman_r, round(tanh(atanh(rho) - h * sqrt(1 + rho * rho / 2)), 6) as spearman_r_lower, round(tanh(atanh(rho) + h * sqrt(1 + rho * rho / 2)), 6) as spearman_r_upper, "
    "round(tau, 6) as kendall_tau, round(tanh(atanh(tau) - h * 0.431), 6) as kendall_tau_lower, round(tanh(atanh(tau) + h * 0.431), 6) as kendall_tau_upper from (select *, 1.959963984540054 / sqrt(n - 3) as h from rho) rho join t on rho.loc_id = t.loc_id"
)
def rank_intervals(spark, sf_dir):
    df = items(spark, sf_dir)
    a, b = (intervals.analytical(df, "qty", "disc", m).select("loc_id", m, F.col("lower").alias(f"{m}_lower"), F.col("upper").alias(f"{m}_upper")) for m in ("spearman_r", "kendall_tau"))
    return round_all(a.join(b, "loc_id"))
