"""DuckDB forms of the distribution functions that intervals and p-values need, by the closed series for whole degrees of freedom.

The DataFrame side uses continued fractions; these are finite sums, so the two agree only if both are right.
"""

from __future__ import annotations


def _sum(terms: str, term: str) -> str:
    return f"coalesce(list_sum(list_transform(range(0, {terms}), lambda k: exp({term}))), 0)"


def _t_inside(sine: str, log_cos2: str, theta: str, nu: str) -> str:
    """The chance of |t| below sqrt(nu) tan(theta), with nu degrees of freedom."""
    even = _sum(f"({nu}) // 2", f"lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5) + k * {log_cos2}")
    odd = _sum(f"(({nu}) - 1) // 2", f"lgamma(k + 1.0) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2) + (k + 0.5) * {log_cos2}")
    return f"case when ({nu}) % 2 = 0 then {sine} * {even} else 2 / pi() * ({theta} + {sine} * {odd}) end"


def correlation_p(r: str, n: str) -> str:
    """The two-sided p-value of a correlation of n pairs."""
    inside = _t_inside(f"abs({r})", f"ln(1 - ({r}) * ({r}))", f"asin(abs({r}))", f"({n} - 2)")
    return f"case when {r} is null or {n} < 2 then null when {n} = 2 then 1.0 when abs({r}) >= 1 then 0.0 else greatest(0.0, 1 - {inside}) end"


def erfc(u: str) -> str:
    """erfc of u >= 0; zero from 6 on, where it is under 1e-16."""
    series = _sum("200", f"(2 * k + 1) * ln({u}) - lgamma(k + 1.5)")
    return f"case when {u} <= 0 then 1.0 when {u} > 6 then 0.0 else 1 - exp(-({u}) * ({u})) * {series} end"


def _bisection(name: str, source: str, high: str, below: str) -> str:
    """A recursive table name(nu, i, lo, hi) that halves [0, high] 60 times; `below` holds where mid is under the quantile."""
    return (
        f"{name} as (select nu, 0 as i, 0.0::double as lo, ({high})::double as hi from (select distinct nu from {source}) "
        f"union all select nu, i + 1, case when b then mid else lo end, case when b then hi else mid end from (select *, {below} as b from (select *, (lo + hi) / 2 as mid from {name} where i < 60)))"
    )


def t_quantiles(name: str, source: str, alpha: float = 0.05) -> str:
    """Recursive table: at i = 60, sqrt(nu) * tan(lo) is the upper two-sided quantile for each nu of source."""
    return _bisection(name, source, "pi() / 2", f"{_t_inside('sin(mid)', '2 * ln(cos(mid))', 'mid', 'nu')} < {1 - alpha}")


def chi2_quantiles(name: str, source: str, p: float) -> str:
    """Recursive table: at i = 60, lo is the quantile p of chi-squared for each nu of source."""
    even = _sum("nu // 2", "k * ln(mid / 2) - lgamma(k + 1.0) - mid / 2")
    odd = _sum("(nu - 1) // 2", "(k + 0.5) * ln(mid / 2) - lgamma(k + 1.5) - mid / 2")
    return _bisection(name, source, "nu + 60 * sqrt(2 * nu) + 200", f"1 - case when nu % 2 = 0 then {even} else {erfc('sqrt(mid / 2)')} + {odd} end < {p}")
