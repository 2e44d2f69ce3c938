"""Pairwise agreement metrics as expressions over one set of moments.

`pair_moments` gives aggregates for a groupBy (or, with a window, for rolling statistics); `METRICS` are Column expressions
over them. Rows count only where both values are known and finite. NaN and infinities are missing values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(c: Column | str) -> Column:
    """The value as double, null where it is NaN or infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def pair_moments(x: Column | str, y: Column | str, prefix: str = "", where: Column | None = None, over=None) -> list[Column]:
    """Aggregates of complete cases: n, means, population variances and covariance, extrema and sums of differences."""
    x, y = known(x), known(y)
    both = x.isNotNull() & y.isNotNull()
    both = both if where is None else both & where
    x, y = F.when(both, x), F.when(both, y)
    found = {
        "n": F.count(x),
        "mx": F.avg(x),
        "my": F.avg(y),
        "vx": F.var_pop(x),
        "vy": F.var_pop(y),
        "cxy": F.covar_pop(x, y),
        "rss": F.sum((x - y) * (x - y)),
        "vd": F.var_pop(x - y),
        "aad": F.avg(F.abs(x - y)),
        "low": F.least(F.min(x), F.min(y)),
        "high": F.greatest(F.max(x), F.max(y)),
    }
    if over is not None:
        found["low"] = F.least(F.min(x).over(over), F.min(y).over(over))
        found["high"] = F.greatest(F.max(x).over(over), F.max(y).over(over))
        found = {k: v if k in ("low", "high") else v.over(over) for k, v in found.items()}
    return [v.alias(prefix + k) for k, v in found.items()]


def spread(variance: Column, mean: Column | None) -> Column:
    """Whether a series varies: merged partial sums can leave a constant one a variance of some rounding errors."""
    return variance > (F.lit(0.0) if mean is None else mean * mean * 1e-28)


def correlation(vx: Column, vy: Column, cxy: Column, mx: Column | None = None, my: Column | None = None) -> Column:
    """Pearson's R from moments, clamped to [-1, 1]; null if a series doesn't vary."""
    return F.when(spread(vx, mx) & spread(vy, my), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cxy / F.sqrt(F.nullif(vx * vy, F.lit(0.0))))))


#: name -> expression of the moments; m gives a moment's column.
METRICS: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "n_obs": lambda m: m("n"),
    "bias": lambda m: m("mx") - m("my"),
    "rss": lambda m: m("rss"),
    "msd": lambda m: m("rss") / F.nullif(m("n"), F.lit(0)),
    "rmsd": lambda m: F.sqrt(m("rss") / F.nullif(m("n"), F.lit(0))),
    "nrmsd": lambda m: F.sqrt(m("rss") / F.nullif(m("n"), F.lit(0))) / F.nullif(m("high") - m("low"), F.lit(0.0)),
    "ubrmsd": lambda m: F.sqrt(m("vd")),
    "mse_bias": lambda m: (m("mx") - m("my")) * (m("mx") - m("my")),
    "mse_var": lambda m: F.pow(F.sqrt(m("vx")) - F.sqrt(m("vy")), F.lit(2.0)),
    "mse_corr": lambda m: F.greatest(2 * F.sqrt(m("vx")) * F.sqrt(m("vy")) - 2 * m("cxy"), F.lit(0.0)),
    "mse": lambda m: METRICS["mse_bias"](m) + METRICS["mse_var"](m) + METRICS["mse_corr"](m),
    "aad": lambda m: m("aad"),
    "nash_sutcliffe": lambda m: 1 - m("rss") / F.nullif(m("n") * m("vx"), F.lit(0.0)),
    "pearson_r": lambda m: correlation(m("vx"), m("vy"), m("cxy"), m("mx"), m("my")),
}
#: Metrics that change if x and y are exchanged.
NOT_COMMUTATIVE = frozenset({"bias", "nash_sutcliffe", "index_of_agreement"})


def evaluate(metrics: Iterable[str], prefix: str = "") -> list[Column]:
    return [METRICS[k](lambda c: F.col(prefix + c)).alias(k) for k in metrics]


def pairwise(df: DataFrame, keys: list[str], x: str, y: str, metrics: Iterable[str] = tuple(METRICS), min_obs: int = 1) -> DataFrame:
    """One row for each key with the metrics of x and y; null, but for n_obs, with fewer than min_obs complete cases.

    One shuffle of partial moments: a task sends one row for each key, so a key with a third of all rows does no harm.
    """
    found = df.groupBy(*keys).agg(*pair_moments(x, y))
    out = [c if k == "n_obs" else F.when(F.col("n") >= min_obs, c).alias(k) for k, c in zip(metrics, evaluate(metrics), strict=True)]
    return found.select(*keys, *out)


def rmsd(df: DataFrame, keys: list[str], x: str, y: str, ddof: int = 0) -> DataFrame:
    found = df.groupBy(*keys).agg(*pair_moments(x, y))
    return found.select(*keys, F.sqrt(F.col("rss") / F.nullif(F.col("n") - ddof, F.lit(0))).alias("rmsd"))


def index_of_agreement(df: DataFrame, keys: list[str], o: str, p: str) -> DataFrame:
    """Willmott's index: one minus the squared differences over the potential error about the observations' mean."""
    full = df.select(*keys, known(o).alias("__o"), known(p).alias("__p")).dropna(subset=["__o", "__p"])
    means = full.groupBy(*keys).agg(F.avg("__o").alias("__m"))
    spread = F.pow(F.abs(F.col("__p") - F.col("__m")) + F.abs(F.col("__o") - F.col("__m")), F.lit(2.0))
    sums = full.join(means, keys).groupBy(*keys).agg(F.sum(F.pow(F.col("__o") - F.col("__p"), F.lit(2.0))).alias("__rss"), F.sum(spread).alias("__pot"))
    return sums.select(*keys, (1 - F.col("__rss") / F.nullif(F.col("__pot"), F.lit(0.0))).alias("index_of_agreement"))


def rounded_middle(avg: Column, low: Column, high: Column) -> Column:
    """A mean in single precision, within the values' range: a constant column has no deviations from it."""
    return F.least(F.greatest(F.when(F.abs(avg) < 1e30, avg.cast("float").cast("double")).otherwise(avg), low), high)


def power_of_two(c: Column) -> Column:
    """The power of two that is no less than c."""
    return F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(c))), F.lit(0.0))


def reach(middle: Column, low: Column, high: Column) -> Column:
    """A power of two that no deviation from the middle exceeds."""
    return power_of_two(F.greatest(high - middle, middle - low))


def deviation_totals(size: int) -> list[Column]:
    """Aggregates n, __m{i}, __s{i} and __s{i}_{j} of `size` columns: rows have values __x{i} and, equal in all rows of a key, n,
    the unit __n and __m{i} and __far{i} of each column. Every term is cut in two at a unit of its key: the upper parts add up
    without any error, the lower ones are too small for theirs to matter."""
    of = range(size)
    d = [F.col(f"__x{i}") - F.col(f"__m{i}") for i in of]

    def total(term: Column, *factors: int) -> Column:
        unit = F.col("__n")
        for i in factors:
            unit = unit * F.col(f"__far{i}")
        upper = (term + unit) - unit
        return F.sum(upper) + F.sum(term - upper)

    totals = [total(d[i], i).alias(f"__s{i}") for i in of] + [total(d[i] * d[j], i, j).alias(f"__s{i}_{j}") for i in of for j in of if i <= j]
    return [F.first("n").alias("n"), *(F.first(f"__m{i}").alias(f"__m{i}") for i in of), *totals]


def covariance_cells(size: int, sample: bool = True) -> list[Column]:
    """Means m_i and covariances c_i_j (i <= j) of deviation_totals."""
    of, n = range(size), F.col("n")
    means = [(F.col(f"__m{i}") + F.col(f"__s{i}") / F.nullif(n, F.lit(0))).alias(f"m_{i}") for i in of]
    divisor = F.nullif(n - (1 if sample else 0), F.lit(0))
    return means + [((F.col(f"__s{i}_{j}") - F.col(f"__s{i}") * F.col(f"__s{j}") / n) / divisor).alias(f"c_{i}_{j}") for i in of for j in of if i <= j]


def covariance_matrix(df: DataFrame, keys: list[str], columns: list[str], sample: bool = True) -> DataFrame:
    """n, means m_i and covariances c_i_j (i <= j) of the complete cases of all columns.

    Ratios of small covariances magnify the errors of sums, which depend on the order in which Spark adds up. So deviations
    are taken from a rounded mean, and their sums don't depend on the order, see deviation_totals.
    """
    values = [known(c) for c in columns]
    full = values[0].isNotNull()
    for v in values[1:]:
        full = full & v.isNotNull()
    rows = df.select(*keys, *(F.when(full, v).alias(f"__x{i}") for i, v in enumerate(values)))
    of = range(len(columns))
    seen = rows.groupBy(*keys).agg(F.count("__x0").alias("n"), *(f(f"__x{i}").alias(f"__{name}{i}") for i in of for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))
    seen = seen.select(*keys, "n", *(rounded_middle(*(F.col(f"__{e}{i}") for e in ("avg", "min", "max"))).alias(f"__m{i}") for i in of), *(f"__{e}{i}" for i in of for e in ("min", "max")))
    far = [reach(*(F.col(f"__{e}{i}") for e in ("m", "min", "max"))).alias(f"__far{i}") for i in of]
    seen = seen.select(*(F.col(k).alias(f"__of_{k}") for k in keys), "n", (power_of_two(F.col("n")) * 1.5).alias("__n"), *(f"__m{i}" for i in of), *far)
    on = [rows[k].eqNullSafe(seen[f"__of_{k}"]) for k in keys]
    met = rows.join(seen, on) if keys else rows.crossJoin(seen)
    return met.groupBy(*keys).agg(*deviation_totals(len(columns))).select(*keys, "n", *covariance_cells(len(columns), sample))


def sums(x: Column | str, y: Column | str) -> list[Column]:
    """Plain sums of complete cases: they add up over parts of the data, such as days or files that are kept as totals."""
    x, y = known(x), known(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = {"n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x), "syy": F.sum(y * y)}
    return [v.alias(k) for k, v in parts.items()]


def pearson_of_sums(totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_obs, pearson_r) of tables of sums, of one part or many."""
    t = totals.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")))
    n = F.col("n")
    vx, vy = F.col("sxx") / n - F.pow(F.col("sx") / n, F.lit(2.0)), F.col("syy") / n - F.pow(F.col("sy") / n, F.lit(2.0))
    return t.filter("n > 0").select(*keys, n.alias("n_obs"), correlation(vx, vy, F.col("sxy") / n - F.col("sx") * F.col("sy") / (n * n)).alias("pearson_r"))


def mse_with_ddof(df: DataFrame, keys: list[str], x: str, y: str, ddof: int = 0) -> DataFrame:
    """The parts of the mean squared difference with deviations of n - ddof: mse, mse_corr, mse_bias, mse_var."""
    m = df.groupBy(*keys).agg(*pair_moments(x, y))
    f = F.col("n") / F.nullif(F.col("n") - ddof, F.lit(0))
    sx, sy = F.sqrt(F.col("vx") * f), F.sqrt(F.col("vy") * f)
    r = correlation(*(F.col(c) for c in ("vx", "vy", "cxy", "mx", "my")))
    out = m.select(*keys, (2 * sx * sy * (1 - r)).alias("mse_corr"), F.pow(F.col("mx") - F.col("my"), F.lit(2.0)).alias("mse_bias"), F.pow(sx - sy, F.lit(2.0)).alias("mse_var"))
    return out.withColumn("mse", F.col("mse_corr") + F.col("mse_bias") + F.col("mse_var"))
