"""Triple and extended collocation: error statistics of three or more datasets from their covariances."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import covariance_matrix, known

Cov = Callable[[int, int], Column]


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def triple_expressions(cov: Cov, ref: int = 0, absolute: bool = True) -> dict[str, list[Column]]:
    """snr (dB), err_std and beta of three datasets by a covariance function; null where undefined.

    With absolute, ratios count by size (for samples whose covariances have odd signs).
    """
    out: dict[str, list[Column]] = {"snr": [], "err_std": [], "beta": []}
    for i in range(3):
        j, k = (x for x in range(3) if x != i)
        share = _ratio(cov(i, i) * cov(j, k), cov(i, j) * cov(i, k))
        noise = (F.abs(share) if absolute else share) - 1
        noise = F.abs(noise) if absolute else noise
        variance = cov(i, i) - _ratio(cov(i, j) * cov(i, k), cov(j, k))
        other = next(x for x in range(3) if x not in (i, ref))
        beta = F.lit(1.0) if i == ref else _ratio(cov(ref, other), cov(i, other))
        out["snr"].append(F.when(noise > 0, -10 * F.log10(noise)))
        out["err_std"].append(F.when(variance >= 0, F.sqrt(variance) * beta))
        out["beta"].append(beta)
    return out


def triple_collocation(df: DataFrame, columns: list[str], keys: list[str] | None = None, ref: str | None = None, absolute: bool = True, min_obs: int = 1) -> DataFrame:
    """(keys, dataset, n_obs, snr, err_std, beta), one row for each of three columns; ref (the first) has beta 1."""
    keys = ["loc_id"] if keys is None else keys
    at = columns.index(ref) if ref else 0
    found = covariance_matrix(df, keys, columns)
    e = triple_expressions(lambda i, j: F.col(f"c_{min(i, j)}_{max(i, j)}"), at, absolute)
    enough = F.col("n") >= min_obs
    rows = F.array(*(F.struct(F.lit(c).alias("dataset"), *(F.when(enough, e[m][i]).alias(m) for m in e)) for i, c in enumerate(columns)))
    return found.select(*keys, F.col("n").alias("n_obs"), F.explode(rows).alias("__r")).select(*keys, "__r.dataset", "n_obs", *(f"__r.{m}" for m in e))


def triple_error(df: DataFrame, x: str, y: str, z: str, keys: list[str] | None = None) -> DataFrame:
    """Error deviations of three series that are already scaled to each other, by products of differences."""
    keys = ["loc_id"] if keys is None else keys
    a, b, c = known(x), known(y), known(z)
    parts = {f"err_{x}": (a - b) * (a - c), f"err_{y}": (b - a) * (b - c), f"err_{z}": (c - a) * (c - b)}
    return df.groupBy(*keys).agg(*(F.sqrt(F.abs(F.avg(v))).alias(k) for k, v in parts.items()))


def all_triples(df: DataFrame, columns: list[str], reference: str, keys: list[str] | None = None) -> DataFrame:
    """triple_collocation of every triple that has the reference, each over its own complete cases."""
    parts = []
    for combo in itertools.combinations(columns, 3):
        if reference in combo:
            got = triple_collocation(df, list(combo), keys, reference)
            parts.append(got.withColumn("triple", F.lit("_".join(combo))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def design(n: int, correlated: list[tuple[int, int]]) -> tuple[np.ndarray, list[Callable[[Cov], Column]]]:
    """Rows of the least-squares problem for n datasets, and the estimate that each row's right side is.

    Unknowns: n signal variances, one cross signal for each correlated pair, n error variances, one error covariance for
    each pair. Estimates that need a correlated pair to be independent are left out.
    """
    pairs = [tuple(sorted(p)) for p in correlated]
    m = len(pairs)
    width = 2 * n + 2 * m

    def clean(*links: tuple[int, int]) -> bool:
        return not any(tuple(sorted(x)) in pairs for x in links)

    rows: list[np.ndarray] = []
    estimates: list[Callable[[Cov], Column]] = []

    def add(ones: list[int], estimate: Callable[[Cov], Column]) -> None:
        row = np.zeros(width)
        row[ones] = 1
        rows.append(row)
        estimates.append(estimate)

    for i in range(n):  # the variance is signal and error
        add([i, n + m + i], lambda c, i=i: c(i, i))
    for k, (i, j) in enumerate(pairs):  # so is a correlated pair's covariance
        add([n + k, 2 * n + m + k], lambda c, i=i, j=j: c(i, j))
    for i in range(n):
        for a, b in itertools.combinations([x for x in range(n) if x != i], 2):
            if clean((i, a), (i, b), (a, b)):
                add([i], lambda c, i=i, a=a, b=b: _ratio(c(i, a) * c(i, b), c(a, b)))
    for k, (i, j) in enumerate(pairs):
        for a, b in itertools.permutations([x for x in range(n) if x not in (i, j)], 2):
            if clean((i, a), (j, b), (a, b)):
                add([n + k], lambda c, i=i, j=j, a=a, b=b: _ratio(c(i, a) * c(j, b), c(a, b)))
    return np.array(rows), estimates


def extended_collocation(df: DataFrame, columns: list[str], correlated: list[tuple[str, str]] | None = None, keys: list[str] | None = None, abs_est: bool = True) -> DataFrame:
    """One row for each key: sig_, err_ and snr_ of every column, err_cov_ and err_corr_ of the correlated pairs.

    The design depends on the datasets alone, so its least-squares solution is a fixed matrix: the unknowns are sums of
    products of covariances, all of them expressions.
    """
    keys = ["loc_id"] if keys is None else keys
    links = [(columns.index(a), columns.index(b)) for a, b in correlated or []]
    n, m = len(columns), len(links)
    matrix, estimates = design(n, links)
    if np.linalg.matrix_rank(matrix) < matrix.shape[1]:
        raise ValueError("too few independent datasets for these correlations")
    solution = np.linalg.pinv(matrix)
    found = covariance_matrix(df, keys, columns)

    def cov(i: int, j: int) -> Column:
        return F.col(f"c_{min(i, j)}_{max(i, j)}")

    y = found.select("*", *(e(cov).alias(f"__y{k}") for k, e in enumerate(estimates)))

    def unknown(row: int) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(solution[row]):
            if abs(w) > 1e-14:
                total = total + F.col(f"__y{k}") * F.lit(float(w))
        return total

    size = F.abs if abs_est else (lambda c: c)
    x = y.select(*keys, *(size(unknown(i)).alias(f"sig_{c}") for i, c in enumerate(columns)), *(size(unknown(n + m + i)).alias(f"err_{c}") for i, c in enumerate(columns)), *(unknown(2 * n + m + k).alias(f"err_cov_{columns[i]}_{columns[j]}") for k, (i, j) in enumerate(links)))
    snr = [F.when((F.col(f"sig_{c}") > 0) & (F.col(f"err_{c}") > 0), 10 * F.log10(F.col(f"sig_{c}") / F.nullif(F.col(f"err_{c}"), F.lit(0.0)))).alias(f"snr_{c}") for c in columns]
    corr = [_ratio(F.col(f"err_cov_{columns[i]}_{columns[j]}"), F.sqrt(F.abs(F.col(f"err_{columns[i]}") * F.col(f"err_{columns[j]}")))).alias(f"err_corr_{columns[i]}_{columns[j]}") for i, j in links]
    return x.select("*", *snr, *corr)
