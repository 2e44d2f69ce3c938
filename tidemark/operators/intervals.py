"""Confidence intervals: analytical ones as expressions over moments, bootstrapped ones by seeded resampling."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import correlation, known, pair_moments
from ..functions.special import chi2_quantile_of, normal_quantile, t_quantile_of
from . import ranks, resampling

ANALYTICAL = ("bias", "ubrmsd", "pearson_r", "spearman_r", "kendall_tau")


def fisher_interval(r: Column, n: Column, alpha: float = 0.05, factor: Column | float = 1.0) -> tuple[Column, Column]:
    """tanh(atanh(r) -+ factor z / sqrt(n - 3)); null with three or fewer rows, r itself where it is 1 or -1."""
    half = normal_quantile(1 - alpha / 2) * (F.lit(factor) if isinstance(factor, float) else factor) / F.sqrt(F.nullif(F.greatest(n - 3, F.lit(0)), F.lit(0)))
    inside = F.abs(r) < 1

    def end(sign: int) -> Column:
        return F.when(inside, F.tanh(F.atanh(F.when(inside, r)) + sign * half)).otherwise(F.when(n > 3, r))

    return end(-1), end(1)


def rank_factor(kind: str, r: Column) -> Column | float:
    """What widens Fisher's interval for rank correlations. 0.431 is the factor that the reference results have."""
    return {"pearson_r": 1.0, "spearman_r": F.sqrt(1 + r * r / 2), "kendall_tau": 0.431}[kind]


def has_analytical(metric: str) -> bool:
    return metric in ANALYTICAL


def analytical(df: DataFrame, x: str, y: str, metric: str, keys: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """(keys, n_obs, metric, lower, upper) of a metric that has an analytical interval; others raise ValueError."""
    if not has_analytical(metric):
        raise ValueError(f"no analytical interval: {metric}")
    keys = ["loc_id"] if keys is None else keys
    if metric in ("spearman_r", "kendall_tau"):
        name, function = ("rho", ranks.spearman) if metric == "spearman_r" else ("tau", ranks.kendall)
        found = function(df, x, y, keys)
        low, high = fisher_interval(F.col(name), F.col("n_obs"), alpha, rank_factor(metric, F.col(name)))
        return found.select(*keys, "n_obs", F.col(name).alias(metric), low.alias("lower"), high.alias("upper"))
    value, low, high = moment_interval(metric, alpha)
    return df.groupBy(*keys).agg(*pair_moments(x, y)).select(*keys, F.col("n").alias("n_obs"), value.alias(metric), low.alias("lower"), high.alias("upper"))


def moment_interval(metric: str, alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """The value and the ends of the interval of bias, ubrmsd or pearson_r, over the columns of pair_moments."""
    n, degrees = F.col("n"), (F.col("n") - 1).cast("double")
    if metric == "bias":
        value = F.col("mx") - F.col("my")
        half = F.sqrt(F.col("vd") / F.nullif(n - 1, F.lit(0))) * t_quantile_of(1 - alpha / 2, degrees)
        return value, value - half, value + half
    if metric == "ubrmsd":
        low, high = (F.sqrt(n * F.col("vd") / F.nullif(chi2_quantile_of(p, degrees), F.lit(0.0))) for p in (1 - alpha / 2, alpha / 2))
        return F.sqrt("vd"), low, high
    value = correlation(*(F.col(c) for c in ("vx", "vy", "cxy", "mx", "my")))
    return value, *fisher_interval(value, n, alpha)


def acceleration(jackknife: np.ndarray) -> float:
    """BCa's correction for skewness, from the metric without each row in turn."""
    centred = jackknife.mean() - jackknife
    spread = float((centred**2).sum()) ** 1.5
    return float((centred**3).sum()) / (6 * spread) if spread else 0.0


def interval_of(samples: np.ndarray, value: float, alpha: float, method: str, a: float = 0.0) -> tuple[float, float]:
    """The interval of a bootstrapped metric: "percentile", "basic" or "BCa" (with alpha at either end, as results have it, and
    the acceleration a)."""
    samples = samples[~np.isnan(samples)]
    if not len(samples) or math.isnan(value):
        return math.nan, math.nan
    low, high = np.quantile(samples, [alpha / 2, 1 - alpha / 2])
    if method == "percentile":
        return float(low), float(high)
    if method == "basic":
        return float(2 * value - high), float(2 * value - low)
    if method != "BCa":
        raise ValueError(f"no such method: {method}")
    share = float(np.mean(samples <= value))
    if not 0 < share < 1:
        return float(samples.min()), float(samples.max())
    norm = NormalDist()
    z0 = norm.inv_cdf(share)
    ends = [norm.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (norm.inv_cdf(alpha), norm.inv_cdf(1 - alpha))]
    low, high = np.quantile(samples, ends)
    return float(low), float(high)


def _r(x: np.ndarray, y: np.ndarray) -> float:
    sx, sy = x.std(), y.std()
    return float(np.clip(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy), -1, 1)) if sx > 0 and sy > 0 else math.nan


SAMPLED: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "bias": lambda x, y: float((x - y).mean()),
    "msd": lambda x, y: float(((x - y) ** 2).mean()),
    "rmsd": lambda x, y: math.sqrt(float(((x - y) ** 2).mean())),
    "ubrmsd": lambda x, y: float((x - y).std()),
    "mse_bias": lambda x, y: float((x.mean() - y.mean()) ** 2),
    "mse_var": lambda x, y: float((x.std() - y.std()) ** 2),
    "mse_corr": lambda x, y: max(0.0, float(2 * x.std() * y.std() - 2 * ((x - x.mean()) * (y - y.mean())).mean())),
    "rss": lambda x, y: float(((x - y) ** 2).sum()),
    "pearson_r": _r,
}


class Sums:
    """Means, variances and the covariance of samples that are given by their sums of 1, x, y, xx, yy and xy."""

    def __init__(self, sums: np.ndarray):
        self.n, sx, sy, sxx, syy, sxy = sums
        self.mx, self.my = sx / self.n, sy / self.n
        # a constant sample's variance would be some rounding errors of its mean square
        self.vx, self.vy = (np.where(v > 1e-13 * square, v, 0.0) for v, square in ((sxx / self.n - self.mx**2, sxx / self.n), (syy / self.n - self.my**2, syy / self.n)))
        self.cxy = sxy / self.n - self.mx * self.my
        self.msd = np.maximum(sxx - 2 * sxy + syy, 0) / self.n

    def r(self) -> np.ndarray:
        spread = np.sqrt(self.vx * self.vy)
        with np.errstate(all="ignore"):
            return np.where(spread > 0, np.clip(self.cxy / spread, -1, 1), np.nan)


#: The metrics of SAMPLED for many samples at once.
OF_SUMS: dict[str, Callable[[Sums], np.ndarray]] = {
    "bias": lambda s: s.mx - s.my,
    "msd": lambda s: s.msd,
    "rmsd": lambda s: np.sqrt(s.msd),
    "ubrmsd": lambda s: np.sqrt(np.maximum(s.msd - (s.mx - s.my) ** 2, 0)),
    "mse_bias": lambda s: (s.mx - s.my) ** 2,
    "mse_var": lambda s: (np.sqrt(s.vx) - np.sqrt(s.vy)) ** 2,
    "mse_corr": lambda s: np.maximum(0, 2 * np.sqrt(s.vx * s.vy) - 2 * s.cxy),
    "rss": lambda s: s.msd * s.n,
    "pearson_r": Sums.r,
}
#: Numbers that the counts of resampled rows may hold at once.
COUNT_CELLS = 1 << 22


def _generator(seed: int, key: tuple) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr([str(k) for k in key]).encode())])


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1, x, y, xx, yy and xy of every row; x and y less one common constant, which no metric of them depends on."""
    c = (x.mean() + y.mean()) / 2
    x, y = x - c, y - c
    return np.stack([np.ones(len(x)), x, y, x * x, y * y, x * y])


def left_out(x: np.ndarray, y: np.ndarray, metric: str | Callable) -> np.ndarray:
    """The metric without each row in turn: the jackknife. Linear in the rows for metrics of sums."""
    if callable(metric):
        return np.array([metric(np.delete(x, i), np.delete(y, i)) for i in range(len(x))])
    products = _products(x, y)
    return OF_SUMS[metric](Sums(products.sum(axis=1)[:, None] - products))


def resampled(x: np.ndarray, y: np.ndarray, metrics: list[str | Callable], rng: np.random.Generator, nsamples: int) -> np.ndarray:
    """The metrics (rows) of nsamples resamplings with replacement (columns)."""
    n = len(x)
    if any(callable(m) for m in metrics):
        functions = [SAMPLED[m] if isinstance(m, str) else m for m in metrics]
        picks = (rng.integers(0, n, n) for _ in range(nsamples))
        return np.array([[f(x[i], y[i]) for f in functions] for i in picks]).T.reshape(len(metrics), -1)
    products, parts = _products(x, y), []
    for k in range(0, nsamples, step := max(1, COUNT_CELLS // n)):
        counts = np.array([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(min(step, nsamples - k))])
        sums = Sums(products @ counts.T)
        parts.append(np.array([OF_SUMS[m](sums) for m in metrics]))
    return np.concatenate(parts, axis=1)


def _bootstrapped_by_sums(df: DataFrame, x: str, y: str, metrics: dict[str, str], keys: list[str], alpha: float, method: str, nsamples: int, minimum: int, seed: int) -> DataFrame:
    if method not in ("percentile", "basic", "BCa"):
        raise ValueError(f"no such method: {method}")

    def of_sums(sums: np.ndarray) -> np.ndarray:
        """The metrics (rows) of samples given by their sums of 1, x, y, xx, xy and yy."""
        n, sx, sy, sxx, sxy, syy = sums
        return np.array([OF_SUMS[m](Sums(np.stack([n, sx, sy, sxx, syy, sxy]))) for m in metrics.values()])

    rows = df.select(*keys, known(x).alias("__x"), known(y).alias("__y")).filter("__x is not null and __y is not null")
    ends = [f"{name}{end}" for name in metrics for end in ("", "_lower", "_upper")]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n_obs", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ends)])

    def finish(n: int, values: np.ndarray, samples: np.ndarray | None, a: np.ndarray) -> list[list]:
        cells: list[float] = []
        for k, value in enumerate(values):
            cells += [value, *(interval_of(samples[k], float(value), alpha, method, a[k]) if samples is not None else (math.nan, math.nan))]
        return [[n, *(None if math.isnan(v) else float(v) for v in cells)]]

    return resampling.resampled(rows, keys, ["__x", "__y"], of_sums, finish, schema, nsamples, minimum, seed, method == "BCa", [tuple(range(2))])


def bootstrapped_many(df: DataFrame, x: str, y: str, metrics: dict[str, str | Callable], keys: list[str] | None = None, alpha: float = 0.05, method: str = "percentile", nsamples: int = 1000, minimum_data_length: int = 100, seed: int = 0) -> DataFrame:
    """(keys, n_obs, <name>, <name>_lower, <name>_upper of every metric): one resampling of a key's rows serves all metrics.

    Intervals are null for too few rows. Resampling is seeded by `seed` and the key, and results repeat exactly however the rows
    lie. Metrics by name split a key's rows over tasks (see `resampling`); with a function of arrays, a key's complete cases meet
    in one task.
    """
    keys = ["loc_id"] if keys is None else keys
    if all(isinstance(m, str) for m in metrics.values()):
        return _bootstrapped_by_sums(df, x, y, metrics, keys, alpha, method, nsamples, minimum_data_length, seed)
    functions = {name: SAMPLED[m] if isinstance(m, str) else m for name, m in metrics.items()}
    rows = df.select(*keys, known(x).alias("__x"), known(y).alias("__y")).filter("__x is not null and __y is not null")
    ends = [f"{name}{end}" for name in functions for end in ("", "_lower", "_upper")]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n_obs", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ends])

    def resample(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__x", "__y"])
        a, b = part["__x"].to_numpy(float), part["__y"].to_numpy(float)
        enough = len(a) >= minimum_data_length
        samples = resampled(a, b, list(metrics.values()), _generator(seed, key), nsamples) if enough else [None] * len(metrics)
        cells: list[float] = []
        for row, metric, function in zip(samples, metrics.values(), functions.values(), strict=True):
            value = function(a, b)
            cells += [value, *(interval_of(row, value, alpha, method, acceleration(left_out(a, b, metric)) if method == "BCa" else 0.0) if enough else (math.nan, math.nan))]
        return pd.DataFrame([[*key, len(a), *(None if math.isnan(v) else v for v in cells)]], columns=schema.names).astype({c: float for c in ends})

    return rows.groupBy(*keys).applyInPandas(resample, schema)


def bootstrapped(df: DataFrame, x: str, y: str, metric: str | Callable, keys: list[str] | None = None, alpha: float = 0.05, method: str = "percentile", nsamples: int = 1000, minimum_data_length: int = 100, seed: int = 0) -> DataFrame:
    """(keys, n_obs, value, lower, upper): one metric with its bootstrapped interval, as bootstrapped_many gives it."""
    keys = ["loc_id"] if keys is None else keys
    found = bootstrapped_many(df, x, y, {"value": metric}, keys, alpha, method, nsamples, minimum_data_length, seed)
    return found.select(*keys, "n_obs", "value", F.col("value_lower").alias("lower"), F.col("value_upper").alias("upper"))


def triple_of_covariances(c: np.ndarray, ref: int = 0) -> np.ndarray:
    """snr, err_std and beta (rows) of three columns by their covariances c[i, j], each for many samples."""
    out = np.empty((3, 3, c.shape[2]))
    with np.errstate(all="ignore"):
        for i in range(3):
            j, k = (v for v in range(3) if v != i)
            noise = np.abs(np.abs(c[i, i] * c[j, k] / (c[i, j] * c[i, k])) - 1)
            other = next(v for v in range(3) if v not in (i, ref))
            beta = np.ones(c.shape[2]) if i == ref else c[ref, other] / c[i, other]
            out[0, i], out[1, i], out[2, i] = -10 * np.log10(noise), np.sqrt(c[i, i] - c[i, j] * c[i, k] / c[j, k]) * beta, beta
    return out


def bootstrapped_triple(df: DataFrame, columns: list[str], keys: list[str] | None = None, ref: str | None = None, alpha: float = 0.05, method: str = "percentile", nsamples: int = 1000, minimum_data_length: int = 100, seed: int = 0) -> DataFrame:
    """(keys, dataset, metric, n_obs, value, lower, upper) of triple collocation; the reference's beta is 1 with certainty."""
    keys = ["loc_id"] if keys is None else keys
    at = columns.index(ref) if ref else 0
    rows = df.select(*keys, *(known(c).alias(f"__{k}") for k, c in enumerate(columns))).dropna(subset=["__0", "__1", "__2"])
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("dataset", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("n_obs", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("value", "lower", "upper"))])

    def of_sums(sums: np.ndarray) -> np.ndarray:
        """snr, err_std and beta of each column (nine rows) of samples given by their sums of 1, the columns and their products."""
        n, first, second = sums[0], sums[1:4], sums[4:]
        mean, c = first / n, np.empty((3, 3, sums.shape[1]))
        for k, (i, j) in enumerate(itertools.combinations_with_replacement(range(3), 2)):
            c[i, j] = c[j, i] = (second[k] / n - mean[i] * mean[j]) * n / np.maximum(n - 1, 1)
        return triple_of_covariances(c, at).reshape(9, -1)

    def finish(n: int, values: np.ndarray, samples: np.ndarray | None, a: np.ndarray) -> list[list]:
        out = []
        for i, dataset in enumerate(columns):
            for m, name in enumerate(("snr", "err_std", "beta")):
                low = high = math.nan
                value = float(values[3 * m + i]) if n > 1 else math.nan
                if samples is not None:
                    low, high = (1.0, 1.0) if (name, i) == ("beta", at) else interval_of(samples[3 * m + i], value, alpha, method, a[3 * m + i])
                out.append([dataset, name, n, *(None if math.isnan(v) else v for v in (value, low, high))])
        return out

    return resampling.resampled(rows, keys, ["__0", "__1", "__2"], of_sums, finish, schema, nsamples, minimum_data_length, seed, method == "BCa", [(0,), (1,), (2,)])
