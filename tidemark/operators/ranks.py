"""Rank correlations by location: Spearman's rho in expressions, Kendall's tau by counts of inversions.

A location with very many rows is split over tasks by value, see `splits`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import correlation, known
from ..functions.special import correlation_p
from .shared import whole_groups
from .splits import Split, average_ranks, values_at, weighted


def _complete(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.select(*keys, known(x).alias("__x"), known(y).alias("__y")).filter("__x is not null and __y is not null")


def rank_correlation(n: Column, x: str, y: str) -> Column:
    """Pearson's correlation of weighted ranks, whose mean is known: (n + 1) / 2."""
    w, m = F.col("__w"), (n + 1) / 2
    vx, vy, cxy = (F.sum(w * F.col(a) * F.col(b)) / n - m * m for a, b in ((x, x), (y, y), (x, y)))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), correlation(vx, vy, cxy))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """(keys, n_obs, rho[, p_rho]): Pearson's correlation of average ranks."""
    keys = ["loc_id"] if keys is None else keys
    rows = average_ranks(weighted(_complete(df, keys, x, y), keys, ["__x", "__y"]), {"__x": "__rx", "__y": "__ry"})
    n = F.sum("__w")
    found = rows.groupBy(*keys).agg(n.alias("n_obs"), rank_correlation(n, "__rx", "__ry").alias("rho"))
    return found.withColumn("p_rho", correlation_p(F.col("rho"), F.col("n_obs").cast("double"))) if with_p else found


def spearman_of_pairs(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """(keys, n_obs, rho_between_a_and_b of every pair), over the rows in which all columns are known: each is ranked once."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    full = df.select(*keys, *(known(c).alias(c) for c in columns)).dropna(subset=columns)
    rows = average_ranks(weighted(full, keys, columns), {c: f"__r_{c}" for c in columns})
    n = F.sum("__w")
    return rows.groupBy(*keys).agg(n.alias("n_obs"), *(rank_correlation(n, f"__r_{a}", f"__r_{b}").alias(f"rho_between_{a}_and_{b}") for a, b in pairs))


def ranks_in_order(rows: DataFrame, by: list[str], c: str, cases: dict[str, Column]) -> DataFrame:
    """rows with the average rank (from 1) of column c within its key, for each name among the rows where its condition holds (null
    in others). Each key is whole in a task; one sort serves all names."""
    order = Window.partitionBy(*by).orderBy(c)
    upto, ties = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.currentRow)
    counted = {name: F.count(F.when(case, 1)) for name, case in cases.items()}
    return rows.withColumns({name: F.when(cases[name], n.over(upto) - (n.over(ties) - 1) / 2) for name, n in counted.items()})


def medians(df: DataFrame, value: Column, keys: list[str], name: str = "median") -> DataFrame:
    """(keys, name): the exact median of the known values, from places in sorted order; null where there are none."""
    rows = df.select(*keys, value.alias("__v"))
    split = weighted(rows.filter("__v is not null"), keys, ["__v"])
    sizes = split.rows.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    middle = F.explode(F.array(F.expr("(__n - 1) div 2"), F.expr("__n div 2")))
    found = values_at(split, "__v", sizes.select(*keys, middle.alias("__pos"))).groupBy(*keys).agg(((F.min("__v") + F.max("__v")) / 2).alias(name))
    return rows.select(*keys).distinct().join(found, keys, "left")


def mad(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median absolute difference, exact."""
    return medians(df, F.abs(known(x) - known(y)), keys, "mad")


def inversions(values: np.ndarray, weights: np.ndarray | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """For each of the groups (0, 1, ...; rows of a group follow one another) the weight of its pairs that stand in the wrong order,
    strictly. They're counted at the highest bit in which two ranks differ: a pass over all rows for each bit."""
    a = np.unique(values, return_inverse=True)[1].astype(np.int64)
    w = np.ones(len(a)) if weights is None else np.asarray(weights, float)
    g = np.zeros(len(a), np.int64) if group is None else group
    out = np.zeros(int(g[-1]) + 1 if len(g) else 1)
    bits, places = int(a.max()).bit_length() if len(a) else 0, np.arange(len(a))
    a = a + (g << bits)
    for b in range(bits - 1, -1, -1):
        # ranks of a group that agree in all higher bits stand together, in their own order
        alike, high = a >> (b + 1), (a >> b) & 1
        first = np.maximum.accumulate(np.where(np.r_[True, alike[1:] != alike[:-1]], places, 0))
        held = w * high
        upto = np.cumsum(held)
        out += np.bincount(g, np.where(high == 0, (upto - (upto - held)[first]) * w, 0.0), len(out))
        order = np.argsort(a >> b, kind="stable")  # groups stay where they are
        a, w = a[order], w[order]
    return out


#: Without ties p is exact up to so many values, or with so few discordant pairs. Fixed values, as published results have them.
EXACT_VALUES, EXACT_PAIRS = 33, 1


def exact_p(n: int, c: int) -> float:
    """Twice the chance that a random order of n values has at most c pairs in the wrong order (1 at the very middle).

    The number of such pairs is a sum of independent uniform variables on 0..k for k below n, so its distribution is the
    product of the polynomials 1 + x + ... + x^k, over n!.
    """
    if 4 * c == n * (n - 1):
        return 1.0
    chances = np.ones(1)
    for k in range(1, n):
        chances = np.convolve(chances, np.full(min(k, c) + 1, 1 / (k + 1)))[: c + 1]
    return min(1.0, 2 * float(chances[: c + 1].sum()))


def _ties(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """Of the sizes t of a key's groups of equal values: pairs, and the sums that the variance of Kendall's statistic has."""
    t = F.col("__t").cast("double")
    sums = {"pairs": t * (t - 1) / 2, "triples": t * (t - 1) * (t - 2), "spread": t * (t - 1) * (2 * t + 5)}
    return rows.groupBy(*keys, *by).agg(F.sum("__w").alias("__t")).groupBy(*keys).agg(*(F.sum(v).alias(f"{name}_{k}") for k, v in sums.items()))


def _discordant(split: Split) -> DataFrame:
    """(keys, __d) of distinct pairs (__x, __y) with weights and chunks: the weight of the pairs of opposite order.

    A key that is split has a grid of chunks of x by chunks of y. Pairs in one chunk of x are counted there, and so are those
    in one chunk of y; what lies in both is taken off again, and pairs that share neither chunk come from the grid's counts.
    Each count is over one chunk, so over no more than a task's rows; a chunk of one value has no such pairs.
    """
    rows, keys, none = split.rows, split.keys, F.lit(-1)
    x, y = (none, none) if split.hot is None else (F.col("__c___x"), F.col("__c___y"))

    def piece(sign: int, a: Column, b: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(sign).alias("__sign"), a.alias("__a"), b.alias("__b")))

    if split.hot is None:
        pieces = F.array(piece(1, x, y, F.lit(True)))
    else:
        parted, even_x, even_y = F.col("__hot").isNotNull(), x % 2 == 0, y % 2 == 0
        pieces = F.array_compact(F.array(piece(1, x, none, even_x), piece(2, none, y, parted & even_y), piece(-1, x, y, parted & even_x & even_y)))
    dealt = rows.select(*keys, "__x", "__y", "__w", F.explode(pieces).alias("__p")).select(*keys, "__x", "__y", "__w", "__p.*")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("__sign", T.IntegerType()), T.StructField("__d", T.DoubleType())])

    by = [*keys, "__sign", "__a", "__b"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in whole_groups(batches, by):
            x, y, w = (rows.column(c).to_numpy() for c in ("__x", "__y", "__w"))
            group = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
            order = np.lexsort((y, x, group))
            d = inversions(y[order], w[order], group)
            yield from rows.select([*keys, "__sign"]).take(first).append_column("__d", pa.array(d)).to_batches()

    inside = dealt.repartition(*([split.tasks] if split.tasks else []), *by).sortWithinPartitions(*by).mapInArrow(count, schema)
    inside = inside.select(*keys, (F.signum("__sign") * F.col("__d")).alias("__d"))
    if split.hot is None:
        return inside
    grid = split.hot.groupBy(*keys, x.alias("__a"), y.alias("__b")).agg(F.sum("__w").cast("double").alias("__n"))
    sides = grid.groupBy(*keys).agg(F.max("__a").alias("__ma"), F.max("__b").alias("__mb"))
    full = sides.withColumn("__a", F.explode(F.sequence(F.lit(0), "__ma"))).withColumn("__b", F.explode(F.sequence(F.lit(0), "__mb"))).join(grid, [*keys, "__a", "__b"], "left")
    lower = Window.partitionBy(*keys, "__a").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys, "__b").orderBy(F.desc("__a")).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("__low", F.coalesce(F.sum("__n").over(lower), F.lit(0.0)))
    apart = full.select(*keys, (F.col("__n") * F.sum("__low").over(later)).alias("__d"))
    return inside.unionByName(apart).groupBy(*keys).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("__d"))


@F.pandas_udf(T.StructType([T.StructField("tau", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def _tau_and_p(m: pd.DataFrame) -> pd.DataFrame:
    """tau-b and its two-sided p-value, a row for each key: exact without ties for few values or few discordant pairs, else asymptotic."""

    def one(n, discordant, x_pairs, x_triples, x_spread, y_pairs, y_triples, y_spread, both) -> tuple[float | None, float | None]:
        pairs = n * (n - 1) / 2
        rest_x, rest_y = pairs - x_pairs, pairs - y_pairs
        if n < 2 or not rest_x or not rest_y:
            return None, None
        s = pairs - x_pairs - y_pairs + both - 2 * discordant
        tau = max(-1.0, min(1.0, s / math.sqrt(rest_x) / math.sqrt(rest_y)))
        fewer = min(discordant, pairs - discordant)
        if not x_pairs and not y_pairs and (n <= EXACT_VALUES or fewer <= EXACT_PAIRS):
            return tau, exact_p(int(n), int(fewer))
        # Kendall's variance of s when both columns have ties
        variance = (n * (n - 1) * (2 * n + 5) - x_spread - y_spread) / 18 + x_pairs * y_pairs / pairs
        if n > 2:
            variance += x_triples * y_triples / (18 * pairs * (n - 2))
        return tau, math.erfc(abs(s) / math.sqrt(2 * variance))

    return pd.DataFrame([one(*r) for r in m.itertuples(index=False)], columns=["tau", "p"])


def kendall(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_obs, tau, p_tau). Ties and discordant pairs are counted from distinct pairs of values with their weights."""
    keys = ["loc_id"] if keys is None else keys
    split = weighted(_complete(df, keys, x, y), keys, ["__x", "__y"])
    rows = split.dealt(split.rows, *keys) if split.hot is None else split.rows
    parts = [_discordant(split), *(_ties(rows, keys, by, name) for by, name in ((["__x"], "x"), (["__y"], "y"), (["__x", "__y"], "both")))]
    found = rows.groupBy(*keys).agg(F.sum("__w").alias("n_obs"))
    for p in parts:
        found = found.join(p, keys)
    m = F.struct(*(F.col(c).cast("double").alias(c) for c in ("n_obs", "__d", *(f"{a}_{b}" for a in "xy" for b in ("pairs", "triples", "spread")), "both_pairs")))
    return found.withColumn("__t", _tau_and_p(m)).select(*keys, "n_obs", F.col("__t.tau").alias("tau"), F.col("__t.p").alias("p_tau"))
