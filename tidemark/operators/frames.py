"""Metrics of all combinations of columns: one groupBy for all of them, as long rows or as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import METRICS, NOT_COMMUTATIVE, pair_moments
from ..plans.combos import n_combinations


def pairwise_long(df: DataFrame, columns: list[str], metrics: list[str], keys: list[str], must_include=None, permutations: bool = False) -> DataFrame:
    """(keys, pair, metrics...): every pair over its own complete cases; the moments of all pairs share one shuffle."""
    pairs = n_combinations(columns, 2, must_include, permutations)
    aggregates: list[Column] = []
    for a, b in pairs:
        aggregates += pair_moments(a, b, f"{a}|{b}|")
    found = df.groupBy(*keys).agg(*aggregates)

    def row(a: str, b: str) -> Column:
        cells = [METRICS[m](lambda c: F.col(f"`{a}|{b}|{c}`")).alias(m) for m in metrics]
        return F.struct(F.lit(f"{a}_and_{b}").alias("pair"), *cells)

    return found.select(*keys, F.explode(F.array(*(row(a, b) for a, b in pairs))).alias("__r")).select(*keys, "__r.*")


def pairwise_matrix(df: DataFrame, columns: list[str], metric: str, keys: list[str]) -> DataFrame:
    """(keys, row, one column for each of columns): metric(row, column). The diagonal is the metric of a column with itself."""
    aggregates: list[Column] = []
    commutes = metric not in NOT_COMMUTATIVE
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j or not commutes]
    for a, b in pairs:
        aggregates += pair_moments(a, b, f"{a}|{b}|")
    found = df.groupBy(*keys).agg(*aggregates)

    def cell(a: str, b: str) -> Column:
        x, y = (a, b) if (a, b) in pairs else (b, a)
        return METRICS[metric](lambda c: F.col(f"`{x}|{y}|{c}`"))

    rows = F.array(*(F.struct(F.lit(a).alias("row"), *(cell(a, b).alias(b) for b in columns)) for a in columns))
    return found.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.*")
