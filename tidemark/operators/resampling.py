"""Seeded resampling with replacement of a key's rows, split over tasks.

A key's distinct rows are dealt by hash into buckets of bounded size. How many of a replicate's n draws fall into each bucket is
a multinomial draw, made by halves: at each node of a tree over the buckets a binomial draw, seeded by the key and the node,
splits what came down. Within a bucket the draws are a multinomial over its rows. A replicate is then a handful of sums of
products, which are added up over buckets before and after the shuffle; what depends on a key's replicates sees these only.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import kept
from .splits import tasks_of

#: Distinct rows of one bucket, and numbers that the counts of resampled rows may hold at once.
BUCKET_ROWS, COUNT_CELLS = 200_000, 1 << 22


def generator(seed: int, *node) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr([str(x) for x in node]).encode())])


def split_draws(sizes: np.ndarray, n: int, nsamples: int, seed: int, key: tuple) -> np.ndarray:
    """For each bucket (row) and replicate (column), how many of n draws fall into the bucket; columns add up to n."""
    upto = np.r_[0, np.cumsum(sizes)]
    out = np.zeros((len(sizes), nsamples), np.int64)

    def halve(low: int, high: int, draws: np.ndarray) -> None:
        if high - low == 1:
            out[low] = draws
            return
        middle = (low + high) // 2
        whole = upto[high] - upto[low]
        share = (upto[middle] - upto[low]) / whole if whole else 0.5
        left = generator(seed, key, low, high).binomial(draws, share)
        halve(low, middle, left)
        halve(middle, high, draws - left)

    halve(0, len(sizes), np.full(nsamples, n, np.int64))
    return out


def _products(values: np.ndarray) -> np.ndarray:
    """1, the columns, and their products i <= j, of every row."""
    pairs = itertools.combinations_with_replacement(range(len(values)), 2)
    return np.stack([np.ones(values.shape[1]), *values, *(values[i] * values[j] for i, j in pairs)])


def _draws(rng: np.random.Generator, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each row (column) is drawn in each replicate (row) of so many wanted draws: a multinomial. Rows that seldom repeat
    are drawn one by one and counted, which takes a fraction of the time of a binomial for each row."""
    total, rows = int(weight.sum()), len(weight)
    if total > 4 * rows:
        return rng.multinomial(wanted, weight / total)
    picks = rng.integers(0, total, int(wanted.sum()), dtype=np.int32 if total < 2**31 else np.int64)
    if total > rows:
        picks = np.repeat(np.arange(rows), weight)[picks]
    return np.bincount(picks + np.repeat(np.arange(len(wanted)) * rows, wanted), minlength=len(wanted) * rows).reshape(len(wanted), rows)


def resampled(
    rows: DataFrame,
    keys: list[str],
    values: list[str],
    of_sums: Callable[[np.ndarray], np.ndarray],
    finish: Callable[[int, np.ndarray, np.ndarray | None, np.ndarray], list[list]],
    schema: T.StructType,
    nsamples: int,
    minimum: int,
    seed: int,
    jackknife: bool,
    together: list[tuple[int, ...]],
) -> DataFrame:
    """A key's rows finish(n, metrics, metrics of each replicate, accelerations), in the schema after the keys.

    of_sums gives metrics (rows) of samples (columns) from their sums of products, of values less a constant: columns that are
    `together` less the same. With fewer than `minimum` rows there are no replicates (None). With jackknife, the accelerations
    come from sums over the rows of powers of what leaving each out changes.
    """
    rows = rows.select(*keys, *values)
    tasks = tasks_of(rows)  # what a task holds must not grow with the input
    distinct = kept((rows.repartition(tasks, *keys, *values) if tasks else rows).groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("__w")))
    w = F.col("__w")
    stats = distinct.groupBy(*keys).agg(F.sum(w).alias("__n"), F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("__buckets"), *((F.sum(w * F.col(v)) / F.sum(w)).alias(f"__m{k}") for k, v in enumerate(values)))
    # in single precision, so that it doesn't depend on the order in which Spark has added up
    means = [sum(F.col(f"__m{j}") for j in group) / len(group) for group in together]
    middle = {k: F.when(F.abs(m) < 1e30, m.cast("float").cast("double")).otherwise(m) for group, m in zip(together, means, strict=True) for k in group}
    stats = kept(stats.select(*keys, "__n", "__buckets", *(m.alias(f"__c{k}") for k, m in middle.items())))
    # a row for each key; buckets of a split key are as even as hashes are
    centred = [(F.col(v) - F.col(f"__c{k}")).alias(f"__v{k}") for k, v in enumerate(values)]
    dealt = kept((distinct.repartition(tasks, *keys) if tasks else distinct).join(stats, keys).select(*keys, "__w", F.pmod(F.xxhash64(*values), "__buckets").cast("int").alias("__bucket"), (F.col("__buckets") > 1).alias("__split"), *centred))
    names = [f"__v{k}" for k in range(len(values))]
    n_sums = 1 + len(values) + len(values) * (len(values) + 1) // 2
    columns = [f"__s{k}" for k in range(n_sums)]
    by_key = [rows.schema[k] for k in keys]
    told_schema = to_arrow_schema(schema)

    def told(key: tuple, sums: np.ndarray, powers: np.ndarray | None) -> list[tuple]:
        """The key's results by sums of products of its rows themselves (first column) and of its replicates."""
        with np.errstate(all="ignore"):
            metrics = of_sums(sums)
        n, a = round(sums[0, 0]), np.zeros(len(metrics))
        if powers is not None:
            s1, s2, s3 = powers
            mean = s1 / n
            spread = np.maximum(s2 - n * mean**2, 0) ** 1.5
            with np.errstate(all="ignore"):
                a = np.where(spread > 0, -(s3 - 3 * mean * s2 + 2 * n * mean**3) / (6 * spread), 0.0)
        return [(*key, *row) for row in finish(n, metrics[:, 0], metrics[:, 1:] if metrics.shape[1] > 1 else None, a)]

    def drawn_sums(data: np.ndarray, weight: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Sums of products of the rows themselves, and of what each replicate draws of them."""
        order = np.lexsort(data[::-1])
        weight, products = weight[order], _products(data[:, order])
        found = [products @ weight[:, None]]
        for k in range(0, len(counts), step := max(1, COUNT_CELLS // len(weight))):
            found.append(products @ _draws(rng, counts[k : k + step], weight).T)
        return np.concatenate(found, axis=1)

    def left(data: np.ndarray, weight: np.ndarray, every: np.ndarray) -> np.ndarray:
        """Over the rows, sums of the first three powers of what each metric becomes without the row, less its value."""
        apart = of_sums(every - _products(data)) - of_sums(every)
        return np.stack([(weight * apart**k).sum(axis=1) for k in (1, 2, 3)])

    def whole(part: pa.Table) -> pa.Table:
        """All of it for a key that is one bucket."""
        key = key_of(part)
        data, weight = np.stack([part.column(c).to_numpy() for c in names]), part.column("__w").to_numpy().astype(np.int64)
        n = int(weight.sum())
        sums = drawn_sums(data, weight, np.full(nsamples if n >= minimum else 0, n, np.int64), generator(seed, key, "rows", 0))
        lines = told(key, sums, left(data, weight, sums[:, :1]) if jackknife else None)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), told_schema, strict=True)], schema=told_schema)

    def key_of(part: pa.Table) -> tuple:
        return tuple(part.column(k)[0].as_py() for k in keys)

    one = dealt.filter("not __split")
    one = (one.repartition(tasks, *keys) if tasks else one).groupBy(*keys).applyInArrow(whole, schema)
    if stats.filter("__buckets > 1").isEmpty():
        return one
    dealt = dealt.filter("__split")
    sizes = dealt.groupBy(*keys, "__bucket").agg(F.sum("__w").alias("__held"))

    def deal(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("__bucket").to_numpy())
        held = part.column("__held").to_numpy()[order]
        n = int(held.sum())
        draws = split_draws(held, n, nsamples, seed, key_of(part)) if n >= minimum else np.zeros((len(held), 0), np.int64)
        return part.select([*keys, "__bucket"]).take(pa.array(order)).append_column("__draws", pa.array(list(draws), pa.list_(pa.int64())))

    draws = sizes.groupBy(*keys).applyInArrow(deal, T.StructType([*by_key, T.StructField("__bucket", T.IntegerType()), T.StructField("__draws", T.ArrayType(T.LongType()))]))

    def draw(part: pa.Table, wanted: pa.Table) -> pa.Table:
        """Sums of products of the bucket's rows themselves (replicate -1), and of what each replicate draws of them."""
        counts = np.asarray(wanted.column("__draws")[0].as_py(), np.int64)
        data, weight = np.stack([part.column(c).to_numpy() for c in names]), part.column("__w").to_numpy().astype(np.int64)
        sums = drawn_sums(data, weight, counts, generator(seed, key_of(part), "rows", part.column("__bucket")[0].as_py()))
        one = part.select(keys).take(pa.array(np.zeros(sums.shape[1], np.int64)))
        one = one.append_column("__r", pa.array(np.arange(-1, sums.shape[1] - 1), pa.int32()))
        for c, v in zip(columns, sums, strict=True):
            one = one.append_column(c, pa.array(v))
        return one

    out = T.StructType([*by_key, T.StructField("__r", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
    drawn = dealt.groupBy(*keys, "__bucket").cogroup(draws.groupBy(*keys, "__bucket")).applyInArrow(draw, out)
    replicates = kept(drawn.groupBy(*keys, "__r").agg(*(F.sum(c).alias(c) for c in columns)))

    powers = None
    if jackknife:
        whole = replicates.filter("__r = -1").select(*keys, F.array(*columns).alias("__all"))

        def leave(part: pa.Table, totals: pa.Table) -> pa.Table:
            data, weight = np.stack([part.column(c).to_numpy() for c in names]), part.column("__w").to_numpy()
            sums = left(data, weight, np.asarray(totals.column("__all")[0].as_py())[:, None]).tolist()
            return part.select(keys).slice(0, 1).append_column("__p", pa.array([sums], pa.list_(pa.list_(pa.float64()))))

        bucketed = dealt.select(*(F.col(c).alias(c) for c in (*keys, "__bucket"))).distinct().join(whole, keys)  # with names of its own
        parts = dealt.groupBy(*keys, "__bucket").cogroup(bucketed.groupBy(*keys, "__bucket")).applyInArrow(leave, T.StructType([*by_key, T.StructField("__p", T.ArrayType(T.ArrayType(T.DoubleType())))]))
        powers = parts.groupBy(*keys).agg(F.collect_list("__p").alias("__ps"))  # a few numbers for each bucket

    def end(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__r")
        powers = np.array([[list(p) for p in ps] for ps in part["__ps"].iloc[0]], float).sum(axis=0) if jackknife else None
        return pd.DataFrame(told(key, part[columns].to_numpy(float).T, powers), columns=schema.names)

    every = replicates if powers is None else replicates.join(powers, keys)
    return one.unionByName(every.groupBy(*keys).applyInPandas(end, schema))  # nsamples + 1 rows for each key
