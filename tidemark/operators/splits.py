"""Keys split over tasks by value: what ranks, quantiles and counts of inversions of a very frequent key are made of.

A key with more rows than a task should sort is cut at some of its own quantiles. A cut that is a value of its own gets a chunk
that holds nothing else, so heavy ties need no order and may be spread at will; the chunks between hold distinct ranges. What
lies before a chunk is a sum over a table with a row for each chunk. All other keys are one chunk, number 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Rows of one key that one task sorts, and distinct rows of all its keys together that a task is meant to have.
TASK_ROWS, SHARE_ROWS = 1_000_000, 500_000
#: Quantiles that are looked at, and how many cuts are searched at once.
_POINTS, _STRIDE = 256, 16


def _cuts(name: str, n: Column, rows: int) -> Column:
    """Of a key's quantiles every so many-th, so that a chunk has about `rows` rows; distinct and rising."""
    step = F.greatest(F.lit(1), F.ceil(F.lit(_POINTS) * rows / n))
    return F.array_sort(F.array_distinct(F.filter(F.col(name), lambda v, i: (i + 1) % step == 0)))


def _chunk(cuts: Column, v: Column) -> Column:
    """2 k for values between k cuts below and the next one, 2 k + 1 for those that equal the next one; 0 without cuts."""

    def below(part: Column) -> Column:
        return F.size(F.filter(part, lambda c: c < v))

    start = below(F.filter(cuts, lambda c, i: i % _STRIDE == _STRIDE - 1)) * _STRIDE
    k = start + below(F.slice(cuts, start + 1, F.lit(_STRIDE)))
    same = F.coalesce(F.get(cuts, k) == v, F.lit(False))
    return F.when(cuts.isNull(), 0).otherwise(2 * k + same.cast("int"))


@dataclass
class Split:
    """Rows with __w, how often each occurs, and where keys are split, __c_v, the chunk of each value column v; hot has the rows of
    split keys alone, and is None where no key is split. tasks is the number of partitions that exchanges of the rows need to have,
    None where the session's own does."""

    rows: DataFrame
    hot: DataFrame | None
    keys: list[str]
    tasks: int | None = None

    def dealt(self, rows: DataFrame, *by: str, anyway: bool = False) -> DataFrame:
        """Rows dealt by columns over as many tasks as their number asks for; as they are where the session's number does, but
        `anyway`."""
        return rows.repartition(self.tasks, *by) if self.tasks else rows.repartition(*by) if anyway else rows

    def parts(self, value: str) -> list[str]:
        """What the rows of one task have in common."""
        return self.keys if self.hot is None else [*self.keys, f"__c_{value}"]

    def before(self, value: str) -> DataFrame:
        """(keys, __c_value, __before, __held): how much weight lies in lower chunks of a split key, and in this one.

        A split key has at most two chunks for each cut and one more, so this may be broadcast.
        """
        chunk = f"__c_{value}"
        counts = self.hot.groupBy(*self.keys, chunk).agg(F.sum("__w").cast("long").alias("__held"))
        lower = Window.partitionBy(*self.keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        return F.broadcast(counts.withColumn("__before", F.coalesce(F.sum("__held").over(lower), F.lit(0))))


def tasks_of(rows: DataFrame) -> int | None:
    """How many tasks the distinct rows are for, if more than the session's shuffles have: what a task holds must not grow with the
    input. One pass, in which a task sends a sketch."""
    found = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns))).first()[0]
    tasks = math.ceil(found / SHARE_ROWS)
    return tasks if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def weighted(rows: DataFrame, keys: list[str], values: list[str]) -> Split:
    """Distinct values of the rows with their numbers, split over tasks where a key has more than TASK_ROWS of them.

    Values are doubles without nulls. The distinct rows are written to the shared folder, since they're read several times.
    What is broadcast is a row for each split key, fewer than rows / TASK_ROWS, with as many cuts in all of them together.
    """
    rows = rows.select(*keys, *values)
    tasks = tasks_of(rows)
    rows = rows.repartition(tasks, *keys, *values) if tasks else rows
    distinct = kept(rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("__w")))
    many = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__hot")).filter(F.col("__hot") > TASK_ROWS)
    if many.isEmpty():
        return Split(distinct, None, keys, tasks)
    points = ", ".join(f"{k / _POINTS}D" for k in range(1, _POINTS))
    few = distinct.join(F.broadcast(many), keys).groupBy(*keys, "__hot").agg(*(F.expr(f"percentile_approx(`{v}`, array({points}), 10000)").alias(f"__q_{v}") for v in values))
    few = F.broadcast(kept(few.select(*keys, "__hot", *(_cuts(f"__q_{v}", F.col("__hot"), TASK_ROWS).alias(f"__q_{v}") for v in values))))
    chunks = [_chunk(F.col(f"__q_{v}"), F.col(v)).alias(f"__c_{v}") for v in values]
    every, hot = (distinct.join(few, keys, how).select(*distinct.columns, "__hot", *chunks) for how in ("left", "inner"))
    return Split(every, hot, keys, tasks)


def apart(rows: DataFrame, keys: list[str], sizes: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of keys that have no more than TASK_ROWS of them; the rows of all others, None where there are none; and how many tasks
    the former are for.

    sizes has each key once, with its number of rows as __rows. What is broadcast are keys with more, fewer than rows / TASK_ROWS.
    """
    total, most = sizes.agg(F.sum("__rows"), F.max("__rows")).first()
    many = None
    if most and most > TASK_ROWS:
        busy = F.broadcast(sizes.filter(F.col("__rows") > TASK_ROWS).select(*(F.col(k).alias(f"__of_{k}") for k in keys)))
        on = [rows[k].eqNullSafe(busy[f"__of_{k}"]) for k in keys]
        rows, many = rows.join(busy, on, "left_anti"), rows.join(busy, on, "left_semi")
    return rows, many, math.ceil((total or 0) / SHARE_ROWS)


def parted(rows: DataFrame, keys: list[str], sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """apart() with each key of the first whole in a task and in order of the keys."""
    rows, many, tasks = apart(rows, keys, sizes)
    dealt = rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys), many


def average_ranks(split: Split, columns: dict[str, str]) -> DataFrame:
    """The rows with the average rank (from 1) of each column within its key, by names.

    One exchange for all columns; with split keys one for each, by key and chunk, where rows of a chunk that is one value have
    their rank from the chunks' counts, so they're dealt by what else they hold.
    """

    def ranks(found: DataFrame, c: str, parts: list[str]) -> Column:
        by = Window.partitionBy(*parts)
        upto, ties = F.sum("__w").over(by.orderBy(c).rangeBetween(Window.unboundedPreceding, 0)), F.sum("__w").over(by.partitionBy(*parts, c))
        return upto - (ties - 1) / 2

    found, keys = split.rows, split.keys
    if split.hot is None:
        found = split.dealt(found, *keys, anyway=True)
        return found.withColumns({name: ranks(found, c, keys) for c, name in columns.items()})
    for c, name in columns.items():
        chunk, others = f"__c_{c}", [v for v in columns if v != c]
        spread = F.when(F.col(chunk) % 2 == 1, F.pmod(F.xxhash64(*others), F.lit(1024)).cast("int") if others else F.lit(0)).otherwise(-1)
        found = split.dealt(found.withColumn("__salt", spread), *keys, chunk, "__salt", anyway=True)
        found = found.withColumn(name, ranks(found, c, [*keys, chunk, "__salt"])).join(split.before(c), [*keys, chunk], "left")
        tied = F.col("__before") + (F.col("__held") + 1) / 2
        found = found.withColumn(name, F.when(F.col("__salt") >= 0, tied).otherwise(F.coalesce("__before", F.lit(0)) + F.col(name))).drop("__salt", "__before", "__held")
    return found


def values_at(split: Split, value: str, wanted: DataFrame) -> DataFrame:
    """wanted(keys, __pos, ...) with the value at place __pos (from 0) of the rows of its key, in rising order.

    Each chunk counts its rows' places on its own; a wanted place goes to its chunk, and there takes the last value that begins
    before it. A key wants few places.
    """
    keys, parts = split.keys, split.parts(value)
    held, first, chunk = F.struct(*wanted.columns).alias("__wanted"), F.col("__pos"), []
    if split.hot is not None:
        wanted = wanted.join(split.before(value), keys, "left").filter("__before is null or (__pos >= __before and __pos < __before + __held)")
        first, chunk = first - F.coalesce("__before", F.lit(0)), [F.coalesce(f"__c_{value}", F.lit(0)).alias(f"__c_{value}")]
    marks = wanted.select(*keys, *chunk, first.alias("__from"), F.lit(1).alias("__mark"), held)
    upto = F.sum("__w").over(Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    runs = split.dealt(split.rows, *parts).select(*parts, value, (upto - F.col("__w")).alias("__from"), F.lit(0).alias("__mark"))
    both = split.dealt(runs.unionByName(marks, allowMissingColumns=True), *parts)
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(*parts).orderBy("__from", "__mark").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, last).filter("__mark = 1").select("__wanted.*", value)


def join_split(split: Split, lookup: DataFrame, size: Column) -> DataFrame:
    """The rows joined to lookup, which has each key once with a size no less than its rows: rows of split keys stay where they
    are and meet a broadcast of these keys only, fewer than rows / TASK_ROWS; all others are shuffled by key."""
    on = [k for k in split.keys if k in lookup.columns]
    if split.hot is None:
        return split.rows.join(lookup, on)
    few = split.hot.join(F.broadcast(lookup.filter(size > TASK_ROWS)), on)
    return few.unionByName(split.rows.filter("__hot is null").join(lookup, on))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in their key by order: rows are dealt by ranges of (key, order), numbered there, and moved
    up by what lies before. A key that holds most rows is many tasks' work."""
    ranged = kept(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    lower = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # only a key that lies in several parts has anything before: at most one for each part
    moved = parts.withColumn("__before", F.sum("__n").over(lower)).filter("__before > 0").drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    placed = ranged.withColumn(name, own).join(F.broadcast(moved), [*keys, "__part"], "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__part", "__before")
