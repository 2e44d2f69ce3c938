"""Filters, masks and column adapters: functions from DataFrame to DataFrame that compose with DataFrame.transform."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.moments import known
from .collocate import Other, nearest
from .series import anomaly, climatology

OPERATORS: dict[str, Callable] = {"<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">=": operator.ge, ">": operator.gt}
#: Units of time offsets, as NumPy names them.
UNITS = {"D": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND", "ms": "MILLISECOND", "us": "MICROSECOND"}


def predicate(column: str | Column, op: str | Callable, threshold) -> Column:
    """column op threshold; op is a sign or a function of a Column and the threshold. Unknown signs are errors."""
    c = F.col(column) if isinstance(column, str) else column
    if callable(op):
        return op(c, threshold)
    if op not in OPERATORS:
        raise ValueError(f"no such operator: {op}")
    return OPERATORS[op](c, F.lit(threshold))


def mask_frame(df: DataFrame, op: str | Callable, threshold, columns: list[str]) -> DataFrame:
    """df with columns replaced by whether they fulfil the predicate; missing values don't."""
    found = {c: F.coalesce(predicate(_comparable(df, c), op, threshold), F.lit(False)) for c in columns}
    return df.withColumns(found)


def _comparable(df: DataFrame, c: str) -> Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


def self_mask(df: DataFrame, op: str | Callable, threshold, column: str) -> DataFrame:
    """The rows that fulfil the predicate."""
    return df.filter(predicate(_comparable(df, column), op, threshold))


def keep_where(df: DataFrame, rules: Iterable[tuple], ignore_nans: bool = False, values: list[str] | None = None) -> DataFrame:
    """The rows that fulfil all rules (column, op, threshold); then, of these, those with a value in `values` at all.

    With ignore_nans a missing value passes its rule.
    """
    tests = []
    for column, op, threshold in rules:
        c = _comparable(df, column)
        test = predicate(c, op, threshold)
        tests.append(test | c.isNull() if ignore_nans else test)
    kept = df.filter(reduce(operator.and_, tests)) if tests else df
    return kept.dropna("all", subset=values) if values else kept


def row_mean(*columns: Column) -> Column:
    """The mean of a row's known values."""
    values = F.filter(F.array(*(known(c) for c in columns)), lambda x: x.isNotNull())
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def combine_columns(df: DataFrame, function: Callable[..., Column], columns: list[str], new_name: str = "merged") -> DataFrame:
    """df with another column: a function of the given columns, such as row_mean, F.greatest or a pandas UDF."""
    return df.withColumn(new_name, function(*(F.col(c) for c in columns)))


def exact_time(
    df: DataFrame, offset_fields: list[str], units: list[str], base_field: str | None = None, base_reference: str | None = None, base_unit: str = "D", output_field: str | None = None, ts: str = "ts", drop_original: bool = True
) -> DataFrame:
    """Exact time stamps: a base time plus whole offsets; missing offsets count as zero, rows without a base time go.

    The base is ts or base_field; with base_reference, base_field holds whole numbers of base_unit since then. The result
    replaces ts unless output_field is given.
    """
    at = F.col(base_field or ts)
    if base_reference is not None:
        at = F.timestamp_add(UNITS[base_unit], known(base_field or ts).cast("long"), F.lit(base_reference).cast("timestamp_ntz"))
    else:
        at = at.cast("timestamp_ntz")
    for c, unit in zip(offset_fields, units, strict=True):
        at = F.timestamp_add(UNITS[unit], F.coalesce(known(c), F.lit(0.0)).cast("long"), at)
    name = output_field or ts
    gone = {name, *offset_fields, base_field or name} if drop_original else {name}
    return df.withColumn("__exact", at).filter("__exact is not null").drop(*gone).withColumnRenamed("__exact", name)


def naive_utc(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with zoned time stamps as naive UTC ones."""
    if dict(df.dtypes)[ts] != "timestamp":
        return df
    us = F.unix_micros(ts)
    return df.withColumn(ts, F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def in_period(df: DataFrame, period: tuple[str, str] | None, ts: str = "ts") -> DataFrame:
    """The rows within a period, both ends inclusive; a plain predicate that reaches the scan."""
    if period is None:
        return df
    return df.filter(F.col(ts).between(*(F.lit(x).cast("timestamp_ntz") for x in period)))


def anomaly_adapter(df: DataFrame, columns: list[str], window_size: float = 35, **kw) -> DataFrame:
    for c in columns:
        df = anomaly(df, c, window_size, **kw)
    return df


def climatology_anomaly_adapter(df: DataFrame, columns: list[str], return_clim: bool = False, respect_leap_years: bool = False, keys: list[str] | None = None, **kw) -> DataFrame:
    """Columns replaced by anomalies from their own climatologies, both with the same day numbers."""
    for c in columns:
        clim = climatology(df, c, respect_leap_years=respect_leap_years, keys=keys, **kw)
        df = anomaly(df, c, clim=clim, respect_leap_years=respect_leap_years, return_clim=return_clim, keys=keys)
        if return_clim:
            df = df.withColumnRenamed("climatology", f"{c}_climatology")
    return df


def drop_masked(df: DataFrame, masks: dict[str, tuple[DataFrame, str]], window_days: float, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """df without the rows for which a mask's nearest row within the window is true; rows without a match stay."""
    keys = ["loc_id"] if keys is None else keys
    others = [Other(mask, [flag], f"__mask_{name}_") for name, (mask, flag) in masks.items()]
    found = nearest(df, others, window_days, keys, ts)
    flags = [f"__mask_{name}_{flag}" for name, (_, flag) in masks.items()]
    return found.filter(reduce(operator.and_, [~F.coalesce(F.col(c), F.lit(False)) for c in flags])).drop(*flags)


@dataclass
class Distributor:
    """Selects time stamps by dates, ranges, yearless dates (month, day) and yearless ranges: any that fits will do."""

    dates: list[str] = field(default_factory=list)
    ranges: list[tuple[str, str]] = field(default_factory=list)
    yearless_dates: list[tuple[int, int]] = field(default_factory=list)
    yearless_ranges: list[tuple[cal.Yearless, cal.Yearless]] = field(default_factory=list)

    def condition(self, ts: Column, first_year: Column) -> Column:
        ts = ts.cast("timestamp_ntz")

        def stamp(x: str) -> Column:
            return F.lit(x).cast("timestamp_ntz")

        tests = [ts == stamp(d) for d in self.dates]
        tests += [ts.between(F.least(stamp(a), stamp(b)), F.greatest(stamp(a), stamp(b))) for a, b in self.ranges]
        tests += [(F.month(ts) == m) & (F.dayofmonth(ts) == d) for m, d in self.yearless_dates]
        tests += [cal.in_yearless_range(ts, a, b, first_year) for a, b in self.yearless_ranges]
        return reduce(operator.or_, tests, F.lit(False))

    def select(self, df: DataFrame, set_nan: bool = False, values: list[str] | None = None, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
        """The rows that fit; with set_nan all rows, their values null where they don't."""
        keys = ["loc_id"] if keys is None else keys
        first, rows = F.lit(None).cast("int"), df
        if any(b < a for a, b in self.yearless_ranges):
            years = df.groupBy(*keys).agg(F.min(F.year(ts)).alias("__first"))
            rows, first = df.join(years, keys), F.col("__first")
        fits = self.condition(F.col(ts), first)
        if not set_nan:
            return rows.filter(fits).select(*df.columns)
        values = [c for c in df.columns if c not in (*keys, ts)] if values is None else values
        return rows.withColumns({c: F.when(fits, F.col(c)) for c in values}).select(*df.columns)
