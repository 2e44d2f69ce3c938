"""Calendar expressions: leap-year day numbers, parts of months, dekads, Julian dates and ranges without a year."""

from __future__ import annotations

from dataclasses import dataclass
from functools import total_ordering

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JD_OF_1970 = 2440587.5
DEKADS = (1, 11, 21, 32)


def leap_doy(ts: Column) -> Column:
    """Day of year as if every year were a leap year: March 1 is always 61."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(ts), F.dayofmonth(ts)))


def bin_label(ts: Column, bins: tuple[int, ...] = DEKADS, start: bool = False) -> Column:
    """The date that names the part of the month between two bin edges: its last day, at most the month's, or its first."""
    day, last = F.dayofmonth(ts), F.dayofmonth(F.last_day(ts))
    chosen = F.lit(None).cast("int")
    for low, high in zip(bins, bins[1:]):
        chosen = F.when((day >= low) & (day < high), F.lit(low) if start else F.least(F.lit(high - 1), last)).otherwise(chosen)
    return F.make_date(F.year(ts), F.month(ts), chosen)


def labels_between(spark: SparkSession, start: str, end: str, bins: tuple[int, ...] = DEKADS, start_labels: bool = False) -> DataFrame:
    """(label) of every part of a month that a day between start and end falls in."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    return days.select(bin_label(F.col("d"), bins, start_labels).alias("label")).distinct().orderBy("label")


def dekad_index(ts: Column) -> Column:
    """1 to 36: the dekad of the year."""
    return (F.month(ts) - 1) * 3 + dekad_of_month(ts)


def dekad_of_month(ts: Column) -> Column:
    """1 to 3."""
    return F.least(F.lit(3), F.floor((F.dayofmonth(ts) - 1) / 10) + 1).cast("int")


def dekad_day(year: Column, month: Column, dekad: Column) -> Column:
    """The last day of a month's dekad: 10, 20 or the month's last."""
    return F.when(dekad < 3, dekad * 10).otherwise(F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1)))))


def dekad_end(ts: Column) -> Column:
    """The date that ends the dekad of ts."""
    return bin_label(ts)


def dekad_start(ts: Column) -> Column:
    return bin_label(ts, start=True)


def is_dekad_end(ts: Column) -> Column:
    return ts.cast("date") == dekad_end(ts)


def is_dekad_start(ts: Column) -> Column:
    return ts.cast("date") == dekad_start(ts)


def running_dekad_date(year: Column, index: Column) -> Column:
    """The end of dekad `index` (1 to 36) of a year."""
    month = F.floor((index - 1) / 3).cast("int") + 1
    return F.make_date(year, month, dekad_day(year, month, (index - 1) % 3 + 1).cast("int"))


def to_julian(ts: Column) -> Column:
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return us / 86_400e6 + JD_OF_1970


def from_julian(jd: Column) -> Column:
    us = F.round((jd - JD_OF_1970) * 86_400e6).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def julian_doy(jd: Column) -> Column:
    return F.dayofyear(from_julian(jd))


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


@total_ordering
@dataclass(frozen=True)
class Yearless:
    """A date and time without a year, ordered as in a leap year."""

    month: int
    day: int
    hour: int = 0
    minute: int = 0
    second: int = 0

    @property
    def key(self) -> int:
        return (((self.month * 100 + self.day) * 100 + self.hour) * 100 + self.minute) * 100 + self.second

    def __lt__(self, other: Yearless) -> bool:
        return self.key < other.key

    @property
    def doy(self) -> int:
        days = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
        return sum(days[: self.month - 1]) + self.day

    def in_year(self, year: Column) -> Column:
        """The time stamp in a year; null for February 29 of a year that has none."""
        ok = is_leap_year(year) if (self.month, self.day) == (2, 29) else F.lit(True)
        day = F.lit(self.day) if (self.month, self.day) != (2, 29) else F.when(ok, 29).otherwise(28)
        at = F.make_timestamp_ntz(year, F.lit(self.month), day, F.lit(self.hour), F.lit(self.minute), F.lit(self.second).cast("decimal(16,6)"))
        return F.when(ok, at)


def key_of(ts: Column) -> Column:
    """A Yearless's key of a time stamp."""
    k = F.month(ts)
    for part in (F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)):
        k = k * 100 + part
    return k


def in_yearless_range(ts: Column, first: Yearless, last: Yearless, first_year: Column) -> Column:
    """Whether ts is between first and last of some year of the data, both inclusive.

    A range over the turn of the year starts in a year of the data, so the days before `last` in the data's first year
    (first_year) aren't in it. In years without February 29, a range starts on March 1 or ends with February 28 instead.
    """
    leap = is_leap_year(F.year(ts))
    k = key_of(ts).cast("long")
    exact = F.when(F.date_trunc("second", ts) == ts, 0).otherwise(1)  # fractions of the last second are beyond it
    low = F.when(leap, first.key).otherwise((first if (first.month, first.day) != (2, 29) else Yearless(3, 1)).key)
    end = last if (last.month, last.day) != (2, 29) else Yearless(2, 28, 23, 59, 59)
    high = F.when(leap, last.key).otherwise(end.key)
    after, before = k >= low, (k < high) | ((k == high) & (exact == 0))
    if first <= last:
        return after & before
    return after | (before & (F.year(ts) > first_year))
