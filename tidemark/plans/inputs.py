"""The driver's tables as time series, and the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import fresh_folder as fresh_folder

LOCATIONS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """(loc_id, ts, value, event_id) of one event type."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == event_type)
    return events.select((F.col("user_id") % LOCATIONS).alias("loc_id"), "ts", "value", "event_id")


def daily(spark: SparkSession, sf_dir: str, value: str = "l_quantity", key: str = "l_suppkey", groups: int = 8) -> DataFrame:
    """(loc_id, ts, value): daily means of a lineitem column; every 13th day after 1995-01-01 is a gap (null)."""
    items = table(spark, sf_dir, "lineitem").select((F.col(key) % groups).alias("loc_id"), F.col("l_shipdate").alias("ts"), value)
    means = items.groupBy("loc_id", "ts").agg(F.avg(value).alias("value"))
    gap = F.datediff(F.col("ts").cast("date"), F.lit("1995-01-01").cast("date")) % 13 == 0
    return means.select("loc_id", "ts", F.when(~gap, F.col("value")).alias("value"))


#: DuckDB's form of daily(): format with value, key and groups.
DAILY_SQL = (
    "select loc_id, ts, case when date_diff('day', date '1995-01-01', cast(ts as date)) % 13 != 0 then v end as value from "
    "(select {key} % {groups} as loc_id, l_shipdate as ts, avg({value}) as v from lineitem group by 1, 2)"
)
DAILY = DAILY_SQL.format(value="l_quantity", key="l_suppkey", groups=8)
SERIES_SQL = "select user_id % 16 as loc_id, ts, value, event_id from events where event_type = '{kind}'"


def rounded(c: Column | str, digits: int = 6) -> Column:
    """The value rounded; null for NaN; zero without a sign."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.nanvl(c, F.lit(None).cast("double")), digits) + F.lit(0.0)


def round_all(df: DataFrame, digits: int = 6, finer: str | None = None, fine_digits: int = 8) -> DataFrame:
    """All values rounded; columns whose names begin with `finer`, in either case, more finely: means of few decimals lie on ties."""

    def to(c: str) -> int:
        return fine_digits if finer and c.lower().startswith(finer) else digits

    return df.select(*(rounded(c, to(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
