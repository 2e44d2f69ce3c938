"""Datasets: how a named series table is read, which columns count, and how its points map to the reference's locations."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.adapters import in_period, naive_utc
from ..operators.spatial import by_lookup, nearest_lookup

Provider = Callable[[SparkSession], DataFrame]


def files(fmt: str, path: str, schema: T.StructType | str | None = None, **options) -> Provider:
    """A provider of a file format or table format that Spark reads; nothing is read before the plan runs."""

    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)

    return read


def table(name: str) -> Provider:
    return lambda spark: spark.read.table(name)


def frame(df: DataFrame) -> Provider:
    return lambda spark: df


@dataclass
class Dataset:
    """One input of a validation.

    provider gives rows with loc_id, ts and the value columns. Adapters are applied in order before anything else. With
    `lookup`, a table (loc_id, other_id), the dataset's own ids are other_id; with `points`, a table (other_id, lon, lat),
    the lookup is made of the nearest points within max_dist metres. Without either, ids are the reference's.
    """

    provider: Provider
    columns: list[str]
    adapters: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    lookup: DataFrame | None = None
    points: DataFrame | None = None
    max_dist: float = 25_000.0
    aggregate: str | None = None  # of several points for one location: "average"

    def read(self, spark: SparkSession, period: tuple[str, str] | None = None, locations: DataFrame | None = None) -> DataFrame | None:
        """(loc_id, ts, columns...) in the period; None, with a warning, where there's nothing to read."""
        try:
            df = self.provider(spark)
            df.schema  # noqa: B018  resolves the path
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                warnings.warn(f"nothing to read: {e.getCondition()}", stacklevel=2)
                return None
            raise
        df = in_period(naive_utc(df), period)
        for adapter in self.adapters:
            df = adapter(df)
        lookup = self.lookup
        if self.points is not None:
            if locations is None:
                raise ValueError("points need the locations' coordinates")
            lookup = nearest_lookup(locations, self.points, self.max_dist)
        if lookup is not None:
            df = by_lookup(df, lookup)
            if self.aggregate == "average":
                df = df.groupBy("loc_id", "ts").agg(*(F.avg(c).alias(c) for c in self.columns))
        return df.select("loc_id", "ts", *self.columns)
