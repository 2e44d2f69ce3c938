"""Result tables: location rows and ragged time series in Parquet, one part for each combination of datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import numbered

EPOCH_1900 = "1900-01-01 00:00:00"


def to_days(ts: Column) -> Column:
    """Days since 1900-01-01, with fractions."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_1900).cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 86_400e6


def from_days(days: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(days * 86_400e6).cast("long"), F.lit(EPOCH_1900).cast("timestamp_ntz"))


def table_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path; None if there's none, or nothing in it yet."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Results:
    """Tables below a folder: `locations` (idx, lon, lat, metrics), partitioned by combo, and `series` (idx, ts, metrics)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        return table_at(self.spark, f"{self.path}/{name}")

    def add_metrics(self, rows: DataFrame, attributes: dict[str, dict] | None = None) -> None:
        """Append location rows with consecutive idx within each combo; attributes become column metadata.

        Within a combo new rows are numbered in order of lon, lat and then loc_id, after those that are there.
        """
        if "combo" not in rows.columns:
            rows = rows.withColumn("combo", F.lit("all"))
        order = [c for c in ("lon", "lat", "loc_id") if c in rows.columns] or [c for c in rows.columns if c != "combo"][:1]
        found = numbered(rows, ["combo"], order, "idx").withColumn("idx", F.col("idx").cast("int"))
        old = self._read("locations")
        if old is not None:
            done = old.groupBy("combo").agg(F.max("idx").alias("__last"))
            found = found.join(F.broadcast(done), "combo", "left").withColumn("idx", F.col("idx") + F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
        for c, meta in (attributes or {}).items():
            found = found.withMetadata(c, meta)
        found.write.mode("append").partitionBy("combo").parquet(f"{self.path}/locations")

    def add_series(self, rows: DataFrame) -> None:
        """Append long rows (combo, idx, ts, metrics); ts must be there."""
        if "ts" not in rows.columns:
            raise ValueError("time-series results need their times")
        rows.write.mode("append").partitionBy("combo").parquet(f"{self.path}/series")

    def read_locations(self, combo: str | None = "all", idx: int | list[int] | None = None) -> DataFrame:
        """The rows of one combo, or of all with None."""
        df = self._read("locations")
        df = df if combo is None else df.filter(F.col("combo") == combo)
        return df if idx is None else df.filter(F.col("idx").isin([idx] if isinstance(idx, int) else idx))

    def read_series(self, idx: int, combo: str = "all") -> DataFrame:
        return self._read("series").filter((F.col("combo") == combo) & (F.col("idx") == idx)).orderBy("ts")

    def read_all_series(self) -> DataFrame:
        return self._read("series")

    def index_of(self, lon: float, lat: float, combo: str = "all") -> DataFrame:
        return self.read_locations(combo).filter((F.col("lon") == lon) & (F.col("lat") == lat)).select("idx")

    def indices_of(self, points: DataFrame, combo: str | None = "all") -> DataFrame:
        """points(lon, lat) with combo and idx of the rows that lie there; points without any aren't in the result."""
        return self.read_locations(combo).select("lon", "lat", "combo", "idx").join(points, ["lon", "lat"])


class CellResults:
    """Results by combo and cell that a run may be stopped in, and that another run then completes.

    `rows` holds the results, partitioned by combo and cell; `done` lists the finished cells. A cell's rows replace what lies in
    its partitions, and it's listed only once they're committed: what a run left half written is written anew, and a cell that
    is listed isn't computed again. Reading gives finished cells only, each once, however often it was listed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def done(self) -> DataFrame | None:
        return table_at(self.spark, f"{self.path}/done")

    def pending(self, locations: DataFrame) -> DataFrame:
        """The locations of cells that aren't finished."""
        done = self.done()
        return locations if done is None else locations.join(done.select("cell").distinct(), "cell", "left_anti")

    def commit(self, rows: DataFrame, locations: DataFrame, run: str) -> None:
        """Write the rows (loc_id, combo, ...) of whole cells, then list all of the locations' cells, also those without rows."""
        cells = rows.join(locations.select("loc_id", "cell"), "loc_id")
        cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("combo", "cell").parquet(f"{self.path}/rows")
        locations.select("cell").distinct().withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/done")

    def complete(self, locations: DataFrame, compute: Callable[[DataFrame], DataFrame], run: str, batches: int = 1, most: int | None = None) -> int:
        """Compute what is missing: compute(locations) gives rows (loc_id, combo, ...). Cells are dealt into batches, each committed
        by itself; `most` ends the run after so many. Returns how many batches had something to do."""
        worked = 0
        for k in range(batches):
            mine = self.pending(locations.filter(F.pmod(F.xxhash64("cell"), F.lit(batches)) == k))
            if most is not None and worked == most:
                break
            if not mine.isEmpty():
                self.commit(compute(mine), mine, run)
                worked += 1
        return worked

    def read(self) -> DataFrame | None:
        rows, done = table_at(self.spark, f"{self.path}/rows"), self.done()
        return None if rows is None or done is None else rows.join(done.select("cell").distinct(), "cell", "left_semi")
