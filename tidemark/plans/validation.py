"""The whole validation as one lazy plan: read, mask, match, combine, scale, measure, and give every location a status."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calculators, collocate, scaling
from ..operators.adapters import drop_masked
from ..sources.datasets import Dataset
from .combos import combo_key, result_combinations


class ValidationError(Exception):
    """A validation that has a location with a failure, in raise mode; code is the status."""

    def __init__(self, status: int, location):
        super().__init__(f"location {location}: status {status}")
        self.status, self.location = status, location


@dataclass
class Validation:
    """Datasets against each other, at the locations of the spatial reference.

    calculators: {(n, k): calculator}: n datasets are matched at once (n must be the number of datasets), every k columns of
    different datasets are compared; a calculator gets columns ref, k1, ... in the order of the combination's sorted names.
    Rows count for a combination if all n datasets have a match at that time with inner, else if its own columns have values.
    scaling may be a function of the frame, its columns and the reference column; matcher one of the frames by name and the
    temporal reference's name, which returns loc_id, ts and name__column.
    """

    datasets: dict[str, Dataset]
    spatial_ref: str
    calculators: dict[tuple[int, int], calculators.Calculator]
    temporal_window: float = 1 / 24
    temporal_ref: str | None = None
    masking_datasets: dict[str, tuple[Dataset, str]] = field(default_factory=dict)
    period: tuple[str, str] | None = None
    scaling: str | Callable[[DataFrame, list[str], str], DataFrame] | None = "cdf_match"
    scaling_ref: str | None = None
    scaling_options: dict = field(default_factory=dict)
    method: str = "nearest"
    inner: bool = True
    matcher: Callable[[dict[str, DataFrame], str], DataFrame] | None = None
    _held: list[DataFrame] = field(default_factory=list, repr=False)

    def __post_init__(self):
        for n, _ in self.calculators:
            if n != len(self.datasets):
                raise ValueError(f"{n} datasets are asked for, there are {len(self.datasets)}")

    def frames(self, spark: SparkSession, locations: DataFrame) -> dict[str, DataFrame]:
        ids = locations.select("loc_id").distinct()
        found = {}
        for name, dataset in self.datasets.items():
            df = dataset.read(spark, self.period, locations if "lon" in locations.columns else None)
            if df is not None:
                found[name] = df.join(ids, "loc_id", "left_semi")
        return found

    def matched(self, spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame | None:
        """(loc_id, ts, name__column...) on the temporal reference's times."""
        ref = self.temporal_ref or self.spatial_ref
        if ref not in frames or len(frames) < 2:
            return None
        base = frames[ref]
        masks = {}
        for name, (dataset, flag) in self.masking_datasets.items():
            df = dataset.read(spark, self.period)
            if df is not None:
                masks[name] = (df, flag)
        if masks:
            base = drop_masked(base, masks, self.temporal_window)
        if self.matcher:
            return self.matcher(frames | {ref: base}, ref)
        base = base.withColumnsRenamed({c: f"{ref}__{c}" for c in self.datasets[ref].columns})
        others = {n: (df, self.datasets[n].columns) for n, df in frames.items() if n != ref}
        return collocate.combined(base, others, self.temporal_window, method=self.method, combined_dropna="any" if self.inner else "all")

    def calc(self, spark: SparkSession, locations: DataFrame, only_with_reference: bool = False, handle_errors: str = "ignore") -> DataFrame:
        """One row (or several, as calculators have it) for each location and combination, with `combo` and `status`.

        handle_errors: "ignore" keeps failures as rows; "raise" raises ValidationError for the first location that failed.
        """
        frames = self.frames(spark, locations)
        wide = self.matched(spark, frames)
        present = self._presence(frames, locations)
        if wide is not None and (len(self.calculators) > 1 or callable(self.scaling)):  # read more than once
            wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(wide)
        parts = []
        for (_, k), calculator in self.calculators.items():
            combos = result_combinations({n: d.columns for n, d in self.datasets.items()}, k)
            if only_with_reference:
                combos = [c for c in combos if any(d == self.spatial_ref for d, _ in c)]
            there = [c for c in combos if wide is not None and all(f"{d}__{column}" in wide.columns for d, column in c)]
            lacking = [c for c in combos if c not in there]
            if lacking:
                parts.append(self._without(present, lacking))
            if there:
                parts += [self._one(wide, c, calculator, present) for c in there] if callable(self.scaling) else [self._all(wide, there, calculator, present)]
        if not parts:
            raise ValueError("no combination to compare")
        result = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if handle_errors == "raise":
            result = result.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(result)
            bad = result.filter(F.col("status") > calculators.INSUFFICIENT_DATA).select("loc_id", "status").limit(1).collect()
            if bad:
                self.release()
                raise ValidationError(bad[0].status, bad[0].loc_id)
        return result

    def release(self) -> None:
        """Let go of what calc() keeps for its result, once that has been written."""
        while self._held:
            self._held.pop().unpersist()

    def _presence(self, frames: dict[str, DataFrame], locations: DataFrame) -> DataFrame:
        """(loc_id, has_data): whether the reference and at least one other dataset have rows there."""
        out = locations.select("loc_id").distinct().withColumn("__ref", F.lit(0)).withColumn("__others", F.lit(0))
        if self.spatial_ref in frames:
            refs = frames[self.spatial_ref].select("loc_id").distinct().withColumn("__r", F.lit(1))
            others = [df.select("loc_id") for n, df in frames.items() if n != self.spatial_ref]
            out = out.join(refs, "loc_id", "left").withColumn("__ref", F.coalesce("__r", "__ref")).drop("__r")
            if others:
                some = reduce(DataFrame.unionAll, others).distinct().withColumn("__o", F.lit(1))
                out = out.join(some, "loc_id", "left").withColumn("__others", F.coalesce("__o", "__others")).drop("__o")
        return out.select("loc_id", ((F.col("__ref") == 1) & (F.col("__others") == 1)).alias("__has"))

    def _without(self, present: DataFrame, combos: list) -> DataFrame:
        keys = F.array(*(F.lit(combo_key(c)) for c in combos))
        return present.select("loc_id", F.explode(keys).alias("combo"), _empty().alias("status"))

    def _scaling_ref(self) -> str:
        name = self.scaling_ref or self.spatial_ref
        return f"{name}__{self.datasets[name].columns[0]}"

    def _all(self, wide: DataFrame, combos: list, calculator, present: DataFrame) -> DataFrame:
        """All combinations at once: a row of wide becomes a row for each, and everything is grouped by location and combo."""
        names = ["ref", *(f"k{i}" for i in range(1, len(combos[0])))]
        keys = ["loc_id", "combo"]

        def row(combo) -> Column:
            columns = [f"{d}__{c}" for d, c in combo]
            cells = [F.lit(combo_key(combo)).alias("combo"), *(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))]
            if self.scaling:
                at = columns.index(self._scaling_ref()) if self._scaling_ref() in columns else -1
                cells += [F.col(self._scaling_ref()).alias("__base"), F.lit(at).alias("__at")]
            return F.struct(*cells)

        df = wide.select("loc_id", "ts", F.explode(F.array(*map(row, combos))).alias("__r")).select("loc_id", "ts", "__r.*")
        df = df.dropna("any", subset=[*names, *(["__base"] if self.scaling else [])])
        failed = None
        if self.scaling:
            raw = {i: f"__raw{i}" for i in range(len(names))}
            df = df.withColumns({raw[i]: F.col(c) for i, c in enumerate(names)})
            df = scaling.scaled_all(df, names, "__base", self.scaling, keys, **self.scaling_options)
            df = df.withColumns({c: F.when(F.col("__at") == i, F.col(raw[i])).otherwise(F.col(c)) for i, c in enumerate(names)})
            failed = _unscaled(df, keys, names)
        every = present.select("*", F.explode(F.array(*(F.lit(combo_key(c)) for c in combos))).alias("combo"))
        return _with_status(every, calculator(df.select(*keys, "ts", *names), keys), failed, keys)

    def _one(self, wide: DataFrame, combo, calculator, present: DataFrame) -> DataFrame:
        """One combination, for scalings that are functions of a frame with its columns by their own names."""
        columns, ref = [f"{d}__{c}" for d, c in combo], self._scaling_ref()
        extra = [ref] if ref not in columns else []
        df = wide.select("loc_id", "ts", *columns, *extra).dropna("any", subset=[*columns, *extra])
        df = self.scaling(df, columns, ref)
        failed = _unscaled(df, ["loc_id"], columns)
        df = df.select("loc_id", "ts", *(F.col(c).alias("ref" if i == 0 else f"k{i}") for i, c in enumerate(columns)))
        return _with_status(present, calculator(df, ["loc_id"]), failed, ["loc_id"]).withColumn("combo", F.lit(combo_key(combo)))


def _empty() -> Column:
    return F.when(F.col("__has"), calculators.NO_MATCHED_DATA).otherwise(calculators.NO_DATA).cast("int")


def _unscaled(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The keys that have rows, but a column without any value after scaling."""
    counts = df.groupBy(*keys).agg(*(F.count(c).alias(c) for c in columns), F.count("*").alias("__n"))
    bad = reduce(lambda a, b: a | b, [F.col(c) == 0 for c in columns])
    return counts.filter((F.col("__n") > 0) & bad).select(*keys, F.lit(True).alias("__unscaled"))


def _with_status(every: DataFrame, got: DataFrame, failed: DataFrame | None, keys: list[str]) -> DataFrame:
    """every(keys, __has) with the calculator's columns and a status for each row."""
    if "status" not in got.columns:
        got = got.withColumn("status", F.lit(calculators.OK))
    out = every.join(got.withColumn("__there", F.lit(True)), keys, "left")
    status = F.when(F.col("__there").isNull(), _empty()).otherwise(F.col("status"))
    if failed is not None:
        out = out.join(failed, keys, "left")
        status = F.when(F.col("__unscaled"), calculators.SCALING_FAILED).otherwise(status)
    return out.withColumn("status", status.cast("int")).drop("__has", "__there", "__unscaled")


def write_by_cell(result: DataFrame, locations: DataFrame, path: str) -> None:
    """Results by grid cell, so that a later read of one cell reads its files only. Warns if there's nothing."""
    if result.isEmpty():
        warnings.warn("no results to write", stacklevel=2)
        return
    result.join(locations.select("loc_id", "cell"), "loc_id", "left").write.mode("append").partitionBy("combo", "cell").parquet(path)
