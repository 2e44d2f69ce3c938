"""Spatial matching: the nearest point of another grid within a distance, and fan-out by a lookup table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import known

RADIUS_M = 6_371_008.8


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points in degrees (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _cubes(edge: float) -> list[Column]:
    lon, lat = F.radians("lon"), F.radians("lat")
    place = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return [F.floor(p / edge).cast("int").alias(f"__{c}") for p, c in zip(place, "xyz", strict=True)]


def _within(points: DataFrame, others: DataFrame, max_dist: float) -> DataFrame:
    """points joined with the others within max_dist metres (__d); both have lon and lat, the others' columns are kept."""
    edge = 2 * math.sin(min(max_dist, math.pi * RADIUS_M) / (2 * RADIUS_M)) + 1e-9
    placed = others.select(*(c for c in others.columns if c not in ("lon", "lat")), F.col("lon").alias("__lon"), F.col("lat").alias("__lat"), *_cubes(edge))
    near = points.select("*", *_cubes(edge))
    for c in "xyz":
        near = near.withColumn("__s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"__{c}", F.col(f"__{c}") + F.col("__s"))
    d = great_circle(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat"))
    return near.join(placed, ["__x", "__y", "__z"]).withColumn("__d", d).filter(F.col("__d") <= max_dist)


def nearest_lookup(reference: DataFrame, other: DataFrame, max_dist: float, ref_id: str = "loc_id", other_id: str = "other_id") -> DataFrame:
    """(ref_id, other_id, distance): the nearest other point within max_dist metres; -1 and null where there is none.

    Both sides are put in cubes of the sphere's chord space with edges of the largest chord, so only 27 neighbouring cubes
    join, at poles and the date line too. Ties go to the smaller id. Points at one place are one point to the join.
    """
    places = other.groupBy("lon", "lat").agg(F.min(other_id).alias("__other"))
    found = _within(reference.select("lon", "lat").distinct(), places, max_dist)
    best = found.groupBy("lon", "lat").agg(F.min(F.struct("__d", "__other")).alias("__best"))
    out = reference.select(ref_id, "lon", "lat").join(best, ["lon", "lat"], "left")
    return out.select(ref_id, F.coalesce("__best.__other", F.lit(-1)).alias(other_id), F.col("__best.__d").alias("distance"))


def by_lookup(obs: DataFrame, lookup: DataFrame, ref_id: str = "loc_id", other_id: str = "other_id") -> DataFrame:
    """Observations of other points as those of the reference points they serve; -1 serves none. One to many is allowed."""
    rows = lookup.filter(F.col(other_id) != -1).select(F.col(ref_id).alias("__ref"), F.col(other_id).alias("__other"))
    return obs.join(rows, obs[ref_id] == rows["__other"]).drop("__other", ref_id).withColumnRenamed("__ref", ref_id)


def hamming_window(radius: float, distance: Column) -> Column:
    """Weights that fall from 1 at no distance to 0.08 at the radius, and are 0 beyond it."""
    return F.when(distance <= radius, 0.54 + 0.46 * F.cos(math.pi * distance / radius)).otherwise(F.lit(0.0))


def resample_to_grid(swath: DataFrame, grid: DataFrame, values: list[str], radius: float, weight=hamming_window, min_obs: int = 1, grid_id: str = "loc_id", only_valid: bool = False) -> DataFrame:
    """(grid_id, n_obs, values...): weighted means of the swath's values within radius metres of each grid point.

    swath and grid have lon and lat; missing values have no weight. With fewer than min_obs observations a point's values
    are null, or with only_valid it drops out. Observations at one place are added up before the join, and a grid's points at
    one place are one point to it.
    """
    sums = [f.alias(f"__{name}{i}") for i, c in enumerate(values) for name, f in (("sum", F.sum(known(c))), ("held", F.count(known(c))))]
    places = swath.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("__n"), *sums)
    met = _within(grid.select("lon", "lat").distinct(), places, radius).withColumn("__w", weight(radius, F.col("__d")))
    cells = [(F.sum(F.col("__w") * F.col(f"__sum{i}")) / F.nullif(F.sum(F.col("__w") * F.col(f"__held{i}")), F.lit(0.0))).alias(c) for i, c in enumerate(values)]
    found = met.groupBy("lon", "lat").agg(F.sum("__n").alias("n_obs"), *cells).filter(F.col("n_obs") >= min_obs)
    out = grid.select(grid_id, "lon", "lat").join(found, ["lon", "lat"], "inner" if only_valid else "left").select(grid_id, "n_obs", *values)
    return out.withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
