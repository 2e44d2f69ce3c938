"""Structured Streaming forms of the operators that can be computed as data come in."""

from __future__ import annotations

from collections.abc import Iterator

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.calendar import bin_label
from ..functions.moments import pair_moments


def windowed_moments(stream: DataFrame, x: str, y: str, width: str, watermark: str, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Pair moments of tumbling windows: a stream of (keys, window, moments), each once its window is closed."""
    keys = ["loc_id"] if keys is None else keys
    return stream.withWatermark(ts, watermark).groupBy(*keys, F.window(ts, width)).agg(*pair_moments(x, y))


def dekad_means(stream: DataFrame, value: str, watermark: str, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Running means by dekad, for update or complete output."""
    keys = ["loc_id"] if keys is None else keys
    return stream.withWatermark(ts, watermark).groupBy(*keys, bin_label(F.col(ts)).alias("label")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def nearest_join(reference: DataFrame, other: DataFrame, value: str, window: str, watermark: str, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Candidates of the nearest match: a stream-stream interval join with watermarks on both sides, so state is bounded.

    Gives (keys, ts, value, distance_us); the nearest is the smallest distance of a reference row, the later one of equals:
    see nearest_of_candidates.
    """
    keys = ["loc_id"] if keys is None else keys
    a = reference.withWatermark(ts, watermark).alias("a")
    b = other.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(ts).alias("__ts"), F.col(value).alias("__value")).withWatermark("__ts", watermark).alias("b")
    same = " and ".join(f"a.{k} = b.__{k}" for k in keys)
    met = a.join(b, F.expr(f"{same} and b.__ts between a.{ts} - interval {window} and a.{ts} + interval {window}"))
    d = F.timestamp_diff("MICROSECOND", F.col(f"a.{ts}"), F.col("b.__ts"))
    return met.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{ts}").alias(ts), F.col("b.__ts").alias("ts_other"), F.col("__value").alias(f"{value}_other"), d.alias("distance_us"))


def nearest_of_candidates(candidates: DataFrame, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """The nearest candidate of every reference row of a finished (or a micro-batch's) table of candidates."""
    keys = ["loc_id"] if keys is None else keys
    values = [c for c in candidates.columns if c not in (*keys, ts)]
    best = F.min_by(F.struct(*values), F.struct(F.abs("distance_us"), -F.unix_micros(F.col("ts_other").cast("timestamp"))))
    return candidates.groupBy(*keys, ts).agg(best.alias("__b")).select(*keys, ts, "__b.*")


def exponential_filter(stream: DataFrame, value: str, ctime_days: float, key: str = "loc_id", ts: str = "ts") -> DataFrame:
    """The recursive exponential filter with state: last time, filtered value and gain of every key.

    Rows of a micro-batch are put in order of time; rows older than the state's time are late and left out, as are missing
    values.
    """
    tau = ctime_days * 86_400e6

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, y, gain = state.get if state.exists else (None, 0.0, 1.0)
        rows = []
        for stamp, x in pd.concat(list(parts))[["ts", "value"]].sort_values("ts").itertuples(index=False):
            us = int(stamp.value // 1000)
            if x is None or math.isnan(x) or (last is not None and us < last):
                continue
            if last is None:
                y, gain = float(x), 1.0
            else:
                gain = gain / (gain + math.exp(-(us - last) / tau))
                y += gain * (x - y)
            last = us
            rows.append((k[0], stamp, y))
        if last is not None:
            state.update((last, y, gain))
        yield pd.DataFrame(rows, columns=[key, "ts", "value"])

    kind = stream.schema[key].dataType.simpleString()
    stamp = stream.schema[ts].dataType.simpleString()
    rows = stream.select(key, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts {stamp}, value double", "last long, y double, gain double", "append", GroupStateTimeout.NoTimeout)
