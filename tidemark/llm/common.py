"""Helpers that several operators share: the shared folder, checkpoints and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that join_hot() broadcasts are fewer than this.
HOT_SHARE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see (spark.checkpoint.dir), else a local one, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: whole texts can be long, and a batch is held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """rows joined to lookup by key, whatever share of the rows one key holds; lookup is read more than once.

    lookup has each key once; weight counts the rows of a key. The keys with over a share-th of the summed weight, fewer
    than `share` by that very rule, are broadcast, so their rows stay where they are; all other rows are shuffled by key.
    """
    total = lookup.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) > total / share
    few = lookup.filter(hot).drop(weight)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(lookup.filter(~hot).drop(weight), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a state per task: make() runs once in each task and returns the function of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]

