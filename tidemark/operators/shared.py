"""The folder that all machines see, and tables that are written there once and read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own setting; on one machine without either, a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder: what reads it several times doesn't compute it again, and its plan
    begins here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def whole_groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the first row of each, from batches in which the rows of a group follow one another.

    A call for each group costs milliseconds; so many groups as a batch holds are one table, and a group that is longer than a
    batch is held until it ends.
    """
    held: list[pa.RecordBatch] = []

    def first_rows(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in by:
            column = rows.column(c)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def whole() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        return rows, first_rows(rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(first_rows(batch)[-1])
        if last:
            held.append(batch.slice(0, last))
        elif held and repr(held[-1].slice(held[-1].num_rows - 1).select(by).to_pylist()) == repr(batch.slice(0, 1).select(by).to_pylist()):
            held.append(batch)
            continue
        if held:
            yield whole()
        held = [batch.slice(last)]
    if held:
        yield whole()
