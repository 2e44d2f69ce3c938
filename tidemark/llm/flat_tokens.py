"""Token counts of the documents in flat token files without an index, by a separator scan.

A flat file is nothing but ids, little-endian, of two or four bytes; every document ends with the end-of-document id. Files
are cut into blocks at fixed offsets. A task searches its blocks for the end id with vectorised comparisons and knows the
lengths of the documents that begin and end inside; a prefix scan over the blocks' summaries (how many ends, and where the
last one is) numbers the documents and gives the first one of each block its start, wherever that was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh_dir, small_batches
from .token_files import open_fs, piece_encoder

END_ID = 50256
#: Bytes of a block: a multiple of every id width.
BLOCK_BYTES = 8 << 20


def write_flat(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode whole texts into flat files, each with its end id; returns (path, ordinal, doc_id), one row for each document.

    A task writes one file, as a stream, under a name of its own for each attempt; only files named in the result count.
    A null text is the empty text. `width` must hold every id, else OverflowError.
    """
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out_dir)
        encoder = piece_encoder(tokenizer_path, special=False)  # the end id must stand for ends only
        if max(len(encoder.bytes) - 1, end_id) >= 1 << (8 * width):
            raise OverflowError(f"ids need more than {width} bytes")
        end, kind = np.array([end_id], f"<u{width}").tobytes(), f"<u{width}"
        out, path, n = None, f"{root}/{uuid.uuid4().hex}.ids", 0
        for batch in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path)
            for got in encoder.encode_column(batch.column(1)):
                out.write(np.frombuffer(got, "<u4").astype(kind).tobytes() + end)
            yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], names=["path", "ordinal", "doc_id"])
            n += batch.num_rows
        if out is not None:
            out.close()

    return checkpoint(rows.mapInArrow(write, "path string, ordinal long, doc_id long"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at a path, folder or pattern that Spark can list; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def sized(paths: DataFrame) -> DataFrame:
    """paths(path) with each file's length."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                sizes.append(fs.get_file_info(at).size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "length"])

    return paths.mapInArrow(look, "path string, length long")


def document_lengths(files: DataFrame, end_id: int = END_ID, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens, ended) of every document in files(path, length), by place in its file from 0.

    n_tokens leaves the end id out. What follows a file's last end id, if anything, is a document with ended false. Two
    end ids in a row enclose an empty document; an empty file has none. A length that is no multiple of width raises
    ValueError. Files are streams of their own: a document doesn't go on in the next one.
    """
    block_bytes -= block_bytes % width
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long")))
    blocks = files.filter("length > 0").select("path", "length", at.alias("at")).repartition("path", "at")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids")
                fs, where = open_fs(path)
                with fs.open_input_file(where) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, length - begin), begin), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + begin // width
                first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (None, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([begin]), pa.array([length // width]), pa.array([len(ends)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))],
                    names=["path", "at", "total", "n", "first", "last", "rest"],
                )

    found = checkpoint(blocks.mapInArrow(scan, "path string, at long, total long, n long, first long, last long, rest array<long>"))
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("path", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("done"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("open"))
    inside = found.filter("n > 0").join(carried, ["path", "at"])
    lengths = F.concat(F.array(F.col("first") - F.col("open") - 1), F.col("rest"))
    ended = inside.select("path", "done", F.posexplode(lengths).alias("k", "n_tokens")).select("path", (F.col("done") + F.col("k")).cast("long").alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(True).alias("ended"))
    tails = found.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.max("total") - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens")).filter("n_tokens > 0")
    return ended.unionAll(tails.select("path", F.col("ordinal").cast("long"), F.col("n_tokens").cast("long"), F.lit(False)))


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(doc_id, n_tokens) of every document, counted in flat files that its texts are written to.

    Strings of special tokens in a text are ordinary text, so that the end id ends documents only. A null text is the empty
    text, whose count is zero; long texts are streamed whole. Repeated rows and rows without an id each have a row of their
    own; an empty table gives an empty one; other columns, whatever their names, are left out.
    """
    out_dir = fresh_dir(docs.sparkSession, "flat")
    order = write_flat(docs, tokenizer_path, out_dir, end_id, width)
    counted = document_lengths(sized(order.select("path").distinct()), end_id, width)
    return order.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
