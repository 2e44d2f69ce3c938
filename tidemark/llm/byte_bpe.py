"""Byte-level BPE encoding and decoding with a local rank file (tiktoken).

Long texts are split before the pattern runs. No match of SPLIT_PATTERN goes from a character that isn't white space on to
white space: its words, numbers and signs have blanks at their beginning only, and its blanks are a match of their own. So
every such place is a safe boundary, and the parts' ids are the whole's ids. White space is what the pattern's own \\s takes.
For other patterns, some of whose matches end with line breaks, this isn't proven: texts are then encoded in one piece.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts_of

#: Characters of a part of a long text.
PART_CHARS = 1 << 16
#: The pattern whose texts may be split. Fixed value.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's white space, which the library's \s stands for: without U+001C to U+001F, that Python's takes too.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])")


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """text, cut at safe boundaries into parts of about size characters; a run without white space stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    cut = parts(text) if encoding._pat_str == SPLIT_PATTERN else [text]
    got = [encoding.encode_to_numpy(x, disallowed_special=()) for x in cut]
    return (got[0] if len(got) == 1 else np.concatenate(got)).astype("<u4", copy=False)


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns `keep` and `ids`: each whole text's token ids as little-endian unsigned 32-bit integers.

    A null text is the empty text, which has no ids. Very long texts are encoded whole, in parts where that is proven safe.
    Rows are independent: repeated rows give repeated results, an empty table an empty one, and columns other than `keep`
    and `text` are left out.
    """
    small_batches(docs.sparkSession)

    def make():
        encoding = rank_encoding(rank_path, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = pa.array([encode_text(encoding, x).tobytes() for x in texts_of(batch.column(batch.num_columns - 1))], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*keep, ids])

        return one

    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, make, f"{fields}, `{ids}` binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """encoded with another column `out`: the raw bytes of the tokens in `ids` (null: null). Bytes need not be whole UTF-8."""
    small_batches(encoded.sparkSession)

    def make():
        encoding = rank_encoding(rank_path, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            raw = pa.array([None if x is None else encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in col], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, out])

        return one

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_batches(encoded, make, f"{fields}, `{out}` binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded from the ids."""
    both = decode(encode(docs, rank_path, pattern), rank_path, pattern)
    return both.select(
        "doc_id",
        F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
