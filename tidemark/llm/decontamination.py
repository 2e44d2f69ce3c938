"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive item words; the search alphabet is words, a block is two words. For each window
length there is one matcher: its shift table says how far the next possible end of a window is from a block, blocks that
no window has are skipped by almost a whole window, and a block with shift zero leads to a bucket of windows with that
suffix, which are compared word by word.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_batches, small_batches, texts_of

WINDOW_WORDS = 10
#: Windows that are searched for at once, at most about: what a worker holds. More of them are searched for in further passes.
PASS_WINDOWS = 250_000
#: Words of an item that stay together; longer items are cut into overlapping pieces, which have the same windows.
PIECE_WORDS = 5_000

#: A-Z to a-z; bytes up to \x7F other than digits and letters to blanks. Bytes of other characters stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, as UTF-8; null has none."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class WuManber:
    """Searches lists of words for windows that all have the same length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list], length: int):
        self.m, self.b = length, min(2, length)
        self.far = self.m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list]]] = {}
        for window, items in windows.items():
            for end in range(self.b, self.m + 1):
                block = window[end - self.b : end]
                if (step := self.m - end) < self.shift.get(block, self.far):
                    self.shift[block] = step
            self.buckets.setdefault(window[-self.b :], []).append((list(window), items))

    def search(self, words: list[bytes]):
        """Yields (start, items) of each occurrence, in order."""
        m, far, shift, buckets, n = self.m, self.far, self.shift.get, self.buckets, len(words)
        at = m
        if self.b == 1:
            while at <= n:
                for _, items in buckets.get((words[at - 1],), ()):
                    yield at - 1, items
                at += 1
            return
        while at <= n:
            block = (words[at - 2], words[at - 1])
            step = shift(block, far)
            if step:
                at += step
                continue
            first = words[at - m]
            for window, items in buckets[block]:
                if window[0] == first and words[at - m : at] == window:
                    yield at - m, items
            at += 1


def windows_of(items: list[tuple], length: int = WINDOW_WORDS) -> dict[int, dict[tuple[bytes, ...], list]]:
    """By window length: window -> ids of the items (id, text) that have it. Items without words have none; those without an
    id have no id to list. Equal words are one object, so a window is little more than its places."""
    found: dict[int, dict] = defaultdict(dict)
    one: dict[bytes, bytes] = {}
    for item, text in items:
        words = [one.setdefault(w, w) for w in words_of(text)]
        size = min(length, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            ids = found[size].setdefault(tuple(words[k : k + size]), [])
            if item is not None and (not ids or ids[-1] != item):  # an item's windows come one after another
                ids.append(item)
    return found


def scan(words: list[bytes], matchers: list[WuManber]) -> tuple[list[list[int]], set]:
    """Merged [start, end) ranges of hit words, and the items that occur."""
    found: set = set()
    ranges: list[tuple[int, int]] = []
    for matcher in matchers:
        for start, items in matcher.search(words):
            ranges.append((start, start + matcher.m))
            found.update(items)
    return merged(ranges), found


def merged(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def pieces(text: str, length: int) -> list[str]:
    """The words of an item in pieces of PIECE_WORDS windows at most, each going on into the next by length - 1 words."""
    words = words_of(text)
    return [b" ".join(words[k : k + PIECE_WORDS + length - 1]).decode() for k in range(0, max(1, len(words) - length + 1), PIECE_WORDS)] if words else []


def _lots(benchmark: DataFrame, length: int, limit: int) -> list[Callable[[], list]]:
    """Functions that fetch distinct item pieces (id, text) in lots of at most about `limit` windows; one lot is held at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for piece in pieces(text, length):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([piece])], names=["i", "t"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(cut, "i string, t string")
    items = checkpoint(items.distinct().select("i", "t", F.size(F.split("t", " ")).alias("n")))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lots = -(-total // limit) or 1
    return [lambda k=k: [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(lots)) == k).collect()] for k in range(lots)]


_held: dict[str, list[WuManber]] = {}


def _matchers(name: str, items: Callable[[], list], length: int) -> list[WuManber]:
    """The matchers of a lot, built once in each worker: those of the lot before are let go."""
    if name not in _held:
        _held.clear()
        _held[name] = [WuManber(w, size) for size, w in sorted(windows_of(items(), length).items())]
    return _held[name]


def _searched(docs: DataFrame, benchmark: DataFrame, keep: list[str], length: int, limit: int) -> DataFrame:
    """row, a struct of the columns `keep`, with n_words, hits and items."""
    spark = docs.sparkSession
    small_batches(spark)
    inside = "text" in keep and dict(docs.dtypes)["text"] == "string"
    text = [] if inside else [F.col("text").cast("string").alias("text")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), *text, F.lit(None).cast("array<array<int>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    lots = _lots(benchmark, length, limit)
    for k, lot in enumerate(lots):
        shared, name = spark.sparkContext.broadcast(lot()), uuid.uuid4().hex
        names = rows.columns if k + 1 < len(lots) else ["row", "hits", "items"]  # the last pass needs no text after it

        def make(shared=shared, name=name, names=names):
            matchers = _matchers(name, lambda: shared.value, length)

            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                n_words, hits, items = [], [], []
                texts = columns["row"].field("text") if inside else columns["text"]
                for text, old, ids in zip(texts_of(texts), columns["hits"].to_pylist(), columns["items"].to_pylist(), strict=True):
                    words = words_of(text)
                    ranges, found = scan(words, matchers)
                    n_words.append(len(words))
                    hits.append(merged([*map(tuple, ranges), *map(tuple, old)]) if old else ranges)
                    items.append(sorted(found.union(ids or ())))
                columns |= {"hits": pa.array(hits, pa.list_(pa.list_(pa.int32()))), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n_words, pa.int64())}
                return pa.RecordBatch.from_arrays([columns[c] for c in (*names, "n_words")], names=[*names, "n_words"])

            return one

        schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("n_words", T.LongType())])
        rows = map_batches(rows, make, schema)
        if k + 1 < len(lots):
            rows = checkpoint(rows.drop("n_words"))
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS, limit: int = PASS_WINDOWS) -> DataFrame:
    """doc_id, n_words, hits and items of every row of docs.

    hits holds the merged [start, end) ranges of words inside any occurrence of a window, items the ids of the items with
    occurring windows, as sorted strings; items without an id hit, but aren't listed. Null or empty texts have no words and
    no hits; very long texts are searched whole; repeated rows and extra columns do no harm; an empty benchmark hits nothing.
    Items are gathered in lots of about `limit` windows; a further lot is a further pass over checkpointed documents.
    """
    found = _searched(docs, benchmark, ["doc_id"], length, limit)
    return found.select("row.doc_id", "n_words", "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS, limit: int = PASS_WINDOWS) -> DataFrame:
    """docs without the documents that a window of an item occurs in; the rest keeps its rows, repeats and columns."""
    return _searched(docs, benchmark, docs.columns, length, limit).filter(F.size("hits") == 0).select("row.*")
