"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, exact Hamming checks and components.

The 64 bits are cut into segments of `SEGMENT_BITS`. A fingerprint is embedded as its segments' bit counts; the Manhattan
distance of two embeddings never exceeds the Hamming distance, so it is a lower bound. The segments are dealt into groups.
With G groups and at most `max_bits` differing bits, at least G - max_bits groups are at Manhattan distance 0, so two
linked fingerprints share a cell of one of the grids, each grid being made of that many groups' bit counts. Within a cell
the count of all set bits is a range of the same bound; pairs in the range are kept if the Manhattan distance of their
embeddings is at most max_bits, and those are verified by XOR, exactly.

The number of groups follows the number of distinct fingerprints (more groups: more grids, with finer cells); the links
found don't depend on it. Crowded cells are cut into blocks and compared block against block, each pair of blocks in a
task of its own; a task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, map_batches, small_batches, texts_of
from .components import connected_components, local_forest

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
SEGMENT_BITS = 2
#: Fingerprints of one block of a crowded cell.
BLOCK_ROWS = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EVEN_BITS = np.uint64(0x5555555555555555)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text: bit b is 1 if over half of the shingles' hashes have it.

    Shingles are `words` consecutive words, repeats included, joined by spaces; a shorter text is one shingle; a text
    without words has fingerprint zero.
    """
    raw = text.encode().translate(_LOWER)
    joined = b" ".join(raw.split())  # bytes.split() cuts at exactly \x20 and \x09-\x0d
    if not joined:
        return 0
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(ends) + 1
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(joined, seed)
    starts = [0, *(ends[: n - words] + 1).tolist()]
    stops = [*ends[words - 1 :].tolist(), len(joined)]
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n - words + 1)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    total = 0
    for k in range(8):
        ones = np.bincount(columns[:, k], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * ones > len(hashes)):
            total |= 1 << (8 * k + int(bit))
    return total


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.array([fingerprint(x) for x in texts_of(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "fp"])

        return one

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), make, "doc_id long, fp long")


def _segments(groups: int) -> list[list[int]]:
    """Masks of the segments of each group, dealt evenly."""
    masks = [((1 << SEGMENT_BITS) - 1) << s for s in range(0, 64, SEGMENT_BITS)]
    return [masks[len(masks) * g // groups : len(masks) * (g + 1) // groups] for g in range(groups)]


def groups_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Groups for n fingerprints: the fewest with which a random fingerprint meets at most some thousands in its cells."""
    same = 6 / 16  # chance of equal counts in two bits
    for groups in range(max_bits + 1, 64 // SEGMENT_BITS):
        exact = groups - max_bits
        if n * math.comb(groups, exact) * same ** (64 / SEGMENT_BITS * exact / groups) <= 4000:
            break
    return groups


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _cells(fps: DataFrame, groups: int, max_bits: int) -> DataFrame:
    """fps with a row for each grid: cell is the grid's number and the bit counts of its groups' segments."""

    def counts(masks: list[int]):
        key = F.lit(0).cast("long")
        for m in masks:
            key = key * 3 + F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")))
        return key

    by_group = [counts(m) for m in _segments(groups)]
    grids = itertools.combinations(range(groups), groups - max_bits)
    cells = F.array(*(F.struct(F.lit(k).alias("grid"), F.xxhash64(*(by_group[g] for g in grid)).alias("cell")) for k, grid in enumerate(grids)))
    return fps.select("fp", F.explode(cells).alias("at")).select("fp", "at.grid", "at.cell")


def embedded(fp: np.ndarray) -> np.ndarray:
    """The embedding of fingerprints, its 32 counts (0 to 2) in unary: the bits in which two of these differ are as many as
    the Manhattan distance of the counts."""
    one = np.uint64(1)
    either, both = (fp | fp >> one) & _EVEN_BITS, fp & fp >> one & _EVEN_BITS
    return either | both << one


def _close(p: np.ndarray, q: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs within max_bits between p and q, or within p. Sorted by set bits, rows meet only their range;
    there the Manhattan distance of the embeddings is the lower bound, and what it leaves is compared exactly."""
    own = q is None
    q = p if own else q
    pc, qc = np.bitwise_count(p).astype(np.int16), np.bitwise_count(q).astype(np.int16)
    po, qo = np.argsort(pc, kind="stable"), np.argsort(qc, kind="stable")
    ps, qs, pcs, qcs = p[po], q[qo], pc[po], qc[qo]
    pe, qe = embedded(ps), embedded(qs)
    left, right = [], []
    for k in range(0, len(ps), 256):
        lo = k if own else np.searchsorted(qcs, pcs[k] - max_bits, "left")
        hi = np.searchsorted(qcs, pcs[min(k + 256, len(ps)) - 1] + max_bits, "right")
        a, b = np.nonzero(np.bitwise_count(pe[k : k + 256, None] ^ qe[None, lo:hi]) <= max_bits)
        sure = np.bitwise_count(ps[a + k] ^ qs[b + lo]) <= max_bits
        left.append(po[a[sure] + k])
        right.append(qo[b[sure] + lo])
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprint pairs within max_bits. fps(fp): distinct longs."""
    n = fps.count()
    cells = _cells(fps, groups_for(n, max_bits), max_bits)
    crowded = cells.groupBy("grid", "cell").count().filter(F.col("count") > 1).select("grid", "cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = cells.join(crowded, ["grid", "cell"]).withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grid", "cell", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).alias("second"), "fp")

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        second = np.asarray(group.column("second").combine_chunks())
        own = group.column("p")[0].as_py() == group.column("q")[0].as_py()
        if own:
            i, j = _close(fp, None, max_bits)
        else:
            first, later = np.flatnonzero(~second.astype(bool)), np.flatnonzero(second.astype(bool))
            if not len(first) or not len(later):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            i, j = _close(fp[first], fp[later], max_bits)
            i, j = first[i], later[j]
        root = local_forest(i, j, len(fp))
        child = np.flatnonzero(root != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.table({"a": signed[child], "b": signed[root[child]]})

    return dealt.groupBy("grid", "cell", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest id reachable over links, itself included.

    Documents link if their fingerprints differ in at most max_bits bits; equal fingerprints always link. Rows without an
    id get no part in a component's name (a component of such rows only has a null one). Repeated rows repeat in the
    result; an empty table gives an empty one; other columns are left out.
    """
    rows = checkpoint(fingerprints(docs, text, doc_id))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    forest = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    classes = checkpoint(distinct.join(forest.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "rows", F.coalesce("component", "fp").alias("root")))
    names = checkpoint(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("fps")))
    named = checkpoint(join_hot(classes, names, "root", "fps").select("fp", "component_id", "rows"))
    return join_hot(rows, named, "fp", "rows").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component of found: the one that names it. Rows of docs without an id stay.

    Of rows that share that id the one with the smallest text stays (null before any; among equal texts, by a hash of the row).
    """
    ids = found.filter("doc_id = component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    kept = docs.join(ids, "doc_id", "left_semi")
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*plain)))
    return kept.groupBy(F.col("doc_id").alias("__key")).agg(first.alias("__row")).select("__row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
