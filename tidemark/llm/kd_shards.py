"""Shards by a k-d tree over the documents' metadata, in DataFrame operations only.

Each row has a place in [0, 1] in every dimension: numbers by their range, categories, which have no order, by their hash. A
cell that is to become k shards is cut along its widest dimension, where k // 2 of its k shares of the bytes are reached: the
weighted median if k is even. The cut is exact: rows are dealt by ranges of (cell, place, tie-breakers), the parts' sums tell
which part holds the cut, and only that part is summed row by row. Ties are broken by the text's hash, so that copies stay
together as far as the sizes allow, then by id. A level of the tree is one exchange of narrow rows; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

LAW = "bytes"
DIMENSIONS = ("source", "lang", "n_chars")
SHARDS = 8

_CELL = ["lo", "k"]


def _place(docs: DataFrame, name: str) -> Column:
    """A number that orders the column: itself, damped, or a category's hash as a fraction. Null and NaN have none."""
    kind = docs.schema[name].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        v = F.col(name).cast("double")
        return F.when(~F.isnan(v), F.asinh(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), v))))
    v = F.col(name).cast("string")
    return F.when(v.isNotNull(), F.shiftrightunsigned(F.xxhash64(v), 11) / float(1 << 53))


def _narrow(docs: DataFrame, dimensions: tuple[str, ...], text: str, doc_id: str) -> DataFrame:
    """(doc_id, size, crc, tie, uid, v0, v1, ...) with places within [0, 1]; a null has the lowest place."""
    t = F.col(text).cast("string")
    columns = [_place(docs, d).alias(f"v{n}") for n, d in enumerate(dimensions)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("crc"), F.xxhash64(t).alias("tie"), *columns)
    rows = checkpoint(rows.withColumn("uid", F.monotonically_increasing_id()))
    names = [c.format(n) for n in range(len(dimensions)) for c in ("l{}", "h{}")]
    ends = rows.agg(*(f(f"v{n}").alias(f"{x}{n}") for n in range(len(dimensions)) for x, f in (("l", F.min), ("h", F.max))))

    def scaled(n: int) -> Column:
        v, low, high = F.col(f"v{n}"), F.col(f"l{n}"), F.col(f"h{n}")
        return F.coalesce((v - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)).alias(f"v{n}")

    found = ends.first()  # two numbers for each dimension
    rows = rows.withColumns({c: F.lit(found[c]).cast("double") for c in names})
    return rows.select("doc_id", "size", "crc", "tie", "uid", *(scaled(n) for n in range(len(dimensions))))


def _cut(rows: DataFrame, dimensions: int) -> DataFrame:
    """rows with every cell cut in two; all have k > 1. What is broadcast has a row for each cell, of which there are fewer than shards."""
    widths = [(F.max(f"v{n}") - F.min(f"v{n}")).alias(f"w{n}") for n in range(dimensions)]
    stats = rows.groupBy(*_CELL).agg(F.sum("size").alias("total"), *widths)
    widest = F.greatest(*(F.struct(F.col(f"w{n}").alias("w"), F.lit(-n).alias("n")) for n in range(dimensions)), F.struct(F.lit(-1.0).alias("w"), F.lit(0).alias("n")))
    stats = stats.select(*_CELL, (-widest["n"]).alias("axis"), (F.col("total") * F.floor(F.col("k") / 2) / F.col("k")).alias("share"))
    stats = checkpoint(stats)
    at = F.coalesce(*(F.when(F.col("axis") == n, F.col(f"v{n}")) for n in range(dimensions)))
    keyed = rows.join(F.broadcast(stats), _CELL).withColumn("at", F.struct(at.alias("place"), "tie", F.col("doc_id").alias("id"), "uid"))
    ranged = checkpoint(keyed.drop("axis").repartitionByRange("lo", "at").withColumn("part", F.spark_partition_id()))

    parts = ranged.groupBy("lo", "share", "part").agg(F.sum("size").alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy("lo").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("before", upto - F.col("bytes")).filter((F.col("before") <= F.col("share")) & (F.col("share") < F.col("before") + F.col("bytes")))
    opened = checkpoint(parts.select("lo", F.col("part").alias("cut_part"), "before"))
    held = ranged.join(F.broadcast(opened), "lo").filter("part = cut_part")
    run = F.sum("size").over(Window.partitionBy("lo").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # a row goes to the side on which most of it lies
    below = held.withColumn("middle", F.col("before") + run - F.col("size") / 2).filter("middle <= share").groupBy("lo").agg(F.max("at").alias("cut"))
    cuts = checkpoint(opened.join(below, "lo", "left"))
    left = (F.col("part") < F.col("cut_part")) | (F.col("part") == F.col("cut_part")) & F.coalesce(F.col("at") <= F.col("cut"), F.lit(False))
    half = F.floor(F.col("k") / 2).cast("int")
    split = ranged.join(F.broadcast(cuts), "lo").withColumn("left", left).withColumn("half", half)
    lo, k = F.when(F.col("left"), F.col("lo")).otherwise(F.col("lo") + F.col("half")), F.when(F.col("left"), F.col("half")).otherwise(F.col("k") - F.col("half"))
    return split.withColumns({"lo": lo, "k": k}).select(*rows.columns)


def _slots(rows: DataFrame) -> DataFrame:
    """rows with slot, their place in their shard by id: numbered within ranges, then moved up by the ranges before."""
    order = ["doc_id", "tie", "uid"]
    ranged = checkpoint(rows.repartitionByRange("shard", *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    # a row for each part of a shard: fewer than shards and partitions together
    return ranged.withColumn("own", own).join(F.broadcast(parts), ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("own")).cast("long"))


def shards(docs: DataFrame, n_shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, in n_shards shards of nearly equal bytes.

    size is the text's UTF-8 bytes plus 1 (null: none, so 1). Each cut is at most half a document off its share. slot counts
    from 0 in each shard, by id. Nulls in a dimension have the lowest place; a null id comes first; repeated rows are rows of
    their own; with fewer rows than shards some shards are empty; an empty table gives an empty result. Other columns are
    left out, and dimensions that the table lacks are not used.
    """
    dimensions = tuple(d for d in dimensions if d in docs.columns)
    if not dimensions:
        raise ValueError("no dimension to cut along")
    rows = _narrow(docs, dimensions, text, doc_id).withColumns({"lo": F.lit(0), "k": F.lit(n_shards)})
    done = rows.filter("k = 1")
    for _ in range((n_shards - 1).bit_length()):
        rows = _cut(rows.filter("k > 1"), len(dimensions))
        done = done.unionByName(rows.filter("k = 1"))
    placed = _slots(done.withColumn("shard", F.col("lo")))
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_of_bytes(docs: DataFrame, target_bytes: int, **kw) -> DataFrame:
    """Shards with the number that brings them nearest to, and on average not over, target_bytes."""
    text = F.col(kw.get("text", "text")).cast("string")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)).first()[0] or 0
    return shards(docs, max(1, -(-total // target_bytes)), **kw)
