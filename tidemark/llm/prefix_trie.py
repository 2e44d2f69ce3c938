"""The prefix trie of conversations, by fixed-length blocks of turns.

A conversation is a sequence of turns; a prefix is named by the xor of 128-bit hashes of its (place, role, text) triples, so
prefixes are running xors, which a scan in two levels gives however long a conversation is. Conversations are first grouped by
blocks of `BLOCK` turns, each block under the prefix before it. All members of a group pass through the same nodes, so from
there on a group is one row with sums of its members. Where a prefix has a single block below it, the block's nodes are those of
its representative as they stand; only where siblings diverge are turns compared, and these are turns of representatives.

What a node says of its subtree comes from its members: a node is owned by its smallest member, so that a conversation owns the
end of its path, and sums over a subtree's nodes are sums of what members own. Nothing is quadratic in the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_hot

#: Turns of a block, and turns of a stretch of a scan.
BLOCK, STRETCH = 4, 4096
SHARED_TURNS, FAMILY = 9, 5

_TURN = "c long, i long, p long, q long, bytes long"


def _places(turns: DataFrame, by: str, order: list[str]) -> DataFrame:
    """turns with each row's place (i, from 0) among those of its key: rows are dealt by ranges of (key, order), numbered there
    and moved up by what lies before, so a key that holds most rows is many tasks' work."""
    ranged = checkpoint(turns.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # only keys that lie in several parts have anything before: at most one for each part
    moved = sizes.withColumn("__before", F.sum("__n").over(before)).filter("__before > 0").select(by, "__part", "__before")
    own = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)) - 1
    placed = ranged.withColumn("__own", own).join(F.broadcast(moved), [by, "__part"], "left")
    return placed.withColumn("i", (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__part", "__own", "__before")


def shared_turns(conv_id: Column, upto: int = SHARED_TURNS) -> Column:
    """How many first turns conversation conv_id takes from the one that begins its family."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(upto))


def rebuilt(conversations: DataFrame, upto: int = SHARED_TURNS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """The turns (c, i, p, q, bytes) of all rebuilt conversations and their ids (c); p and q are a turn's hash.

    Turns stand in order of `turn`, null first, ties by role and text. Rows without a conv_id belong to none and are left out.
    """
    text = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")]
    own = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", *text).filter("c is not null")
    hashes = [F.xxhash64(F.lit(salt), "i", F.octet_length("role"), "role", "text").alias(name) for salt, name in ((1, "p"), (2, "q"))]
    size = F.octet_length("text").cast("long").alias("bytes")
    placed = _places(own, "c", ["turn", "role", "text"]).select("c", "i", "role", "text")
    h = shared_turns(F.col("c"), upto)
    # a turn goes on in its own conversation, if that doesn't replace it, and as a first turn in those of its family
    of_base = F.when((F.pmod("c", F.lit(family)) == 0) & (F.col("i") < upto - 1), F.sequence(F.col("c") + 1, F.col("c") + family - 1))
    ids = checkpoint(own.select("c").distinct())
    mine = placed.filter((F.pmod("c", F.lit(family)) == 0) | (F.col("i") >= h))
    taken = placed.filter(of_base.isNotNull()).withColumn("c", F.explode(of_base)).filter(F.col("i") < h).join(ids, "c", "left_semi")
    # own turns follow those taken without a gap: the base may have had fewer than h
    base = ids.filter(F.pmod("c", F.lit(family)) != 0).select("c", (F.col("c") - F.pmod("c", F.lit(family))).alias("b"))
    lengths = placed.filter(F.col("i") < upto - 1).filter(F.pmod("c", F.lit(family)) == 0).groupBy(F.col("c").alias("b")).agg(F.count("*").alias("n"))
    short = base.join(lengths, "b", "left").select("c", (h - F.least(h, F.coalesce("n", F.lit(0)))).alias("gap")).filter("gap > 0")
    moved = _with_gap(mine, short)
    return moved.unionByName(taken).select("c", "i", *hashes, size), ids


def _with_gap(mine: DataFrame, short: DataFrame) -> DataFrame:
    weights = mine.groupBy("c").agg(F.count("*").alias("w")).join(short, "c", "left").select("c", F.coalesce("gap", F.lit(0)).alias("gap"), "w")
    return join_hot(mine, weights, "c", "w").withColumn("i", F.col("i") - F.col("gap")).drop("gap")


def _running(turns: DataFrame) -> DataFrame:
    """turns with the xors and the bytes up to and including each: a scan within stretches, then over stretches."""
    turns = turns.withColumn("s", F.floor(F.col("i") / STRETCH))
    totals = turns.groupBy("c", "s").agg(F.bit_xor("p").alias("tp"), F.bit_xor("q").alias("tq"), F.sum("bytes").alias("tb"))
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    older = totals.select("c", "s", F.bit_xor("tp").over(before).alias("tp"), F.bit_xor("tq").over(before).alias("tq"), F.sum("tb").over(before).alias("tb")).filter("s > 0")
    upto = Window.partitionBy("c", "s").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.withColumns({"rp": F.bit_xor("p").over(upto), "rq": F.bit_xor("q").over(upto), "rb": F.sum("bytes").over(upto)}).join(older, ["c", "s"], "left")
    zero = F.lit(0).cast("long")
    p, q = F.col("rp").bitwiseXOR(F.coalesce("tp", zero)), F.col("rq").bitwiseXOR(F.coalesce("tq", zero))
    node = F.struct((F.col("i") + 1).alias("d"), p.alias("p"), q.alias("q")).alias("node")
    above = F.struct(F.col("i").alias("d"), p.bitwiseXOR(F.col("p")).alias("p"), q.bitwiseXOR(F.col("q")).alias("q")).alias("above")
    return run.select("c", "i", "bytes", node, above, (F.col("rb") + F.coalesce("tb", zero) - F.col("bytes")).alias("path"))


def _blocks(run: DataFrame, block: int) -> DataFrame:
    """(c, under, group, ends): a conversation's blocks, by the prefix before and the prefix after."""
    b = F.floor(F.col("i") / block)
    return run.groupBy("c", b.alias("b")).agg(F.min("above").alias("under"), F.max("node").alias("group"))


def _nodes(run: DataFrame, blocks: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes but for the root, and for each of them the groups of block members it's made of (node, group, n, m)."""
    groups = checkpoint(blocks.groupBy("under", "group").agg(F.count("*").alias("n"), F.min("c").alias("m")))
    siblings = groups.groupBy("under").agg(F.count("*").alias("siblings"))
    groups = checkpoint(join_hot(groups, siblings.withColumn("w", F.col("siblings")), "under", "w"))
    # the turns of representatives: a group's smallest member, in the group's block
    b = F.floor(F.col("i") / block)
    chosen = groups.select(F.col("m").alias("c"), F.floor(F.col("under.d") / block).alias("b"), "group", "n", "siblings")
    turns = checkpoint(run.withColumn("b", b).join(chosen, ["c", "b"]).select("c", "node", "above", "bytes", "path", "group", "n", "siblings"))
    alone = turns.filter("siblings = 1").select("node", "above", "bytes", "path", "n", F.col("c").alias("m"))
    split = turns.filter("siblings > 1").groupBy("node").agg(F.first("above").alias("above"), F.first("bytes").alias("bytes"), F.first("path").alias("path"), F.sum("n").alias("n"), F.min("c").alias("m"))
    return checkpoint(alone.unionByName(split)), turns.select("node", "group")


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends(c, node): SHA-256 of the ascending ids, which is sequential by definition, so a node's ids
    pass through one task; they're sorted on disk if need be and streamed, and none are held."""

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["d", "p", "q", "ends_sha256"])

        for batch in batches:
            for key, c in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), batch.column(3).to_pylist(), strict=True):
                if key == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(str(c).encode())
            if len(done) > 10_000:
                yield out()
                done.clear()
        if at is not None:
            done.append((*at, sha.hexdigest()))
        yield out()

    rows = ends.select("node.d", "node.p", "node.q", "c").repartition("d", "p", "q").sortWithinPartitions("d", "p", "q", "c")
    return rows.mapInArrow(stream, "d long, p long, q long, ends_sha256 string").select(F.struct("d", "p", "q").alias("node"), "ends_sha256")


def prefix_trie(conversations: DataFrame, upto: int = SHARED_TURNS, family: int = FAMILY, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A null role or text is empty; null turns come first; repeated rows are turns of their own; other columns are
    left out. Conversations without turns end at the root. An empty table has no nodes.
    """
    turns, ids = rebuilt(conversations, upto, family)
    run = checkpoint(_running(checkpoint(turns)))
    blocks = checkpoint(_blocks(run, block))
    nodes, parts = _nodes(run, blocks, block)
    zero = F.lit(0).cast("long")
    root = F.struct(*(zero.alias(x) for x in ("d", "p", "q")))
    every = ids.agg(F.count("*").alias("n"), F.min("c").alias("m")).filter("n > 0")
    no_node = F.lit(None).cast(nodes.schema["above"].dataType)
    nodes = nodes.unionByName(every.select(root.alias("node"), no_node.alias("above"), zero.alias("bytes"), zero.alias("path"), "n", "m"))
    below = nodes.filter("above is not null").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = checkpoint(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)))

    # what a conversation has in all, and what of it the conversation owns
    owned = nodes.groupBy(F.col("m").alias("c")).agg(F.sum("bytes").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    lengths = run.groupBy("c").agg(F.max("node").alias("last"), F.sum("bytes").alias("total"), F.count("*").alias("turns"))
    told = ids.join(lengths, "c", "left").join(owned, "c", "left")
    told = checkpoint(told.select("c", F.coalesce("last", root).alias("last"), *(F.coalesce(x, zero).alias(x) for x in ("total", "turns", "owned", "leaves"))))
    sums = [F.sum(x).alias(x) for x in ("total", "owned", "leaves")]
    # the members' sums by groups of blocks, then by nodes; a long conversation has many blocks
    by_group = checkpoint(join_hot(blocks.select("c", "group"), told.select("c", "total", "owned", "leaves", "turns"), "c", "turns").groupBy("group").agg(*sums))
    by_node = parts.join(by_group, "group").groupBy("node").agg(*sums).unionByName(told.agg(*sums).filter("total is not null").select(root.alias("node"), "total", "owned", "leaves"))
    full = nodes.join(by_node, "node").join(told.select(F.col("c").alias("m"), F.col("total").alias("m_total"), F.col("owned").alias("m_owned")), "m")
    # all members' bytes from here on, less those of the subtree's nodes once each
    passed = F.col("total") - F.col("n") * F.col("path")
    once = F.col("owned") - F.col("m_owned") + F.col("m_total") - F.col("path")
    full = full.withColumn("saved_tokens", passed - once)
    digests = _digests(told.select(F.col("last").alias("node"), "c"))
    full = full.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    full = checkpoint(full)
    parents = full.filter("n_children > 0").select(F.col("node").alias("above"), F.col("m").alias("parent_conv_id"), F.col("n_children").alias("w"))
    linked = join_hot(full.filter("above is not null"), parents, "above", "w").unionByName(full.filter("above is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return linked.select(
        F.col("m").alias("conv_id"), F.col("node.d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), "saved_tokens", "ends_sha256",
    )
