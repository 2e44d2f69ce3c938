"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors become one representative. The directions' principal axes, from second moments summed over all of them, order
the dimensions. Representatives are dealt into cells by their leading coordinates: two unit vectors with cosine >= t are at
most sqrt(2 - 2t) apart in each, so only neighbouring cells are compared, block against block, each pair of blocks in a task.
Within a pair of blocks the leading dimensions' products are added up first; the rest is bounded by the product of the
suffix norms, and pairs whose bound is below t are dropped before more dimensions are read. What is left is decided by the
cosine of the stored vectors in double precision. A task returns link counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, map_batches
from .components import connected_components, local_forest

THRESHOLD = 0.95
#: Leading coordinates of a cell.
GRID_DIMS = 3
#: Rows of a block, and its values (rows times dimensions), at most: what a task holds of each side.
BLOCK_ROWS = 16384
BLOCK_VALUES = 1 << 22
#: Pairs that are confirmed at a time.
PART = 1 << 17
#: Dimensions after which the bound is tested.
STEPS = (16, 32, 64, 128, 256, 512)
_SLACK = 1e-9

_VALID = (
    "embedding is not null and size(embedding) > 0 and exists(embedding, x -> x != 0) "
    "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(reps: DataFrame, dim: int) -> np.ndarray:
    """The d x d rotation whose columns are the principal axes of all unit vectors of that length, by falling variance.

    Each task sums moments of its own vectors; eight more add these sums up, so the driver gets eight matrices.
    """

    def moments(batches):
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0)))
                n, first, second = n + len(u), first + u.sum(axis=0), second + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], first, second.ravel()]).tobytes()], pa.binary())], names=["m"])

    def added(batches):
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    sums = reps.filter(F.size("v") == dim).select("v").mapInArrow(moments, "m binary").repartition(8).mapInArrow(added, "m binary")
    total = np.sum([np.frombuffer(r.m) for r in sums.collect()], axis=0)
    n, mean, second = max(total[0], 1), total[1 : dim + 1], total[dim + 1 :].reshape(dim, dim)
    _, axes = np.linalg.eigh(second / n - np.outer(mean / n, mean / n))
    return np.ascontiguousarray(axes[:, ::-1])


def linked(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray | None, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of the pairs of rows of x and y, or of x (i < j), with cosine >= t, at most PART pairs at a time."""
    own = y is None
    sides = []
    for raw in (x,) if own else (x, y):
        u = _unit(raw)
        sides.append((u, u @ axes if axes is not None and len(axes) == u.shape[1] else u))
    (ux, rx), (uy, ry) = sides[0], sides[-1]
    d = ux.shape[1]
    stops = [s for s in STEPS if s < d] + [d]
    tails = [[np.sqrt(np.maximum(0, np.square(r[:, s:]).sum(axis=1))) for s in stops] for r in (rx, ry)]
    head = stops[0]
    a, b = np.c_[rx[:, :head], tails[0][0]], np.ascontiguousarray(np.c_[ry[:, :head], tails[1][0]].T)
    for k in range(0, len(rx), 128):
        lo = k if own else 0
        i, j = np.nonzero(a[k : k + 128] @ b[:, lo:] >= t - _SLACK)  # leading products and the bound of the rest, in one product
        i, j = i + k, j + lo
        if own:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), PART):
            pi, pj = i[part : part + PART], j[part : part + PART]
            got = np.einsum("ij,ij->i", rx[pi, :head], ry[pj, :head])
            for step in range(1, len(stops)):
                got = got + np.einsum("ij,ij->i", rx[pi, stops[step - 1] : stops[step]], ry[pj, stops[step - 1] : stops[step]])
                keep = got + tails[0][step][pi] * tails[1][step][pj] >= t - _SLACK
                pi, pj, got = pi[keep], pj[keep], got[keep]
            sure = np.einsum("ij,ij->i", ux[pi], uy[pj]) >= t
            yield pi[sure], pj[sure]


def folded(x: np.ndarray, second: np.ndarray | None, copies: np.ndarray, axes: np.ndarray | None, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's linked copies and its smallest reachable row: among all rows, or between those of the first and second block.

    Links are counted and put into the forest as they are found; none is kept, so memory goes with the rows."""
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    if second is None:
        a = b = root.copy()
        found = linked(x, None, axes, t)
    else:
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        found = linked(x[a], x[b], axes, t) if len(a) and len(b) else ()
    for i, j in found:
        i, j = a[i], b[j]
        n += (np.bincount(i, copies[j], len(n)) + np.bincount(j, copies[i], len(n))).astype(np.int64)
        i, j = root[i], root[j]
        if (apart := i != j).any():
            root = local_forest(i[apart], j[apart], len(n))[root]
    return n, root


def near_embeddings(vectors: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Vectors link if their cosine, in double precision, is >= t (0 < t < 1), whatever other columns say. n_links counts the
    other vectors linked directly, copies and repeated rows included; component_id is the smallest vec_id reachable, itself
    included. Null, empty and zero vectors, those with null or non-finite components, and rows without an id link with
    nothing. Vectors of different lengths don't link. An id is taken to name one vector. Empty tables give empty results.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"case when vec_id is not null and {_VALID} then embedding end").alias("v"))
    valid = rows.filter("v is not null")
    reps = checkpoint(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    common = reps.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    axes = principal_axes(reps, common.d) if common else None
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    width = math.sqrt(2 - 2 * t) + 1e-6
    cell = ["d", *(f"c{k}" for k in range(GRID_DIMS))]

    def make():
        axes = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _unit(_matrix(batch.column(0)))
            lead = (x @ axes[:, :GRID_DIMS]) if axes is not None and len(axes) == x.shape[1] else x[:, :GRID_DIMS]
            at = np.zeros((len(x), GRID_DIMS), np.int32)
            at[:, : lead.shape[1]] = np.floor(lead / width)
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(at[:, k])) for k in range(GRID_DIMS))], names=[*batch.schema.names, *cell[1:]])

        def by_length(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = np.asarray(batch.column(3))
            if (sizes == sizes[0]).all():
                return one(batch)
            parts = [one(batch.filter(pa.array(sizes == s))) for s in np.unique(sizes)]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        return by_length

    kind = reps.schema["v"].dataType.simpleString()
    placed = map_batches(reps.select("v", "rep", "copies", F.size("v").alias("d")), make, f"v {kind}, rep long, copies long, d int, " + ", ".join(f"{c} int" for c in cell[1:]))
    placed = checkpoint(placed)

    counts = checkpoint(placed.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_VALUES / F.col("d"))))).cast("int").alias("blocks")))
    steps = [s for s in itertools.product((-1, 0, 1), repeat=GRID_DIMS) if s >= (0,) * GRID_DIMS]  # the other half is the same pairs
    near = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"s{k}") for k, x in enumerate(s))) for s in steps))).alias("s")
    first = counts.select(*cell, "blocks", near).select("d", *(F.col(c).alias(f"a_{c}") for c in cell[1:]), F.col("blocks").alias("na"), *((F.col(f"c{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in range(GRID_DIMS)))
    pairs = first.join(counts, cell).withColumn("own", F.expr(" and ".join(f"a_{c} = {c}" for c in cell[1:])))
    pairs = pairs.withColumn("i", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("j", F.explode(F.expr("case when own then sequence(i, blocks - 1) else sequence(0, blocks - 1) end")))
    pairs = checkpoint(pairs.withColumn("pair", F.monotonically_increasing_id()).withColumn("own", F.expr("own and i = j")))

    blocks = placed.join(counts, cell).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    of_first = pairs.select("d", *(F.col(f"a_{c}").alias(c) for c in cell[1:]), F.col("i").alias("block"), "pair", "own", F.lit(False).alias("second"))
    of_second = pairs.filter("not own").select(*cell, F.col("j").alias("block"), "pair", "own", F.lit(True).alias("second"))
    dealt = blocks.join(of_first.unionAll(of_second), [*cell, "block"]).select("pair", "own", "second", "rep", "copies", "v")

    def compare(group: pa.Table) -> pa.Table:
        axes = shared.value
        x, rep, copies = _matrix(group.column("v")), np.asarray(group.column("rep")), np.asarray(group.column("copies"))
        second = None if group.column("own")[0].as_py() else np.asarray(group.column("second").to_pylist(), bool)
        n, root = folded(x, second, copies, axes, t)
        got = np.flatnonzero(n)
        return pa.table({"rep": rep[got], "n": n[got], "root": rep[root[got]]})

    found = checkpoint(dealt.groupBy("pair").applyInArrow(compare, "rep long, n long, root long"))
    forest = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = reps.select("rep", "copies").join(sums, "rep", "left").join(forest.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.groupBy("rep").agg((F.sum(F.coalesce("n", F.lit(0))) + F.sum("copies") - 1).alias("n"), F.sum("copies").alias("copies"), F.min(F.coalesce("component", "rep")).alias("c"))
    member = join_hot(valid, reps.select("v", "rep", "copies"), "v", "copies", 1000).select("vec_id", "rep")
    joined = join_hot(member, checkpoint(named), "rep", "copies").unionByName(rows.filter("v is null").select("vec_id"), allowMissingColumns=True)
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
