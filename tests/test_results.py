"""Results that survive a stopped run, and numbers of rows that one combination holds most of."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.sources.results import CellResults, Results, table_at


def places(spark, n=40):
    return spark.range(n).select(F.col("id").alias("loc_id"), F.floor(F.col("id") / 4).alias("cell"))


def rows_of(locations):
    return locations.select("loc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("combo")).filter("not (loc_id < 4 and combo = 'b')").withColumn("n", F.col("loc_id") * 2)


def read(kept):
    return sorted((r.combo, r.cell, r.loc_id, r.n) for r in kept.read().collect())


def test_a_stopped_run_is_completed(spark, tmp_path):
    want = sorted((r.combo, r.loc_id // 4, r.loc_id, r.n) for r in rows_of(places(spark)).collect())
    kept, seen = CellResults(spark, str(tmp_path / "r")), []
    assert kept.read() is None and kept.done() is None

    def compute(locations):
        seen.append({r.cell for r in locations.collect()})
        if len(seen) == 3:
            raise RuntimeError("lost")
        return rows_of(locations)

    with pytest.raises(RuntimeError):
        kept.complete(places(spark), compute, "one", batches=5)
    half = read(kept)
    assert 0 < len(half) < len(want) and set(half) <= set(want)
    # a cell that a lost run has written, but not listed, isn't read, and is replaced
    broken = kept.pending(places(spark)).limit(1).collect()[0]
    spark.createDataFrame([(999, 1, "a", broken.cell)], "loc_id long, n long, combo string, cell long").write.mode("append").partitionBy("combo", "cell").parquet(f"{kept.path}/rows")
    assert read(kept) == half
    kept.complete(places(spark), compute, "two", batches=2)
    assert read(kept) == want
    assert kept.complete(places(spark), compute, "three") == 0 and not set.intersection(seen[0], *seen[3:])
    assert {r.run for r in kept.done().collect()} == {"one", "two"}


def test_cells_without_rows_are_done_too(spark, tmp_path):
    kept = CellResults(spark, str(tmp_path / "r"))
    assert kept.complete(places(spark, 8), lambda x: rows_of(x).filter("loc_id >= 4"), "one") == 1
    assert kept.pending(places(spark, 8)).isEmpty() and {r[2] for r in read(kept)} == {4, 5, 6, 7}
    kept.commit(rows_of(places(spark, 4)), places(spark, 4), "again")  # a cell that is written again is there once
    assert len(read(kept)) == len({r[:3] for r in read(kept)}) == 12
    assert kept.pending(places(spark, 12)).count() == 4


def test_numbers_over_many_parts(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(5).alias("k"), ((F.col("id") * 7919) % 5003).alias("v")).repartition(7)
    got = splits.numbered(df, ["k"], ["v"], "i").collect()
    assert len(got) == 5000
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.v, r.i))
    assert all([i for _, i in sorted(x)] == list(range(len(x))) for x in by.values())


def test_rows_are_found_by_coordinates(spark, tmp_path):
    kept = Results(spark, str(tmp_path / "r"))
    assert table_at(spark, str(tmp_path / "nothing")) is None
    kept.add_metrics(spark.createDataFrame([(k, float(k), -float(k), 1.5) for k in range(5)], "loc_id int, lon double, lat double, m double"))
    kept.add_metrics(spark.createDataFrame([(9, 7.0, 7.0, 2.5)], "loc_id int, lon double, lat double, m double"))
    points = spark.createDataFrame([(3.0, -3.0), (7.0, 7.0), (0.5, 0.5)], "lon double, lat double")
    assert {(r.lon, r.idx) for r in kept.indices_of(points).collect()} == {(3.0, 3), (7.0, 5)}
    assert kept.index_of(7.0, 7.0).first().idx == 5 and kept.read_locations(None).count() == 6
