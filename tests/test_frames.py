import json
import os
import re
import subprocess
import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calculators, spatial
from tidemark.plans.validation import Validation, ValidationError, write_by_cell
from tidemark.sources.datasets import Dataset, files, frame
from tidemark.sources.results import Results, from_days, to_days
from tidemark.streaming import streams

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DAY = datetime(2000, 1, 1)


def dataset(spark, name, n=1000, scale=1.0, locations=(1, 2, 3, 4), start=0):
    rows = spark.range(n).select(F.explode(F.array(*(F.lit(x).cast("long") for x in locations))).alias("loc_id"), F.timestamp_add("DAY", (F.col("id") + start).cast("int"), F.lit(DAY).cast("timestamp_ntz")).alias("ts"), (F.col("id") * scale).alias(name))
    return rows


def places(spark, ids=(1, 2, 3, 4)):
    return spark.createDataFrame([(k, float(k), float(k), 4 if k < 3 else 5 - k) for k in ids], "loc_id long, lon double, lat double, cell int")


def sets(spark, **kw):
    return {"DS1": Dataset(frame(dataset(spark, "x", **kw)), ["x"]), "DS2": Dataset(frame(dataset(spark, "y", scale=0.5)), ["y"]), "DS3": Dataset(frame(dataset(spark, "x", scale=1.0).withColumn("y", F.col("x") / 2)), ["x", "y"])}


def test_three_datasets_by_pairs(spark):
    v = Validation(sets(spark), "DS1", {(3, 2): calculators.pairwise("ref", "k1", calc_spearman=False)}, scaling="linreg")
    got = v.calc(spark, places(spark)).collect()
    assert len(got) == 5 * 4 and {r.combo for r in got} == {"DS1.x_with_DS2.y", "DS1.x_with_DS3.x", "DS1.x_with_DS3.y", "DS2.y_with_DS3.x", "DS2.y_with_DS3.y"}
    assert {(r.n_obs, r.status, round(r.R, 9)) for r in got} == {(1000, 0, 1.0)} and max(abs(r.BIAS) for r in got) < 1e-6
    some = v.calc(spark, places(spark), only_with_reference=True)
    assert some.select("combo").distinct().count() == 3


def test_masks_leave_the_rest(spark):
    masks = {f"m{n}": (Dataset(frame(dataset(spark, "x", n=n).withColumn("flag", F.lit(True))), ["flag"]), "flag") for n in (500, 750)}
    v = Validation(sets(spark), "DS1", {(3, 2): calculators.basic()}, scaling=None, masking_datasets=masks)
    assert {r.n_obs for r in v.calc(spark, places(spark)).collect()} == {250}


def test_status_codes(spark):
    data = sets(spark)
    data["DS2"] = Dataset(frame(dataset(spark, "y", locations=(1, 2)).unionByName(dataset(spark, "y", n=5, locations=(3,)))), ["y"])
    del data["DS3"]
    v = Validation(data, "DS1", {(2, 2): calculators.pairwise("ref", "k1", calc_spearman=False)}, scaling="mean_std")
    got = {r.loc_id: r.status for r in v.calc(spark, places(spark, (1, 2, 3, 4, 9))).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 7, 9: 7}
    data["DS2"] = Dataset(frame(dataset(spark, "y", start=5000)), ["y"])
    assert {r.status for r in Validation(data, "DS1", {(2, 2): calculators.basic()}, scaling=None).calc(spark, places(spark)).collect()} == {4}
    data["DS2"] = Dataset(frame(dataset(spark, "y").withColumn("y", F.lit(1.0))), ["y"])
    flat = Validation(data, "DS1", {(2, 2): calculators.basic()}, scaling="mean_std")
    assert {r.status for r in flat.calc(spark, places(spark)).collect()} == {5}
    with pytest.raises(ValidationError):
        flat.calc(spark, places(spark), handle_errors="raise")
    with pytest.raises(ValueError):
        Validation(data, "DS1", {(3, 2): calculators.basic()})


def test_missing_files_and_periods(spark, tmp_path):
    dataset(spark, "x", n=100).write.parquet(str(tmp_path / "x"))
    there = Dataset(files("parquet", str(tmp_path / "x")), ["x"])
    assert there.read(spark, ("2000-01-01", "2000-01-10")).count() == 40
    with pytest.warns(UserWarning, match="PATH_NOT_FOUND"):
        assert Dataset(files("parquet", str(tmp_path / "none")), ["x"]).read(spark) is None
    plan = there.read(spark, ("2000-01-01", "2000-01-10"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan
    with pytest.warns(UserWarning):
        v = Validation({"DS1": there, "DS2": Dataset(files("parquet", str(tmp_path / "none")), ["y"])}, "DS1", {(2, 2): calculators.basic()}, scaling=None)
        assert {r.status for r in v.calc(spark, places(spark)).collect()} == {7}


def test_spatial_lookup_within_distance(spark):
    ref = places(spark, (1, 2))
    other = spark.createDataFrame([(10, 1.1, 1.0), (11, 1.2, 1.0), (12, 5.0, 5.0)], "other_id long, lon double, lat double")
    got = {r.loc_id: r.other_id for r in spatial.nearest_lookup(ref, other, 25_000.0).collect()}
    assert got == {1: 10, 2: -1}
    line = spark.createDataFrame([(1, 179.99, 0.0), (2, 0.0, 89.99)], "loc_id long, lon double, lat double")
    far = spark.createDataFrame([(7, -179.99, 0.0), (8, 180.0, 89.99)], "other_id long, lon double, lat double")
    assert {r.loc_id: r.other_id for r in spatial.nearest_lookup(line, far, 5_000.0).collect()} == {1: 7, 2: 8}
    obs = dataset(spark, "x", n=10, locations=(10, 11, 12))
    placed = Dataset(frame(obs), ["x"], points=other, max_dist=25_000.0).read(spark, locations=ref)
    assert {(r.loc_id, r["count"]) for r in placed.groupBy("loc_id").count().collect()} == {(1, 10)}


def test_points_at_one_place_meet_once(spark, monkeypatch):
    """Copies of places add nothing to the spatial join, and every one of them counts in the results."""
    met, within = [], spatial._within
    monkeypatch.setattr(spatial, "_within", lambda a, b, d: met.append((a.count(), b.count())) or within(a, b, d))
    ref = spark.createDataFrame([(k, float(k % 2), 0.0) for k in range(40)], "loc_id long, lon double, lat double")
    other = spark.createDataFrame([(k, k % 3 + 0.1, 0.0, None if k % 2 else float(k)) for k in range(300)], "other_id long, lon double, lat double, v double")
    got = {r.loc_id: (r.other_id, round(r.distance)) for r in spatial.nearest_lookup(ref, other, 150_000.0).collect()}
    assert got == {k: (k % 2, 11_120) for k in range(40)}
    found = {r.loc_id: (r.n_obs, r.v) for r in spatial.resample_to_grid(other, ref, ["v"], 50_000.0).collect()}
    assert found == {k: (100, pytest.approx(sum(j for j in range(k % 2, 300, 3) if j % 2 == 0) / 50)) for k in range(40)}
    assert met == [(2, 3), (2, 3)]


def test_results_tables(spark, tmp_path):
    out = Results(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a_with_b", k, float(k), 1.0, 0.5 * k) for k in range(3)], "combo string, loc_id long, lon double, lat double, R double")
    out.add_metrics(rows, {"R": {"units": "1"}})
    out.add_metrics(rows.withColumn("lon", F.col("lon") + 10))
    got = out.read_locations("a_with_b").orderBy("idx").collect()
    assert [(r.idx, r.lon) for r in got] == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 10.0), (4, 11.0), (5, 12.0)]
    assert out.read_locations("a_with_b", [1, 4]).count() == 2 and out.index_of(11.0, 1.0, "a_with_b").first().idx == 4
    ts = spark.createDataFrame([("a_with_b", i, DAY + timedelta(days=k), float(k)) for i, n in ((0, 3), (1, 5)) for k in range(n)], "combo string, idx int, ts timestamp_ntz, R double")
    out.add_series(ts)
    assert [r.R for r in out.read_series(1, "a_with_b").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        out.add_series(ts.drop("ts"))
    day = ts.select(to_days(F.col("ts")).alias("d"), from_days(to_days(F.col("ts"))).alias("back"), "ts").first()
    assert day.d == 36524.0 and day.back == day.ts
    write_by_cell(rows, places(spark, (0, 1, 2)), str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).filter("cell = 4").count() == 3


def run_stream(spark, df, build, name, mode="append"):
    path = f"{os.environ.get('TMPDIR', '/tmp')}/spark-{name}-{time.time_ns()}"
    df.repartition(1).write.parquet(path)
    q = build(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streaming_filter_equals_batch(spark):
    from tidemark.operators import series

    df = spark.createDataFrame([(k % 2, DAY + timedelta(days=k), None if k % 7 == 3 else float(k * k % 11)) for k in range(60)], "loc_id long, ts timestamp_ntz, value double")
    got = run_stream(spark, df, lambda s: streams.exponential_filter(s, "value", 5), "filtered")
    want = {(r.loc_id, r.ts): r.value for r in series.exponential_filter(df, "value", 5).collect() if r.value is not None}
    have = {(r.loc_id, r.ts): r.value for r in got.collect()}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)


def test_streaming_means_and_join(spark):
    df = spark.createDataFrame([(1, DAY + timedelta(hours=6 * k), float(k), float(2 * k)) for k in range(120)], "loc_id long, ts timestamp, value double, other double")
    got = run_stream(spark, df, lambda s: streams.dekad_means(s, "value", "1 day"), "dekads", "complete")
    assert sorted((str(r.label), r.n) for r in got.collect()) == [("2000-01-10", 40), ("2000-01-20", 40), ("2000-01-31", 40)]
    met = run_stream(spark, df, lambda s: streams.nearest_join(s.select("loc_id", "ts", "value"), s.select("loc_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "other"), "other", "5 hours", "1 day"), "met")
    near = streams.nearest_of_candidates(met).collect()
    assert len(near) == 120 and all(r.distance_us == 3600 * 10**6 for r in near if r.distance_us > 0)


ENTRY = """
import importlib, json, sys
sys.modules["tidemark.llm"] = None  # as if the folder weren't there
class No:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidemark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
import importlib.util as u
real = u.find_spec
u.find_spec = lambda name, *a: None if name.startswith("tidemark.llm") or name == "corpus_pipeline" else real(name, *a)
import __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""


def test_entry_without_the_llm_folder():
    out = subprocess.run([sys.executable, "-c", ENTRY], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
    queries, sql = json.loads(out.stdout.splitlines()[-1])
    assert not any(n.startswith("op") or n == "pipeline" for n in queries) and len(queries) > 50 and set(sql) <= set(queries)
    for folder, _, names in os.walk(os.path.join(REPO, "tidemark")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert not re.search(r"\bllm\b", f.read()), n
