"""Sliding windows, matching without a limit and bundles of metrics: results by brute force, and what the plans cost."""

import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calculators, collocate, intervals, resampling, series

T0 = datetime(2000, 1, 1)


def rows(seed, n=300, days=400):
    rng = random.Random(seed)
    at = [T0 + timedelta(seconds=rng.randrange(days * 86400)) for _ in range(n)]
    at += at[:10]  # time stamps may repeat
    return [(k % 2, t, rng.choice([None, float("nan"), rng.gauss(5, 2), rng.gauss(5, 2)]), rng.gauss(3, 1)) for k, t in enumerate(at)]


def near(data, loc, t, low, high):
    return [r for r in data if r[0] == loc and low <= (r[1] - t) / timedelta(days=1) <= high]


def test_moving_average_by_brute_force(spark):
    data = rows(1)
    df = spark.createDataFrame([(*r[:3], k) for k, r in enumerate(data)], "loc_id int, ts timestamp_ntz, value double, k int")
    for days, fillna, least in ((9, False, 1), (30, True, 3), (0.5, True, 1)):
        got = {r.k: r.smooth for r in series.moving_average(df, "value", days, fillna, least, out="smooth").collect()}
        assert len(got) == len(data)
        for k, (loc, t, own, _) in enumerate(data):
            v = [r[2] for r in near(data, loc, t, -days / 2, days / 2) if r[2] is not None and not math.isnan(r[2])]
            missing = own is None or math.isnan(own)
            want = None if len(v) < least or not v or (missing and not fillna) else np.mean(v)
            assert got[k] is None if want is None else got[k] == pytest.approx(want, abs=1e-9)


def test_windowed_mean_by_brute_force(spark):
    data, other = rows(2), rows(3)
    ref = spark.createDataFrame([r[:2] for r in data], "loc_id int, ts timestamp_ntz").distinct()
    df = spark.createDataFrame([r[:3] for r in other], "loc_id int, ts timestamp_ntz, value double")
    got = {(r.loc_id, r.ts): r.value for r in collocate.windowed_mean(ref, df, ["value"], 4).collect()}
    assert len(got) == len({r[:2] for r in data})
    for (loc, t), value in got.items():
        v = [r[2] for r in near(other, loc, t, -4, 4) if r[2] is not None and not math.isnan(r[2])]
        assert value == pytest.approx(np.mean(v), abs=1e-9) if v else value is None


def test_rolling_agreement_by_brute_force(spark):
    data = [(0, T0 + timedelta(hours=7 * k), 4.0 if 100 <= k < 160 else math.sin(k) + 1000, math.cos(k * 1.1) * 3) for k in range(300)]
    df = spark.createDataFrame(data, "loc_id int, ts timestamp_ntz, x double, y double")
    got = {r.ts: r for r in series.rolling_agreement(df, "x", "y", 5, with_p=False).collect()}
    constant = 0
    for loc, t, _, _ in data:
        part = near(data, loc, t, -5, 5)
        x, y = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        assert got[t].n_obs == len(part) and got[t].RMSD == pytest.approx(np.sqrt(np.mean((x - y) ** 2)), rel=1e-9)
        if x.std() == 0:
            constant += 1
            assert got[t].R is None
        else:
            assert got[t].R == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert constant > 10


@pytest.mark.parametrize("center", [True, False])
def test_an_outlier_leaves_no_trace(spark, center):
    """Windows that don't hold the outlier are as if it weren't there, and those that do are right as well."""
    rng = random.Random(9)
    for size in (1e6, 1e8, 1e10):
        data = [(0, T0 + timedelta(hours=24 * k + rng.randrange(20)), size if k == 30 else rng.gauss(0, 0.2), rng.gauss(0.1, 0.2)) for k in range(200)]
        df = spark.createDataFrame(data, "loc_id int, ts timestamp_ntz, x double, y double")
        got = {r.ts: r for r in series.rolling_agreement(df, "x", "y", 10, center, with_p=False).collect()}
        smooth = {r.ts: r.x for r in series.moving_average(df, "x", 20).collect()}
        assert len(got) == len(data)
        for loc, t, _, _ in data:
            part = near(data, loc, t, -10, 10) if center else [r for r in near(data, loc, t, -10, 0) if t - r[1] < timedelta(days=10)]
            x, y = np.array([r[2] for r in part]), np.array([r[3] for r in part])
            assert got[t].n_obs == len(part)
            assert got[t].RMSD == (pytest.approx(np.sqrt(np.mean((x - y) ** 2)), rel=1e-9) if len(part) > 1 else None)
            if len(part) > 1:
                assert got[t].R == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
            assert smooth[t] == pytest.approx(np.mean([r[2] for r in near(data, loc, t, -10, 10)]), rel=1e-9)


def test_windows_of_one_block_and_of_equal_times(spark):
    """Windows that are exactly a block, a microsecond long, or full of one time stamp."""
    data = [(0, T0 + timedelta(days=k // 3), float(k), float(k * k % 7)) for k in range(60)]
    df = spark.createDataFrame(data, "loc_id int, ts timestamp_ntz, x double, y double")
    for days in (1, 1 / 86400 / 1e6, 3):
        for r in series.rolling_agreement(df, "x", "y", days, False, with_p=False).collect():
            part = [p for p in data if timedelta(0) <= r.ts - p[1] < timedelta(days=days)] or [p for p in data if p[1] == r.ts]
            assert r.n_obs == len(part) and r.R == pytest.approx(np.corrcoef([p[2] for p in part], [p[3] for p in part])[0, 1], abs=1e-9)


def test_no_exchange_but_that_by_stretch(spark):
    df = spark.createDataFrame(rows(4), "loc_id int, ts timestamp_ntz, x double, y double")
    plan = series.rolling_agreement(df, "x", "y", 10, with_p=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_cost_does_not_grow_with_the_window(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("loc_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 10).cast("double").alias("value"), F.sin("id").alias("y"))
    began = time.perf_counter()
    got = series.moving_average(df, "value", 365, out="smooth").agg(F.count("smooth"), F.min("smooth"), F.max("smooth")).first()
    assert got[0] == n and got[1] == pytest.approx(4.5, abs=1e-9) == got[2]  # all rows are in each window
    assert series.rolling_agreement(df, "value", "y", 365, with_p=False).agg(F.max("n_obs")).first()[0] == n
    assert time.perf_counter() - began < 120  # 10^10 additions otherwise


def test_unlimited_nearest_over_many_stretches(spark):
    rng = random.Random(4)
    ref = [(k % 2, T0 + timedelta(days=rng.randrange(3000), seconds=rng.randrange(86400))) for k in range(60)]
    other = [(k % 2, T0 + timedelta(days=rng.choice([10, 900, 2500]), seconds=rng.randrange(86400)), float(k)) for k in range(12)] + [(0, T0 + timedelta(days=5000), 99.0)]
    a, b = spark.createDataFrame(ref, "loc_id int, ts timestamp_ntz"), spark.createDataFrame(other, "loc_id int, ts timestamp_ntz, v double")
    for r in collocate.unlimited_nearest(a, b, ["v"]).collect():
        gaps = {abs(t - r.ts): v for loc, t, v in other if loc == r.loc_id}
        assert r.v == gaps[min(gaps)]
    assert collocate.unlimited_nearest(a, b.limit(0), ["v"]).filter("v is null").count() == len(ref)


def test_metrics_and_intervals_share_one_exchange(spark):
    df = spark.createDataFrame([(k % 3, float(k), k * 1.5 + k % 7) for k in range(90)], "loc_id int, x double, y double")
    one = calculators.pairwise("x", "y", calc_spearman=False)(df, ["loc_id"])
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for name, metric in (("BIAS", "bias"), ("urmsd", "ubrmsd"), ("R", "pearson_r")):
        alone = {r.loc_id: (r[metric], r.lower, r.upper) for r in intervals.analytical(df, "x", "y", metric).collect()}
        assert {r.loc_id: pytest.approx((r[name], r[f"{name}_ci_lower"], r[f"{name}_ci_upper"])) for r in one.collect()} == alone


def test_one_resampling_gives_all_intervals(spark):
    df = spark.createDataFrame([(k % 2, float(k % 17), float(k % 13)) for k in range(240)], "loc_id int, x double, y double")
    kw = {"nsamples": 50, "seed": 3}
    both = {r.loc_id: r for r in intervals.bootstrapped_many(df, "x", "y", {"a": "rmsd", "b": "bias"}, **kw).collect()}
    for name, metric in (("a", "rmsd"), ("b", "bias")):
        for r in intervals.bootstrapped(df, "x", "y", metric, **kw).collect():
            assert (r.value, r.lower, r.upper) == tuple(both[r.loc_id][f"{name}{end}"] for end in ("", "_lower", "_upper"))
            assert r.lower <= r.value <= r.upper


def test_resampling_by_sums_equals_resampling_by_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(1000, 3, 150)
    y = x + rng.normal(2, 1, 150)
    names = list(intervals.SAMPLED)
    got = intervals.resampled(x, y, names, np.random.default_rng(5), 40)
    want = intervals.resampled(x, y, [intervals.SAMPLED[m] for m in names], np.random.default_rng(5), 40)
    assert got.shape == want.shape == (len(names), 40) and np.allclose(got, want, rtol=1e-8, atol=1e-9)
    for name in names:
        assert np.allclose(intervals.left_out(x, y, name), intervals.left_out(x, y, intervals.SAMPLED[name]), rtol=1e-8, atol=1e-9)
    flat = np.full(150, 7.25)
    assert np.isnan(intervals.resampled(flat, y, ["pearson_r"], np.random.default_rng(5), 10)).all() and (intervals.OF_SUMS["mse_var"](intervals.Sums(intervals._products(flat, flat).sum(axis=1))) == 0).all()


def test_draws_are_split_without_loss():
    """Every replicate's draws add up to n, follow the buckets' sizes, and are the same whoever asks."""
    sizes = np.array([5, 0, 40, 1, 300, 54, 100])
    got = resampling.split_draws(sizes, 500, 4000, 7, ("a", 1))
    assert (got.sum(axis=0) == 500).all() and (got[1] == 0).all() and (got >= 0).all()
    p = sizes / 500
    assert got.mean(axis=1) == pytest.approx(500 * p, abs=0.6) and got.var(axis=1) == pytest.approx(500 * p * (1 - p), rel=0.1, abs=0.1)
    assert (resampling.split_draws(sizes, 500, 4000, 7, ("a", 1)) == got).all() and (resampling.split_draws(sizes, 500, 4000, 8, ("a", 1)) != got).any()


@pytest.mark.parametrize("bucket", [200_000, 40])
def test_split_resampling_by_plain_resampling(spark, monkeypatch, bucket):
    """A key in one bucket or in many, with ties and an outlying mean: intervals are those of plain resampling but for chance."""
    monkeypatch.setattr(resampling, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 2, 400).round(1)
    y = x + rng.normal(1, 1, 400).round(2)
    x[:100], y[:100] = x[0], y[0]  # copies of one row
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 1.0, 2.0)] * 50, "loc_id int, x double, y double").repartition(6)
    names = {m: m for m in ("bias", "rmsd", "ubrmsd", "pearson_r", "mse_corr")}
    for method in ("percentile", "basic", "BCa"):
        got = {r.loc_id: r for r in intervals.bootstrapped_many(df, "x", "y", names, method=method, nsamples=1500).collect()}
        again = {r.loc_id: r for r in intervals.bootstrapped_many(df.repartition(3), "x", "y", names, method=method, nsamples=1500).collect()}
        assert got[2].n_obs == 50 and got[2].bias == -1 and got[2].bias_lower is None
        for m in names:
            value, low, high = (got[1][f"{m}{end}"] for end in ("", "_lower", "_upper"))
            samples = intervals.resampled(x, y, [m], np.random.default_rng(8), 1500)[0]
            a = intervals.acceleration(intervals.left_out(x, y, m))
            plain = intervals.interval_of(samples, float(intervals.SAMPLED[m](x, y)), 0.05, method, a)
            assert value == pytest.approx(intervals.SAMPLED[m](x, y), rel=1e-6)
            assert (low, high) == pytest.approx(plain, abs=0.25 * (plain[1] - plain[0]))
            assert (low, high) == pytest.approx((again[1][f"{m}_lower"], again[1][f"{m}_upper"]), rel=1e-9)


def test_split_triple_resampling(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET_ROWS", 60)
    rng = np.random.default_rng(2)
    truth = rng.normal(size=300)
    data = np.stack([truth + rng.normal(0, s, 300) for s in (0.2, 0.5, 0.3)], axis=1)
    df = spark.createDataFrame([(1, *map(float, r)) for r in data], "loc_id int, a double, b double, c double")
    got = {(r.dataset, r.metric): r for r in intervals.bootstrapped_triple(df, ["a", "b", "c"], nsamples=600).collect()}
    samples = []
    for _ in range(600):
        samples.append(intervals.triple_of_covariances(np.cov(data[rng.integers(0, 300, 300)].T)[:, :, None])[:, :, 0])
    want = intervals.triple_of_covariances(np.cov(data.T)[:, :, None])[:, :, 0]
    for i, d in enumerate("abc"):
        for m, name in enumerate(("snr", "err_std", "beta")):
            r = got[d, name]
            low, high = np.nanquantile([s[m, i] for s in samples], [0.025, 0.975])
            assert r.n_obs == 300 and r.value == pytest.approx(want[m, i])
            assert (r.lower, r.upper) == pytest.approx((low, high), abs=0.25 * (high - low))


@pytest.mark.parametrize("weight", ([1] * 6, [3, 1, 2, 1, 1, 1], [9, 1, 40, 2, 7, 1]))
def test_draws_are_multinomial(weight):
    """Whether rows are drawn one by one or by binomials: so many draws for each replicate, in proportion to the weights."""
    w, wanted = np.array(weight), np.array([30, 0, 200] * 2000)
    got = resampling._draws(np.random.default_rng(3), wanted, w)
    assert (got.sum(axis=1) == wanted).all() and (got == resampling._draws(np.random.default_rng(3), wanted, w)).all()
    share, many = w / w.sum(), got[2::3]
    assert many.mean(axis=0) == pytest.approx(200 * share, rel=0.05) and many.var(axis=0) == pytest.approx(200 * share * (1 - share), rel=0.15)
