import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import adapters, calculators, collocate, scaling, series, splits, triple, upscale
from tidemark.plans import combos

DAY = datetime(2007, 1, 1)


def stamps(spark, rows, columns="ts timestamp_ntz, value double"):
    return spark.createDataFrame([(1, *r) for r in rows], "loc_id long, " + columns)


def daily(spark, values, start=DAY, step=timedelta(days=1)):
    return stamps(spark, [(start + k * step, None if v is None else float(v)) for k, v in enumerate(values)])


def values(df, name="value"):
    return [r[name] for r in df.orderBy("ts").collect()]


# ---- collocation ----


@pytest.fixture(scope="module")
def border(spark):
    ref = daily(spark, range(5)).withColumnRenamed("value", "data")
    hours = [(0, 9), (1, 9), (3, 9), (4, 9)]
    other = stamps(spark, [(DAY + timedelta(days=d, hours=h), float(k)) for k, (d, h) in enumerate(hours)])
    return ref, other


def test_unlimited_nearest_golden(border):
    got = collocate.unlimited_nearest(*border, ["value"]).orderBy("ts").collect()
    assert [r.distance for r in got] == [0.375, 0.375, -0.625, 0.375, 0.375] and [r.value for r in got] == [0, 1, 1, 2, 3]


def test_asymmetric_windows_golden(spark, border):
    ref, _ = border
    other = stamps(spark, [(DAY + timedelta(days=d, hours=h), float(k)) for k, (d, h) in enumerate([(0, 9), (1, 9), (2, 12), (4, 9)])])
    assert values(collocate.unlimited_nearest(ref, other, ["value"], 0.5, "<=")) == [0, 1, 2, None, 3]
    assert values(collocate.unlimited_nearest(ref, other, ["value"], 0.5, ">=")) == [0, 1, None, 2, 3]


def test_nearest_window_is_inclusive_and_ties_go_later(spark):
    ref = stamps(spark, [(DAY, 0.0)]).drop("value")
    other = stamps(spark, [(DAY - timedelta(hours=6), 1.0), (DAY + timedelta(hours=6), 2.0)])
    assert values(collocate.nearest(ref, collocate.Other(other, ["value"]), timedelta(hours=6))) == [2.0]
    assert values(collocate.nearest(ref, collocate.Other(other, ["value"]), timedelta(hours=5, minutes=59))) == [None]


def test_shifted_series_match_or_not(spark):
    ref = daily(spark, range(400)).drop("value")
    for hours, hit in ((3, True), (7, False), (-5, True)):
        other = daily(spark, range(400), DAY + timedelta(hours=hours))
        got = values(collocate.nearest(ref, collocate.Other(other, ["value"]), timedelta(hours=6)))
        assert got == [float(k) if hit else None for k in range(400)]


def test_duplicates_nulls_and_empty(spark):
    ref = stamps(spark, [(DAY, 1.0), (DAY, 2.0)]).withColumnRenamed("value", "r")
    other = stamps(spark, [(DAY, 5.0), (DAY, 4.0), (DAY + timedelta(hours=1), None)])
    got = collocate.nearest(ref, collocate.Other(other, ["value"]), 0.1).collect()
    assert [(r.r, r.value) for r in got] == [(1.0, 4.0)]
    at = stamps(spark, [(DAY + timedelta(hours=1), 1.0)]).withColumnRenamed("value", "r")
    assert values(collocate.nearest(at, collocate.Other(other, ["value"]), 0.1)) == [None]  # a row matches even if its value is null
    assert collocate.nearest(ref.limit(0), collocate.Other(other, ["value"]), 0.1).count() == 0
    assert values(collocate.nearest(ref, collocate.Other(other.limit(0), ["value"]), 0.1)) == [None]


def test_resample_mean_golden(spark):
    other = daily(spark, range(10))
    ref = stamps(spark, [(DAY + timedelta(days=d), 0.0) for d in (3, 7, 10, 12)]).drop("value")
    assert values(collocate.resample_mean(ref, other, ["value"], timedelta(days=3))) == [3, 7, 9, None]


def test_windowed_mean_of_every_third_day(spark):
    other = daily(spark, range(300))
    ref = stamps(spark, [(DAY + timedelta(days=d), 0.0) for d in range(0, 298, 3)]).drop("value")
    assert values(collocate.windowed_mean(ref, other, ["value"], 1.5)) == [0.5 if d == 0 else float(d) for d in range(0, 298, 3)]


def test_plan_has_one_shuffle_of_the_rows_and_no_cross_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("loc_id"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(DAY).cast("timestamp_ntz")).alias("ts"), F.rand(1).alias("value"))
    plan = collocate.nearest(big, collocate.Other(big, ["value"], "o_"), 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert plan.count("Exchange ") == 1


# ---- series ----


def test_boxcar_golden(spark):
    nan = None
    df = daily(spark, [1, 2, 3, 4, -999999, 6, 7, 8, 9, float("nan")])
    assert values(series.moving_average(df, "value", 5)) == [2, 2.5, 2.5, 3.75, nan, 6.25, 7.5, 7.5, 8, nan]
    gaps = daily(spark, [1, 2, 3, 4, nan, nan, 8, 9, 10, nan, nan, nan])
    assert values(series.moving_average(gaps, "value", 5, fillna=True)) == [2, 2.5, 2.5, 3, 5, 7, 9, 9, 9, 9.5, 10, nan]
    assert values(series.moving_average(gaps, "value", 5, fillna=True, min_obs=3)) == [2, 2.5, 2.5, 3, 5, 7, 9, 9, 9, nan, nan, nan]


def test_exponential_filter_golden(spark):
    df = daily(spark, [0.5, 2, 3, 4, -999999, 6, 7, 8, 9, float("nan")])
    want = [0.5, 1.324751, 1.997798, 2.656881, None, 3.757916, 4.687961, 5.547327, 6.378209, None]
    got = values(series.exponential_filter(df, "value", 5))
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-5)


def test_exponential_filter_over_many_stretches(spark):
    rng = np.random.default_rng(0)
    days = np.cumsum(rng.choice([1, 2, 300, 700], 200, p=[0.6, 0.3, 0.08, 0.02]))
    x = rng.normal(size=200)
    df = stamps(spark, [(DAY + timedelta(days=int(d)), float(v)) for d, v in zip(days, x, strict=True)])
    gain, y, want = 1.0, x[0], [x[0]]
    for k in range(1, 200):
        gain = gain / (gain + math.exp(-(days[k] - days[k - 1]) / 1.5))
        y += gain * (x[k] - y)
        want.append(y)
    assert values(series.exponential_filter(df, "value", 1.5)) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_anomalies_golden(spark):
    got = values(series.anomaly(daily(spark, range(20), datetime(2005, 1, 1)), "value"))
    assert (got[0], got[4]) == (-8.5, -5.5)


def test_climatology_slots_and_fill(spark):
    df = daily(spark, range(800), datetime(2000, 1, 1))
    assert series.climatology(df, "value").count() == 366
    assert series.climatology(df, "value", output_freq="month").count() == 12
    short = daily(spark, range(20), datetime(2000, 1, 1))
    got = {r.slot: r.climatology for r in series.climatology(short, "value", moving_avg_orig=None, moving_avg_clim=1, fill=-1, wraparound=False).collect()}
    assert got[32] == -1 and got[20] == 19
    with pytest.raises(ValueError):
        series.climatology(df, "value", output_freq="week")


def test_rolling_agreement_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=80), rng.normal(size=80)
    df = spark.createDataFrame([(1, DAY + timedelta(days=k), float(x[k]), float(y[k])) for k in range(80)], "loc_id long, ts timestamp_ntz, x double, y double")
    for center in (True, False):
        got = series.rolling_agreement(df, "x", "y", 10, center, 4).orderBy("ts").collect()
        for k, r in enumerate(got):
            i = range(max(0, k - 10), min(80, k + 11)) if center else range(max(0, k - 9), k + 1)
            a, b = x[list(i)], y[list(i)]
            assert r.n_obs == len(a)
            if len(a) < 4:
                assert r.R is None and r.RMSD is None and r.p_R is None
            else:
                assert r.R == pytest.approx(np.corrcoef(a, b)[0, 1]) and r.RMSD == pytest.approx(math.sqrt(((a - b) ** 2).mean()))


# ---- adapters ----


def test_advanced_mask_golden(spark):
    df = spark.createDataFrame([(1, DAY + timedelta(days=k), k) for k in range(20)], "loc_id long, ts timestamp_ntz, x int")
    got = adapters.keep_where(df, [("x", ">=", 5), ("x", "<", 15), ("x", lambda c, t: c.bitwiseAND(t) == t, 1)])
    assert values(got, "x") == [5, 7, 9, 11, 13]
    with pytest.raises(ValueError):
        adapters.keep_where(df, [("x", "<>", 5)])
    nulls = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "k int, f double")
    assert [r.k for r in adapters.keep_where(nulls, [("f", "<", 5)]).collect()] == [1]
    assert sorted(r.k for r in adapters.keep_where(nulls, [("f", "<", 5)], ignore_nans=True).collect()) == [1, 2, 3]
    assert [r.f for r in adapters.mask_frame(nulls, "<", 5, ["f"]).orderBy("k").collect()] == [True, False, False]


def test_exact_time(spark):
    rows = [(1, DAY, 3600.0, 2.0), (2, DAY, None, float("nan")), (3, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, s double, h double")
    got = adapters.exact_time(df, ["s", "h"], ["s", "h"]).orderBy("k")
    assert got.columns == ["k", "ts"] and [r.ts for r in got.collect()] == [DAY + timedelta(hours=3), DAY]
    days = spark.createDataFrame([(1, 10.9, 60.0)], "k int, d double, m double")
    got = adapters.exact_time(days, ["m"], ["m"], "d", "2000-01-01", output_field="t").first()
    assert got.t == datetime(2000, 1, 11, 1)


def test_yearless_ranges_golden(spark):
    days = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2000-01-01 12:00:00', timestamp_ntz'2009-12-31 12:00:00', interval 1 day)")).alias("ts")).select(F.lit(1).alias("loc_id"), "ts")
    days = days.filter(F.month("ts") != 7)
    winter = (cal.Yearless(12, 20), cal.Yearless(2, 10))
    leap = (cal.Yearless(2, 27), cal.Yearless(2, 29, 12))
    n = 10
    assert adapters.Distributor(yearless_ranges=[winter, leap]).select(days.filter(F.month("ts") != 1)).count() == 12 * n + 9 * (n - 1) + (3 * n - 7)


def test_masks_drop_true_only(spark):
    df = daily(spark, range(10))
    mask = stamps(spark, [(DAY + timedelta(days=k), k < 4) for k in range(8)], "ts timestamp_ntz, flag boolean")
    assert values(adapters.drop_masked(df, {"m": (mask, "flag")}, 0.1)) == [4, 5, 6, 7, 8, 9]


# ---- scaling ----


def fit_cdf(x, y, p, minobs=None, edges=False):
    """The plain way, from whole arrays of complete cases: percentiles of sorted values, untied, and lines at the ends."""
    ones = np.ones(len(x), np.int64)
    p = np.asarray(p, float)
    if minobs and len(x) * np.diff(p).min() / 100 < minobs:
        p = np.linspace(0, 100, min(max(1, len(x) // minobs), len(p) - 1) + 1)
    if len(p) == 2 and edges:
        b = np.cov(x, y, bias=True)[0, 1] / np.var(x)
        return np.array([0.0, 1.0]), np.array([y.mean() - b * x.mean(), y.mean() - b * x.mean() + b])
    sx, sy = np.sort(x), np.sort(y)
    px, py = (scaling.untied(np.interp(p / 100 * len(v) - 0.5, np.arange(len(v)), v), p) for v in (sx, sy))

    def slope(u, v):
        if len(u) != len(v):
            q = np.linspace(0, 100, len(v)) if len(v) > 1 else np.array([0.0])
            u = scaling.untied(np.interp(q / 100 * len(u) - 0.5, np.arange(len(u)), u), q)
        return float(u @ v) / float(u @ u) if u @ u else 0.0

    if edges and len(p) > 2:
        py = py.copy()
        py[0] = py[1] + slope(sx[sx <= px[1]] - px[1], sy[sy <= py[1]] - py[1]) * (px[0] - px[1])
        py[-1] = py[-2] + slope(sx[sx >= px[-2]] - px[-2], sy[sy >= py[-2]] - py[-2]) * (px[-1] - px[-2])
    return px, py


def test_percentiles_golden(spark):
    v = np.array([1, 1, 1, 2, 2, 2, 5, 5, 6, 10, 10, 10, 10.0])
    p = np.array([0, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100.0])
    h = scaling.hazen(v, np.ones(13, int), p)
    assert h == pytest.approx([1, 1, 1, 1.1, 2, 2, 5, 5.3, 8.4, 10, 10, 10, 10])
    assert scaling.hazen(np.array([1, 2, 5, 6, 10.0]), np.array([3, 3, 2, 1, 4]), p) == pytest.approx(h)
    assert scaling.untied(h, p) == pytest.approx([1, 1.025, 1.05, 1.1, 2, 3.5, 5, 5.3, 8.4, 8.9333, 9.4667, 9.7333, 10], abs=1e-4)
    df = spark.range(1).select(F.lit(100).alias("n"))
    assert df.select(scaling.bins_for(F.col("n"), 100, None, 20)).first()[0] == [0, 20, 40, 60, 80, 100]


@pytest.mark.parametrize("task_rows", [1_000_000, 40])
@pytest.mark.parametrize("edges", [False, True])
def test_cdf_parameters_by_whole_arrays(spark, monkeypatch, task_rows, edges):
    """Locations with ties, heavy ties, few values and none, whether or not they're split over tasks."""
    monkeypatch.setattr(splits, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(4)
    data = {0: (rng.normal(size=500), rng.normal(3, 2, 500)), 1: (rng.integers(0, 12, 400) * 1.0, rng.normal(size=400)), 2: (np.where(rng.random(600) < 0.4, 0.0, rng.exponential(size=600)), rng.integers(0, 30, 600) * 0.5), 3: (rng.normal(size=30), rng.normal(size=30)), 4: (rng.normal(size=7), rng.normal(size=7)), 5: (np.ones(50), rng.normal(size=50))}
    rows = [(k, float(a), float(b)) for k, (x, y) in data.items() for a, b in zip(x, y, strict=True)] + [(0, None, 5.0), (0, 9.0, math.nan), (6, None, 1.0)]
    df = spark.createDataFrame(rows, "loc_id int, x double, y double").repartition(5)
    for p, minobs in ((np.linspace(0, 100, 21), 20), (scaling.PERCENTILES, None)):
        got = {r.loc_id: r for r in scaling.cdf_parameters(df, "x", "y", percentiles=list(p), minobs=minobs, linear_edge_scaling=edges).collect()}
        assert set(got) == set(range(7)) and got[6].x_perc == got[6].y_perc == []
        for k, (x, y) in data.items():
            px, py = fit_cdf(x, y, p, minobs, edges)
            assert got[k].x_perc == pytest.approx(px, rel=1e-9, abs=1e-12) and got[k].y_perc == pytest.approx(py, rel=1e-9, abs=1e-12), k
    plan = scaling.cdf_parameters(df, "x", "y", linear_edge_scaling=edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "Cross" not in plan


def test_cdf_keys_are_whole_in_a_task(spark, monkeypatch):
    """Many keys are one call, without a sort by value or a call for each; what comes out is what split keys give."""
    rng = np.random.default_rng(5)
    data = {0: (rng.integers(0, 9, 300) * 1.0, rng.normal(size=300)), 1: ([0.1] * 7, [1.0, 2, 3, 4, 5, 6, 7]), 2: ([1.0], [2.0]), 3: ([math.nan, 4.0], [1.0, None]), 4: (rng.normal(size=45), np.ones(45)), 5: (rng.normal(size=25), rng.normal(size=25)), None: ([1.0, 2.0], [3.0, 5.0])}
    rows = [(k, None if a is None else float(a), None if b is None else float(b)) for k, (x, y) in data.items() for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (5, 30.0, None), (5, None, 30.0), (4, 0.5, math.inf)], "loc_id int, x double, y double")

    def found(combine: bool) -> tuple[dict, str]:
        got = scaling.cdf_parameters(df, "x", "y", minobs=20, combine_invalid=combine, linear_edge_scaling=True)
        return {r.loc_id: (r.x_perc, r.y_perc) for r in got.collect()}, got._jdf.queryExecution().optimizedPlan().toString()

    for combine in (True, False):
        whole, plan = found(combine)
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Window" not in plan
        assert set(whole) == {*range(6), None} and whole[None] == ([], []) and len(whole[3][0]) == (0 if combine else 2)
        monkeypatch.setattr(splits, "TASK_ROWS", 6)
        split, plan = found(combine)
        monkeypatch.setattr(splits, "TASK_ROWS", 1_000_000)
        assert "MapInArrow" in plan and "FlatMapGroups" in plan and set(split) == set(whole)
        for k, both in whole.items():
            assert all(a == pytest.approx(b, rel=1e-9, abs=1e-12, nan_ok=True) for a, b in zip(both, split[k], strict=True)), k
    many = spark.range(1, 3000, 7).select(F.col("id").cast("int").alias("n"))
    for given, minobs in ((100, 20), (100, None), (7, 3)):
        for r in many.select("n", scaling.bins_for(F.col("n"), given, None, minobs).alias("p")).collect():
            assert r.p == scaling.bins_of(r.n, np.linspace(0, 100, given + 1), minobs).tolist()


def test_values_are_carried_over_between_any_number_of_edges(spark):
    """On edges, between them and beyond both ends; a key's edges may be as few as two, and are nothing to another's."""
    rng = np.random.default_rng(6)
    edges = {k: (np.cumsum(rng.random(k) + 0.1), rng.normal(size=k)) for k in (2, 3, 4, 7, 8, 9, 63, 64, 65, 130)}
    params = spark.createDataFrame([*((k, x.tolist(), y.tolist()) for k, (x, y) in edges.items()), (1, [1.0], [1.0]), (0, [], []), (5, [1.0, 1.0, 2.0], [1.0, 2.0, 3.0])], "loc_id int, x_perc array<double>, y_perc array<double>")
    at = [(k, float(v)) for k, (x, _) in edges.items() for v in [*x, *(x[1:] - 0.05), x[0] - 3, x[-1] + 3]]
    df = spark.createDataFrame([*at, *((k, v) for k in (0, 1, 5, 99) for v in (1.0, None)), (2, math.nan)], "loc_id int, x double")
    for most in (None, 130):
        plan = scaling.apply_parameters(df, params, "x", out="z", most=most)
        assert len(plan.filter("z is not null")._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # a filter doesn't multiply it
        got = plan.collect()
        assert len(got) == len(at) + 9
        for r in got:
            if r.loc_id in edges and not math.isnan(r.x):
                x, y = edges[r.loc_id]
                assert r.z == pytest.approx(scaling.line(x, y, np.array([r.x]))[0], rel=1e-9, abs=1e-12)
            else:
                assert r.z is None


def test_cdf_of_separate_series(spark):
    """Without combining, each column counts its own values; with one bin the line is a regression of complete cases."""
    df = spark.createDataFrame([(1, float(k), None) for k in range(10)] + [(1, None, float(k)) for k in range(20)], "loc_id int, x double, y double")
    got = scaling.cdf_parameters(df, "x", "y", combine_invalid=False, percentiles=[0, 50, 100]).first()
    assert got.x_perc == pytest.approx([0, 4.5, 9]) and got.y_perc == pytest.approx([0, 9.5, 19])
    one = spark.createDataFrame([(1, float(k), 2.0 * k + 1) for k in range(9)], "loc_id int, x double, y double")
    got = scaling.cdf_parameters(one, "x", "y", nbins=5, minobs=20, linear_edge_scaling=True).first()
    assert got.x_perc == [0, 1] and got.y_perc == pytest.approx([1, 3])


def test_cdf_parameters_golden(spark):
    df = spark.createDataFrame([(1, k, float(k), k / 2) for k in range(1000)], "loc_id long, i int, x double, y double")
    got = scaling.cdf_parameters(df, "y", "x", percentiles=list(scaling.PERCENTILES)).first()
    assert got.x_perc == pytest.approx([0, 24.75, 49.75, 149.75, 249.75, 349.75, 449.75, 474.75, 499.5])
    assert got.y_perc == pytest.approx([0, 49.5, 99.5, 299.5, 499.5, 699.5, 899.5, 949.5, 999])


def test_every_method_scales_to_the_reference(spark):
    df = spark.createDataFrame([(1, k, float(k), k / 2) for k in range(1000)], "loc_id long, i int, x double, y double")
    for method in ("min_max", "mean_std", "linreg", "cdf_match", "cdf_beta_match"):
        got = [r.y for r in scaling.scaled(df, "y", "x", method).orderBy("i").collect()]
        assert got == pytest.approx([float(k) for k in range(1000)], abs=0.6), method
    assert "y_scaled_linreg" in scaling.add_scaled(df, "y", "x").columns
    with pytest.raises(KeyError):
        scaling.scaled(df, "y", "x", "nothing")
    got = scaling.scaled(df.withColumn("y", F.lit(1.0)), "y", "x", "mean_std").first()
    assert got.y is None


def test_cdf_edges_golden(spark):
    df = spark.createDataFrame([(1, k, float(k), -9.0 if k == 0 else float(k)) for k in range(1000)], "loc_id long, i int, x double, ref double")
    nine = list(scaling.PERCENTILES)

    def first(**kw):
        return scaling.cdf_match(df, "x", "ref", percentiles=nine, minobs=None, **kw).filter("i = 0").first().x

    assert first(linear_edge_scaling=False) == pytest.approx(-9)
    assert -2.5 < first(linear_edge_scaling=True) < 0
    assert scaling.cdf_match(df.withColumn("x", F.lit(1.0)), "x", "ref").filter("x is not null").count() == 0


def test_stored_parameters_are_fitted_once(spark, tmp_path):
    df = spark.createDataFrame([(k % 2, k, float(k), k / 2) for k in range(400)], "loc_id long, i int, x double, y double")
    store = scaling.StoredCdf(spark, str(tmp_path / "cdf"))
    first = store.scale(df.filter("loc_id = 0"), "y", "x").count()
    both = store.scale(df, "y", "x").orderBy("i").collect()
    assert first == 200 and spark.read.parquet(str(tmp_path / "cdf")).count() == 2
    assert [r.y for r in both] == pytest.approx([float(k) for k in range(400)], abs=1.5)


# ---- triples ----


def test_triple_collocation_recovers_errors(spark):
    rng = np.random.default_rng(3)
    n = 200_000
    signal = rng.normal(0.3, 0.2, n)
    x, y, z = signal + rng.normal(0, 0.02, n), 0.2 + 0.9 * signal + rng.normal(0, 0.07, n), 0.5 + 1.6 * signal + rng.normal(0, 0.04, n)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"loc_id": 1, "x": x, "y": y, "z": z}))
    got = {r.dataset: r for r in triple.triple_collocation(df, ["x", "y", "z"]).collect()}
    assert [got[c].beta for c in "xyz"] == pytest.approx([1, 1 / 0.9, 1 / 1.6], abs=0.01)
    assert [got[c].err_std for c in "xyz"] == pytest.approx([0.02, 0.07 / 0.9, 0.04 / 1.6], abs=0.005)
    e = triple.extended_collocation(df, ["x", "y", "z"]).first()
    assert [e[f"err_{c}"] for c in "xyz"] == pytest.approx([0.02**2, 0.07**2, 0.04**2], abs=3e-4)
    assert e.snr_x == pytest.approx(10 * math.log10(0.04 / 0.0004), abs=1)


def test_seasonal_triple_exchanges_rows_once(spark, monkeypatch):
    """Rows are exchanged once and nothing is written; what comes out is what keys give that are split over tasks."""
    rng = np.random.default_rng(8)
    odd = [None, math.nan, math.inf, -math.inf]
    rows = []
    for key, n in ((1, 150), (2, 40), (3, 5), (4, 1), (5, 30), (6, 3)):
        for k in range(n):
            x, y, z = float(rng.integers(0, 6)), float(rng.normal()), float(rng.integers(0, 4)) / 8 - 0.0
            if key == 2 and k % 3 == 0:
                x, y, z = (odd[rng.integers(0, 4)] if rng.random() < 0.4 else v for v in (x, y, z))
            rows.append((key, DAY + timedelta(days=int(rng.integers(0, 900))), x, 4.5 if key == 5 else math.inf if key == 6 else y, z))
    schema = "loc_id int, ts timestamp_ntz, x double, y double, z double"
    run = calculators.seasonal_triple(["x", "y", "z"], "y")

    def found(data):
        return {(r.loc_id, r.subset, r.dataset, r.pair): r for r in run(spark.createDataFrame(data, schema), ["loc_id"]).collect()}

    with monkeypatch.context() as m:
        m.setattr(splits, "kept", lambda df: pytest.fail("rows are written"))
        plan = run(spark.createDataFrame(rows, schema), ["loc_id"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and plan.count(" Sort ") == 3 and "Join" not in plan
        whole = found([*rows, *((None, *r[1:]) for r in rows if r[0] == 1)])
    same = [k for k in whole if k[0] is None]
    assert len(same) == 30 and all(tuple(whole.pop(k))[1:] == tuple(whole[(1, *k[1:])])[1:] for k in same)
    assert {whole[6, "ALL", d, None].status for d in "xyz"} == {4} and whole[6, "ALL", None, "x_and_z"].n_obs == 3
    assert (whole[5, "ALL", None, "x_and_y"].n_obs, whole[5, "ALL", None, "x_and_z"].n_obs, whole[4, "ALL", "x", None].status) == (0, 30, 1)
    monkeypatch.setattr(splits, "TASK_ROWS", 1)  # all keys but one are split
    split = found(rows)
    assert split.keys() == whole.keys()
    for k, r in split.items():
        assert all(a == (pytest.approx(b, rel=1e-9, abs=1e-7) if isinstance(b, float) else b) for a, b in zip(r, whole[k], strict=True)), (k, r, whole[k])


def test_extended_collocation_with_correlated_errors(spark):
    rng = np.random.default_rng(4)
    n = 100_000
    s, shared = rng.normal(0, 1, n), rng.normal(0, 0.3, n)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"loc_id": 1, "a": s + shared + rng.normal(0, 0.2, n), "b": s + shared + rng.normal(0, 0.2, n), "c": s + rng.normal(0, 0.3, n), "d": s + rng.normal(0, 0.3, n)}))
    e = triple.extended_collocation(df, list("abcd"), [("a", "b")]).first()
    assert e.err_cov_a_b == pytest.approx(0.09, abs=0.02) and e.err_corr_a_b == pytest.approx(0.09 / 0.13, abs=0.1)
    assert [e.sig_a, e.err_c] == pytest.approx([1, 0.09], abs=0.03)
    with pytest.raises(ValueError):
        triple.extended_collocation(df, list("abc"), [("a", "b")])


# ---- calculators, combinations, upscaling ----


def test_known_results(spark):
    n = 400
    base = spark.range(n).select(F.lit(1).cast("long").alias("loc_id"), F.timestamp_add("DAY", F.col("id").cast("int"), F.lit(DAY).cast("timestamp_ntz")).alias("ts"), F.when(F.col("id") != 10, 2.0).alias("ref"))
    for shift, bias, rmsd in ((2, -2, 2), (-4, 4, 4), (1, -1, 1)):
        got = calculators.pairwise("ref", "k1")(base.withColumn("k1", F.lit(2.0 + shift)), ["loc_id"]).first()
        assert (got.n_obs, got.BIAS, got.RMSD, got.mse, got.R, got.status) == (n - 1, bias, rmsd, rmsd**2, None, 0)
        assert got.RSS == pytest.approx((n - 1) * rmsd**2)
    few = calculators.pairwise("ref", "k1")(base.limit(5).withColumn("k1", F.lit(1.0)), ["loc_id"]).first()
    assert few.status == calculators.INSUFFICIENT_DATA and few.BIAS is None
    seasons = calculators.months(calculators.basic("ref", "k1"))(base.withColumn("k1", F.rand(3)), ["loc_id"])
    assert {r.subset for r in seasons.collect()} == set(calculators.SEASONS)
    with pytest.raises(ValueError):
        calculators.with_metadata(calculators.basic(), base.select("loc_id"), ["lon"])


def test_bootstrap_columns(spark):
    df = spark.createDataFrame([(1, DAY + timedelta(days=k), math.sin(k), math.sin(k) + (k % 5) / 9, math.sin(k) + (k % 7) / 9) for k in range(150)], "loc_id long, ts timestamp_ntz, ref double, k1 double, k2 double")
    got = calculators.pairwise("ref", "k1", bootstrap_cis=True, calc_kendall=True)(df, ["loc_id"]).first()
    for name in ("BIAS", "R", "rho", "tau", "urmsd", "mse", "RMSD"):
        assert got[f"{name}_ci_lower"] <= got[name] <= got[f"{name}_ci_upper"]
    t = calculators.triple_collocation(["ref", "k1", "k2"], "ref", bootstrap_cis=True)(df, ["loc_id"]).collect()
    assert len(t) == 3 and all("snr_ci_lower" in r for r in t)


def test_combinations_golden():
    assert combos.n_combinations([1, 2, 3, 4], 2, 1) == [(1, 2), (1, 3), (1, 4)]
    columns = {"DS1": ["soil moisture"], "DS2": ["sm"], "DS3": ["sm", "sm2"]}
    assert len(combos.result_combinations(columns, 3)) == 2 and len(combos.result_combinations(columns, 2)) == 5
    assert combos.combo_key((("DS1", "a"), ("DS2", "b"))) == "DS1.a_with_DS2.b"
    assert combos.combo_key((("D" * 5, "c" * 300), ("E", "c"))) == "DDDDD_with_E" and combos.combo_key((("D" * 300, "c"),)) == "validation"
    assert combos.as_list("ab") == ["ab"] and combos.flatten([1, [2, (3,)]]) == [1, 2, 3]


def test_stability_filter_golden(spark):
    rng = np.random.default_rng(5)
    k = np.linspace(0, 2 * np.pi, 1000)
    rows = []
    for p in range(5):
        v = np.sin(k) if p < 3 else np.sin(k + math.pi) if p == 3 else np.sin(k) + rng.normal(0, 2.2, 1000)
        rows += [(1, p, DAY + timedelta(days=i), float(v[i])) for i in range(1000)]
    df = spark.createDataFrame(rows, "loc_id long, point_id int, ts timestamp_ntz, value double")
    got = upscale.stable_points(df, "value")
    assert sorted(r.point_id for r in got.select("point_id").distinct().collect()) == [0, 1, 2]
    assert upscale.stable_points(df.filter("point_id > 2"), "value").count() == 2000
    one = upscale.averaged(upscale.temporally_matched(df.filter("point_id < 2"), "value"), "value")
    assert values(one) == pytest.approx(np.sin(k).tolist())


def test_upscaling_matches_as_nearest_does_with_one_order_of_time(spark, monkeypatch):
    rng = np.random.default_rng(8)
    T = DAY
    rows = [(int(rng.integers(3)), int(p), None if rng.random() < 0.03 else T + timedelta(hours=int(rng.integers(2400))), None if rng.random() < 0.1 else float(rng.integers(50))) for p in rng.integers(0, 4, 900)]
    df = spark.createDataFrame(rows, "loc_id int, point_id int, ts timestamp_ntz, value double")
    df = df.unionByName(df.limit(60).withColumn("value", F.col("value") + 1))  # two rows at one time
    got = upscale.temporally_matched(df, "value", hours=6)
    counts = df.groupBy("loc_id", "point_id").agg(F.count("value").alias("n"))
    best = counts.groupBy("loc_id").agg(F.min(F.struct(-F.col("n"), "point_id")).getField("point_id").alias("point_id"))
    marks = df.join(best, ["loc_id", "point_id"]).select("loc_id", "ts").distinct().join(counts.select("loc_id", "point_id"), "loc_id")
    want = collocate.nearest(marks, collocate.Other(df, ["value"]), 0.25, ["loc_id", "point_id"])
    as_rows = [sorted(map(tuple, d.select("loc_id", "point_id", "ts", "value").collect()), key=str) for d in (got, want)]
    assert as_rows[0] == as_rows[1] and len(as_rows[0]) > 900 and any(r[2] is None for r in as_rows[0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.rfind("Initial Plan") :] if "Initial Plan" in plan else plan
    assert len(re.findall(r"(?<!\w)Window \[", plan)) == 1  # nearest() has three, each with an order of its own
    seen = []
    monkeypatch.setattr(upscale, "kept", lambda d, k=upscale.kept: seen.append(d.columns) or k(d))
    upscale.stable_points(got, "value")
    assert seen[0] == ["loc_id", "point_id", "ts", "value"]  # matched once, though read twice
