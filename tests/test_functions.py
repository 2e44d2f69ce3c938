import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import moments, special
from tidemark.operators import intervals, ranks, splits
from tidemark.operators.shared import whole_groups


def frame(spark, x, y):
    return spark.createDataFrame([(1, float(a) if a is not None else None, float(b)) for a, b in zip(x, y, strict=True)], "loc_id long, x double, y double")


def test_golden_moments(spark):
    x = list(range(10))
    y = [v + 2 for v in x]
    got = moments.pairwise(frame(spark, x, y), ["loc_id"], "x", "y").first()
    assert (got.n_obs, got.bias, got.rmsd, got.ubrmsd, got.pearson_r) == (10, -2, 2, 0, pytest.approx(1))
    y[9] = 100
    got = moments.pairwise(frame(spark, x, y), ["loc_id"], "x", "y").first()
    assert got.rmsd == pytest.approx(math.sqrt(831.7)) and got.ubrmsd == pytest.approx(26.7)
    y[9] = 51
    got = moments.pairwise(frame(spark, x, y), ["loc_id"], "x", "y").first()
    assert (got.msd, got.mse_bias) == (pytest.approx(180), pytest.approx(36))
    assert got.mse == pytest.approx(got.msd)


def test_missing_constant_and_few(spark):
    df = frame(spark, [1, None, float("nan"), float("inf"), 1], [1, 2, 3, 4, 5])
    got = moments.pairwise(df, ["loc_id"], "x", "y").first()
    assert got.n_obs == 2 and got.pearson_r is None and got.bias == -2
    few = moments.pairwise(df, ["loc_id"], "x", "y", min_obs=3).first()
    assert few.n_obs == 2 and few.bias is None
    assert moments.pairwise(df.limit(0), ["loc_id"], "x", "y").count() == 0


def test_distribution_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert special.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert special.gammainc(2.0, 3.0) == pytest.approx(1 - 4 * math.exp(-3), abs=1e-12)
    assert special.gammainc(30.0, 20.0) == pytest.approx(0.021818, abs=1e-5)
    assert special.t_quantile(0.975, np.array([1.0, 10.0, 1000.0])) == pytest.approx([12.7062047, 2.2281389, 1.9623391], abs=1e-6)
    assert special.chi2_quantile(0.975, np.array([1.0, 9.0, 200.0])) == pytest.approx([5.0238862, 19.0227678, 241.0578951], abs=1e-5)
    assert special.chi2_quantile(0.025, np.array([9.0])) == pytest.approx([2.7003895], abs=1e-6)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_correlation_p(spark):
    df = spark.createDataFrame([(0.5, 20.0), (1.0, 5.0), (None, 7.0), (0.3, 2.0)], "r double, n double")
    got = [r.p for r in df.select(special.correlation_p("r", "n").alias("p")).collect()]
    assert got == [pytest.approx(0.02475, abs=1e-4), 0.0, None, 1.0]


def test_golden_fisher_intervals(spark):
    df = spark.createDataFrame([(0.654, 34), (0.824, 300)], "r double, n int")
    low, high = intervals.fisher_interval(F.col("r"), F.col("n"))
    got = df.select(low.alias("a"), high.alias("b")).collect()
    assert [(round(r.a, 3), round(r.b, 3)) for r in got] == [(0.406, 0.812), (0.784, 0.857)]


def test_analytical_intervals_cover_bootstrapped_ones(spark):
    rng = np.random.default_rng(0)
    z = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 1000)
    df = frame(spark, z[:, 0], 1.1 * z[:, 1] + 0.5)
    for metric, want in (("bias", -0.5), ("pearson_r", 0.8), ("ubrmsd", math.sqrt(1 + 1.21 - 2 * 1.1 * 0.8))):
        a = intervals.analytical(df, "x", "y", metric).first()
        b = intervals.bootstrapped(df, "x", "y", metric, nsamples=400, seed=1).first()
        assert a.lower < want < a.upper and b.lower < want < b.upper
        assert (a.lower, a.upper) == (pytest.approx(b.lower, abs=0.03), pytest.approx(b.upper, abs=0.03))
        again = intervals.bootstrapped(df.repartition(5), "x", "y", metric, nsamples=400, seed=1).first()
        assert again == b
    for method in ("basic", "BCa"):
        b = intervals.bootstrapped(df, "x", "y", "bias", method=method, nsamples=300).first()
        assert b.lower < -0.5 < b.upper
    assert intervals.bootstrapped(df.limit(50), "x", "y", "bias").first().lower is None
    with pytest.raises(ValueError):
        intervals.analytical(df, "x", "y", "rmsd")


def kendall_by_pairs(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
    a, b = (sum(v[i] != v[j] for i in range(n) for j in range(i)) for v in (x, y))
    return s / math.sqrt(a * b)


def mean_ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


@pytest.mark.parametrize("task_rows", [1_000_000, 25])
def test_rank_correlations_by_brute_force(spark, monkeypatch, task_rows):
    """The same for keys that fit a task and for keys that are split at their quantiles, with few ties and with many."""
    monkeypatch.setattr(splits, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(2)
    series = []
    for n, levels in ((2, 9**9), (8, 9**9), (30, 9**9), (40, 5), (60, 9**9), (200, 20), (300, 9**9), (400, 3)):
        x = rng.integers(0, levels, n).astype(float)
        y = np.where(rng.random(n) < 0.3, x, rng.integers(0, levels, n)).astype(float)
        if n == 300:
            x[:100] = 7.0  # a third are one value
            y[50:150] = 7.0
        series.append((x, y))
    rows = [(k, float(a), float(b)) for k, (x, y) in enumerate(series) for a, b in zip(x, y, strict=True)] + [(0, None, 1.0), (1, math.nan, 2.0), (99, None, None)]
    df = spark.createDataFrame(rows, "loc_id int, x double, y double").repartition(6)
    tau = {r.loc_id: r for r in ranks.kendall(df, "x", "y").collect()}
    rho = {r.loc_id: r for r in ranks.spearman(df, "x", "y").collect()}
    pairs = {r.loc_id: r for r in ranks.spearman_of_pairs(df, [("x", "y")], ["loc_id"]).collect()}
    assert set(tau) == set(rho) == set(range(len(series)))
    for k, (x, y) in enumerate(series):
        assert tau[k].n_obs == rho[k].n_obs == len(x)
        assert tau[k].tau == pytest.approx(kendall_by_pairs(x, y)) and 0 <= tau[k].p_tau <= 1
        assert rho[k].rho == pytest.approx(np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1]) == pairs[k].rho_between_x_and_y


@pytest.mark.parametrize("task_rows", [1_000_000, 30])
def test_medians_of_split_keys(spark, monkeypatch, task_rows):
    monkeypatch.setattr(splits, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(3)
    data = {0: rng.normal(size=501), 1: rng.integers(0, 4, 300) * 1.0, 2: np.array([2.0, 9.0]), 3: np.where(rng.random(400) < 0.5, 1.0, rng.normal(size=400))}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [(0, None), (4, None), (2, math.nan)]
    df = spark.createDataFrame(rows, "loc_id int, x double").repartition(4)
    got = {r.loc_id: r["median"] for r in ranks.medians(df, moments.known("x"), ["loc_id"]).collect()}
    assert got.pop(4) is None and got == {k: pytest.approx(np.median(x)) for k, x in data.items()}
    assert ranks.mad(df.withColumn("y", F.lit(1.0)), ["loc_id"], "x", "y").filter("loc_id = 2").first().mad == pytest.approx(4.5)


def test_exact_p_of_kendall(spark):
    def one(x, y):
        return ranks.kendall(frame(spark, x, y), "x", "y").first()

    assert one(range(5), range(5)).tau == pytest.approx(1.0) and one(range(5), range(5)).p_tau == pytest.approx(2 / 120)
    assert one([1, 2, 3, 4, 5], [2, 1, 3, 4, 5]).p_tau == pytest.approx(2 * 5 / 120)
    assert one([1, 1, 1], [1, 2, 3]).tau is None
    assert ranks.spearman(frame(spark, [1, 1, 1], [1, 2, 3]), "x", "y").first().rho is None
    # all orders of six values: p is the share of those at least as far from the middle
    orders = [sum(p[i] > p[j] for i in range(6) for j in range(i, 6)) for p in itertools.permutations(range(6))]
    for c in range(8):
        assert ranks.exact_p(6, c) == pytest.approx(min(1, 2 * sum(o <= c for o in orders) / 720))


def test_a_split_key_has_bounded_chunks(spark, monkeypatch):
    monkeypatch.setattr(splits, "TASK_ROWS", 1000)
    df = spark.range(40_000).select(F.lit(1).alias("loc_id"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1) * 10).alias("x"), F.lit(1.0).alias("y"))
    found = splits.weighted(df, ["loc_id"], ["x"]).rows
    sizes = {r["__c_x"]: r["n"] for r in found.groupBy("__c_x").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 2000
    assert found.filter("x = 5.0").first()["__w"] > 13_000  # a heavy value is one row


def test_spearman(spark):
    got = ranks.spearman(frame(spark, [1, 2, 3, 4, 4], [2, 1, 4, 3, 3]), "x", "y").first()
    a, b = np.array([1, 2, 3, 4.5, 4.5]), np.array([2, 1, 5, 3.5, 3.5])
    assert got.rho == pytest.approx(np.corrcoef(a, b)[0, 1]) and 0 < got.p_rho < 1


def test_calendar_golden(spark):
    df = spark.createDataFrame([("2016-05-25 10:20:11",), ("2004-02-29 00:00:00",), ("2005-03-01 00:00:00",), ("2007-01-31 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    t = F.col("t")
    got = df.select(cal.to_julian(t).alias("jd"), cal.leap_doy(t).alias("doy"), cal.dekad_index(t).alias("i"), cal.dekad_end(t).cast("string").alias("e"), cal.from_julian(cal.to_julian(t)).cast("string").alias("back"), cal.is_dekad_end(t).alias("is_end")).collect()
    assert got[0].jd == pytest.approx(2457533.9306828701, abs=1e-9)
    assert [r.doy for r in got] == [146, 60, 61, 31] and [r.i for r in got] == [15, 6, 7, 3]
    assert [r.e for r in got] == ["2016-05-31", "2004-02-29", "2005-03-10", "2007-01-31"] and got[3].is_end
    assert got[1].back == "2004-02-29 00:00:00"
    labels = [str(r.label) for r in cal.labels_between(spark, "2007-01-01", "2007-02-01").collect()]
    assert labels == ["2007-01-10", "2007-01-20", "2007-01-31", "2007-02-10"]
    starts = [str(r.label) for r in cal.labels_between(spark, "2007-01-01", "2007-02-01", start_labels=True).collect()]
    assert starts == ["2007-01-01", "2007-01-11", "2007-01-21", "2007-02-01"]
    assert cal.Yearless(3, 1).doy == 61 and cal.Yearless(2, 29) < cal.Yearless(3, 1)
    year = spark.range(1).select(cal.Yearless(2, 29).in_year(F.lit(2001)).alias("a"), cal.Yearless(2, 29).in_year(F.lit(2004)).cast("string").alias("b"), cal.running_dekad_date(F.lit(2004), F.lit(6)).cast("string").alias("c")).first()
    assert (year.a, year.b, year.c) == (None, "2004-02-29 00:00:00", "2004-02-29")


def test_covariances_of_any_order(spark):
    """Covariances that nearly cancel out are right to the last digits, however the rows are dealt and added up."""
    rng = random.Random(4)
    rows = [(k % 3 or None, 40.125 + rng.randrange(-400, 400) / 8, 3.0e6 + rng.randrange(-(2**20), 2**20) / 8, 7.25) for k in range(3000)]
    want = {}
    for key in (None, 1, 2):
        x, y = ([Fraction(r[c]) for r in rows if r[0] == key] for c in (1, 2))
        want[key] = (sum(x) * sum(y) / len(x), sum(a * b for a, b in zip(x, y, strict=True)), len(x))
        want[key] = float((want[key][1] - want[key][0]) / (len(x) - 1))
    for parts, order in ((1, "x"), (3, "y"), (7, "x desc")):
        df = spark.createDataFrame(rows, "loc_id int, x double, y double, z double").repartition(parts).sortWithinPartitions(F.expr(order.split()[0]).desc() if " " in order else order)
        got = {r.loc_id: r for r in moments.covariance_matrix(df, ["loc_id"], ["x", "y", "z"]).collect()}
        assert {k: r.c_0_1 for k, r in got.items()} == {k: pytest.approx(v, rel=1e-15) for k, v in want.items()}
        assert {(r.n, r.c_2_2, r.c_0_2) for r in got.values()} == {(1000, 0.0, 0.0)}


@pytest.mark.parametrize("task_rows", (1_000_000, 300))
def test_tasks_follow_the_distinct_rows(spark, monkeypatch, task_rows):
    """What a task ranks doesn't grow with the number of keys, and ties that leave few distinct rows ask for no more tasks."""
    monkeypatch.setattr(splits, "SHARE_ROWS", 100)
    monkeypatch.setattr(splits, "TASK_ROWS", task_rows)
    rows = [(k % 10, float(k * 7919 % 4001), float(k % 3)) for k in range(4000)]
    df = spark.createDataFrame(rows, "loc_id int, x double, y double")
    split = splits.weighted(df, ["loc_id"], ["x", "y"])
    assert split.tasks == pytest.approx(40, abs=4)
    ranked = splits.average_ranks(split, {"x": "rx"})
    assert split.rows.rdd.getNumPartitions() == split.tasks and ranked.count() == 4000
    assert splits.weighted(df, ["loc_id"], ["y"]).tasks is None
    got = {r.loc_id: (r.n_obs, r.rho) for r in ranks.spearman(df, "x", "y").collect()}
    tau = {r.loc_id: r.tau for r in ranks.kendall(df, "x", "y").collect()}
    monkeypatch.setattr(splits, "SHARE_ROWS", 500_000)
    monkeypatch.setattr(splits, "TASK_ROWS", 1_000_000)
    assert got == {r.loc_id: (r.n_obs, pytest.approx(r.rho, abs=1e-12)) for r in ranks.spearman(df, "x", "y").collect()}
    assert tau == {r.loc_id: pytest.approx(r.tau, abs=1e-12) for r in ranks.kendall(df, "x", "y").collect()}


def test_inversions_of_many_groups_take_a_pass_for_each_bit(monkeypatch):
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 40, 1200))
    group = np.unique(group, return_inverse=True)[1]
    v, w = rng.integers(0, 12, 1200).astype(float), rng.integers(1, 4, 1200)
    sorts = []
    monkeypatch.setattr(ranks.np, "argsort", lambda *a, f=np.argsort, **k: sorts.append(1) or f(*a, **k))
    got = ranks.inversions(v, w, group)
    assert len(sorts) <= 4
    for g in range(40):
        a, b = v[group == g], w[group == g]
        assert got[g] == sum(b[i] * b[j] for j in range(len(a)) for i in range(j) if a[i] > a[j])
    assert ranks.inversions(np.zeros(0)).tolist() == [0.0] and ranks.inversions(np.array([3.0, 1, 2])).tolist() == [2.0]


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_groups_are_whole_whatever_the_batches(size):
    keys = [(1, "a")] * 9 + [(1, None)] * 2 + [(2, None)] + [(None, "a")] * 20 + [(None, "b")]
    rows = pa.table({"k": [a for a, _ in keys], "l": [b for _, b in keys], "v": list(range(len(keys)))})
    seen, tables = [], 0
    for part, first in whole_groups(rows.to_batches(max_chunksize=size), ["k", "l"]):
        tables += 1
        ends = [*first.tolist()[1:], part.num_rows]
        seen += [((part["k"][a].as_py(), part["l"][a].as_py()), part["v"].slice(a, b - a).to_pylist()) for a, b in zip(first.tolist(), ends)]
    assert [k for k, _ in seen] == list(dict.fromkeys(keys)) and [v for _, vs in seen for v in vs] == list(range(len(keys)))
    assert size < 100 or tables == 2  # not a call for each group
