"""The queries cover all rows of their tables."""

import math
import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(k, datetime(1995, 1, 1) + timedelta(days=rng.randrange(60)), float(rng.randint(1, 6)), rng.uniform(1, 9), rng.randint(0, 3) / 100, 0.02) for k in (1, 2, 3, 24, 25, 40, 41, 47, 150, 151) for _ in range(40)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{at}/lineitem.parquet")
    return at, rows


def by_sql(at, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{at}/lineitem.parquet/*.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_kendall_of_every_row(spark, lineitem):
    at, rows = lineitem
    got = {r.loc_id: (r.n_obs, r.tau) for r in entry.queries()["kendall_tau_all"](spark, at).collect()}
    for k in {r[0] for r in rows}:
        v = [(r[2], r[4]) for r in rows if r[0] == k]
        signs = [((a > c) - (a < c), (b > d) - (b < d)) for i, (a, b) in enumerate(v) for c, d in v[:i]]
        tau = sum(s * t for s, t in signs) / math.sqrt(sum(s * s for s, _ in signs) * sum(t * t for _, t in signs))
        assert got.pop(k) == (len(v), pytest.approx(tau, abs=1e-6))
    assert not got
    want = by_sql(at, "kendall_tau_all")
    assert len(want) == len({r[0] for r in rows}) and sorted(tuple(r) for r in entry.queries()["kendall_tau_all"](spark, at).collect()) == [pytest.approx(x) for x in want]


def test_every_point_is_upscaled(spark, lineitem):
    at, rows = lineitem
    areas = {r[0] // 6 for r in rows}
    got = sorted((r.loc_id, r.ts, r.value) for r in entry.queries()["upscaled_average_all"](spark, at).collect())
    assert {r[0] for r in got} == areas and max(areas) == 25
    want = by_sql(at, "upscaled_average_all")
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert {r.loc_id for r in entry.queries()["upscaled_stable"](spark, at).collect()} == areas
