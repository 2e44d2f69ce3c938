"""Whole validations and stored parameters: forms that must agree, and what repeated runs leave behind."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import calculators, scaling
from tidemark.plans.inputs import fresh_folder
from tidemark.plans.validation import Validation, ValidationError
from tidemark.sources.datasets import Dataset, frame

T0 = datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def sets(spark):
    def of(shift, skip):
        rows = [(loc, T0 + timedelta(days=k, minutes=shift), float((k * (loc + 3 + shift)) % 11) + shift) for loc in (1, 2) for k in range(40) if k % skip]
        return spark.createDataFrame(rows, "loc_id int, ts timestamp_ntz, v double")

    return {n: Dataset(frame(of(k, 5 + k)), ["v"]) for k, n in enumerate(("a", "b", "c"))}


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(1,), (2,), (9,)], "loc_id int")


def rows_of(df):
    return sorted((tuple("" if v is None else round(v, 8) + 0.0 if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=str)


def test_all_combinations_at_once_equal_one_after_another(spark, sets, places):
    for k, run in ((2, calculators.pairwise("ref", "k1", calc_spearman=False)), (3, calculators.triple_collocation(["ref", "k1", "k2"], "ref"))):
        once = Validation(sets, "a", {(3, k): run}, temporal_window=0.1, scaling=None)
        each = Validation(sets, "a", {(3, k): run}, temporal_window=0.1, scaling=lambda df, columns, ref: df)
        got, want = once.calc(spark, places), each.calc(spark, places)
        assert rows_of(got) == rows_of(want.select(*got.columns)) and got.filter("loc_id = 9 and status = 7").count() == (3 if k == 2 else 1)
        assert not once._held and len(each._held) == 1
        each.release()
        assert not each._held


def test_scaling_by_name_equals_the_same_as_a_function(spark, sets, places):
    def same(df, columns, ref):
        return scaling.scale(df, columns, "mean_std", ref)

    run = calculators.pairwise("ref", "k1", calc_spearman=False, analytical_cis=False)
    got, want = (Validation(sets, "b", {(3, 2): run}, temporal_window=0.1, scaling=s).calc(spark, places) for s in ("mean_std", same))
    assert rows_of(got) == rows_of(want.select(*got.columns))


def test_the_number_of_exchanges_does_not_grow_with_the_combinations(spark, sets, places):
    run = calculators.pairwise("ref", "k1", calc_spearman=False, analytical_cis=False)

    def exchanges(chosen, reference_only):
        v = Validation(chosen, "a", {(3, 2): run}, temporal_window=0.1, scaling=None)
        plan = v.calc(spark, places, only_with_reference=reference_only)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert exchanges(sets, False) == exchanges(sets, True)  # three combinations, and two


def test_raise_mode_lets_go_of_what_it_kept(spark, sets, places):
    run = calculators.pairwise("ref", "k1", calc_spearman=False, analytical_cis=False)
    v = Validation(sets, "a", {(3, 2): run}, temporal_window=0.1, scaling=None)
    with pytest.raises(ValidationError):
        v.calc(spark, places, handle_errors="raise")  # nothing is known of location 9
    assert not v._held


def test_parameters_are_stored_once(spark):
    df = spark.createDataFrame([(loc, float(k % 17), float(k % 23) * 2) for loc in (1, 2, 3) for k in range(120)], "loc_id int, x double, y double")
    kept = scaling.StoredCdf(spark, fresh_folder(spark, "cdf"))
    first = rows_of(kept.scale(df.filter("loc_id < 3"), "x", "y"))
    assert rows_of(kept.scale(df.filter("loc_id < 3"), "x", "y")) == first  # nothing is added
    assert spark.read.parquet(kept.path).count() == 2
    stored = spark.read.parquet(kept.path)
    kept.store(spark.createDataFrame(stored.collect(), stored.schema))  # as if another run had stored the same
    assert len(rows_of(kept.scale(df, "x", "y"))) == 360 and spark.read.parquet(kept.path).count() == 5
