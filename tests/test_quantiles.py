"""Exact quantiles by narrowing against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import quantiles
from millrace.operators.moments import fold_moments, moment_state, moments_of
from millrace.operators.number_store import NumberStore
from millrace.operators.profile import central_moments
from millrace.operators.quantiles import DECILES, approx_quantiles, exact_quantiles
from millrace.workspace import fresh_dir

numbers = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300),
    st.sampled_from([0.0, 1.0, -1.0, 5e-324, 1.0000000000000002, 1.0000000000000004]),
)


def found(df):
    return [r.quantile for r in exact_quantiles(df, ["v"]).orderBy("probability").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(numbers, min_size=1, max_size=60))
def test_narrowing_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    expected = np.percentile(values, [p * 100 for p in DECILES])
    assert np.allclose(found(df), expected, rtol=1e-12, atol=0)


def test_one_value_holds_most_rows(spark):
    df = spark.range(30000).selectExpr("IF(id % 3 = 0, 7.0D, id * 0.5D) AS v")
    values = [7.0 if i % 3 == 0 else i * 0.5 for i in range(30000)]
    expected = np.percentile(values, range(0, 101, 10))
    assert np.allclose(found(df), expected)


def test_empty_and_single(spark):
    one = spark.createDataFrame([(3.5,)], "v double")
    assert found(one) == [3.5] * 11
    assert found(one.limit(0)) == []


def test_approximate_rank_error(spark):
    df = spark.range(10000).selectExpr("cast(id AS double) AS v")
    got = [r.quantile for r in approx_quantiles(df, ["v"]).orderBy("probability").collect()]
    assert np.abs(np.array(got) - np.percentile(range(10000), range(0, 101, 10))).max() <= 2


MIXED = [0.0, -0.0, 5e-324, -1e-9, 1e300, -1e300, 7.0] + [7.0] * 400 + [1000 + i / 7 for i in range(600)] + [-3.5 - i % 11 for i in range(200)]


@pytest.mark.parametrize("most", [1, 50, 1 << 17])
def test_every_split_gives_the_same(spark, monkeypatch, most):
    """By magnitude, then by equal parts, then value by value."""
    monkeypatch.setattr(quantiles, "MOST_KINDS", most)
    monkeypatch.setattr(quantiles, "_SPLITS", 16)
    df = spark.createDataFrame([(v, -v) for v in MIXED] + [(None, float("nan"))], "v double, w double")
    got = {(r.column, r.probability): r.quantile for r in exact_quantiles(df, ["v", "w"]).collect()}
    for name, sign in (("v", 1), ("w", -1)):
        expected = np.percentile(np.array(MIXED) * sign, [p * 100 for p in DECILES])
        assert np.allclose([got[name, p] for p in DECILES], expected, rtol=1e-12, atol=0)


def test_many_columns(spark):
    df = spark.range(50).selectExpr(*[f"id * {k} AS c{k}" for k in range(30)])
    got = {(r.column, r.probability): r.quantile for r in exact_quantiles(df, df.columns, [0.5, 1.0]).collect()}
    assert got == {(f"c{k}", p): 49 * k * p for k in range(30) for p in (0.5, 1.0)}


def test_folded_state_equals_the_whole(spark):
    """Old rows are in the state only; a repeated batch counts once, one without histogram not at all."""
    store = NumberStore(spark, fresh_dir(spark, "numbers"))
    assert store.batches() == []
    whole = spark.createDataFrame([(v, i % 9) for i, v in enumerate(MIXED)] + [(None, 3)], "v double, k int")
    parts = whole.where("k < 4"), whole.where("k >= 4 AND k < 8"), whole.where("k = 8")
    for i, part in [(0, parts[0]), (1, parts[0]), (1, parts[1]), (2, parts[2]), (3, whole.limit(0))]:
        store.add(part, ["v"], f"b{i}")
    (spark.read.parquet(f"{store.root}/values/batch=b0")).write.parquet(f"{store.root}/values/batch=cut")
    assert store.batches() == ["b0", "b1", "b2", "b3"] or store.batches() == ["b0", "b1", "b2"]
    got = [r.quantile for r in store.quantiles().orderBy("probability").collect()]
    assert np.allclose(got, np.percentile(MIXED, [p * 100 for p in DECILES]), rtol=1e-12, atol=0)


def test_only_wanted_magnitudes_are_read(spark):
    store = NumberStore(spark, fresh_dir(spark, "numbers"))
    store.add(spark.range(100_000).selectExpr("id * 1.0D AS v"), ["v"], "a")
    scans = []
    plain = quantiles._inside

    def seen(counts, live):
        found = plain(counts, live)
        scans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    quantiles._inside = seen
    try:
        assert [r.quantile for r in store.quantiles([0.25]).collect()] == [24999.75]
    finally:
        quantiles._inside = plain
    assert scans and all("GreaterThanOrEqual(value," in s and "EqualTo(column,v)" in s for s in scans)


def test_moments_fold_and_keep_their_digits(spark):
    """Values far from zero: the sums are about their own means, so nothing cancels."""
    values = np.random.default_rng(3).normal(size=3_000) + np.where(np.arange(3_000) % 3, 1e9, -5.0)
    apart = values[values > 0] - 1e9
    df = spark.createDataFrame([(float(v), float(a)) for v, a in zip(values, np.resize(apart, 3_000) + 1e9)], "v double, far double")
    state = [moment_state(df.where(f"pmod(hash(v), 3) = {k}"), ["v", "far"], 4) for k in range(3)]
    for found in (moments_of(fold_moments(*state, highest=4), ["v", "far"], 4), central_moments(df, ["v", "far"], 4)):
        got = {(r.column, r.order): r.moment for r in found.collect()}
        for name, x in (("v", values), ("far", np.resize(apart, 3_000) + 1e9)):
            own = x - x.mean()
            for k in (3, 4):
                assert got[name, k] == pytest.approx((own**k).mean(), rel=1e-5, abs=1e-5)


def test_moments_of_a_column_without_numbers(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0)], "n double, v double")
    got = {(r.column, r.order): r.moment for r in central_moments(df, ["n", "v"], 3).collect()}
    assert got == {("n", 3): None, ("v", 3): 0.0}
    assert exact_quantiles(df, ["n"]).count() == 0
