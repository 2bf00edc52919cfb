"""Profiles and checks on inline rows, and whole runs."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators.custom import PartialStatistic, custom_check, custom_statistic, register_check, register_statistic
from millrace.operators.detect import (
    NO_NEW_ROWS,
    check_categories,
    check_numbers,
    drifting_rows,
    outliers,
    quality_report,
    run_quality,
    take_baseline,
    unseen_values,
)
from millrace.operators.profile import category_set, central_moments, numeric_profile
from millrace.plans.quality import CustomCheck, QualitySpec
from millrace.workspace import fresh_dir


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def stored(spark, mean=10, deviation=2, bound=None, multiplier=None):
    schema = "column string, mean bigint, deviation bigint, bound double, multiplier double"
    return spark.createDataFrame([("v", mean, deviation, bound, multiplier)], schema)


def test_profile_rounds_half_even_and_ignores_nulls(spark):
    found = numeric_profile(numbers(spark, [1.0, 4.0, None]), ["v"]).first()
    assert (found["rows"], found["mean"], found.deviation, found.min, found.max) == (2, 2, 2, 1.0, 4.0)


def test_single_row_has_no_deviation(spark):
    assert numeric_profile(numbers(spark, [3.0]), ["v"]).first().deviation == 0


def test_value_on_the_bound_is_no_outlier(spark):
    df = numbers(spark, [16.0, 16.01, 4.0, 3.99, None, 20.0, 20.5])
    assert rows(outliers(df, "v", stored(spark))) == [(3.99,), (16.01,), (20.0,), (20.5,)]
    assert rows(outliers(df, "v", stored(spark), 5)) == [(20.5,)]
    assert rows(outliers(df, "v", stored(spark, multiplier=4.0), "custom")) == [(20.0,), (20.5,)]


@pytest.mark.parametrize("far,passes", [(1, True), (2, False)])
def test_one_ninth_may_lie_outside(spark, far, passes):
    df = numbers(spark, [10.0] * (9 - far) + [100.0] * far)
    assert check_numbers(df, ["v"], stored(spark)).first().is_pass is passes


def test_bound_decides_when_given(spark):
    df = numbers(spark, [10.0] * 8 + [100.0] * 2)
    found = check_numbers(df, ["v"], stored(spark, bound=0.2, multiplier=2.24)).first()
    assert found.is_pass is True and found.beyond_custom == 2 and found.beyond_3 == 2
    assert check_numbers(df, ["v"], stored(spark, bound=0.19, multiplier=2.29)).first().is_pass is False


def test_without_baseline_or_numbers_a_column_fails(spark):
    df = spark.createDataFrame([(10.0, 1.0, None, "x")], "v double, w double, n double, t string")
    more = stored(spark).unionByName(stored(spark).withColumn("column", F.explode(F.array(F.lit("n"), F.lit("t")))))
    found = rows(check_numbers(df, ["v", "w", "n", "t"], more), "column", "is_pass", "reason")
    assert found == [("n", False, "no numbers"), ("t", False, "no numbers"), ("v", True, None), ("w", False, "no baseline")]


def test_moments(spark):
    found = dict(rows(central_moments(numbers(spark, [1.0, 2.0, 6.0, None]), ["v"], 4), "order", "moment"))
    assert found[3] == pytest.approx(6.0) and found[4] == pytest.approx((16 + 1 + 81) / 3)


def test_categories(spark):
    base = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    known = category_set(base, ["c"])
    new = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "c string")
    assert rows(known, "value") == [("a",), ("b",)]
    assert rows(unseen_values(new, ["c"], known), "value", "rows") == [(None, 1), ("z", 2)]
    assert rows(drifting_rows(new, "c", known)) == [(None,), ("z",), ("z",)]
    assert tuple(check_categories(new, ["c"], known).first()) == ("c", 4, 3, 2, False)
    assert check_categories(base.where("c is not null"), ["c"], known).first().is_pass is True


def test_custom_statistic_in_python_is_merged_from_parts(spark):
    register_statistic("longest", PartialStatistic(lambda s: int(s.str.len().max()), max, str))
    df = spark.range(1000).selectExpr("cast(id AS string) AS t").repartition(20)
    assert custom_statistic(df, "t", "longest").first().data == "3"
    register_check("shorter", lambda c, d: F.struct((F.max(F.length(c)) <= d.cast("int")).alias("pass"), F.lit("ok").alias("log")))
    assert tuple(custom_check(df, "t", "shorter", F.lit("2")).first()) == ("t", False, "ok")
    with pytest.raises(ValueError):
        custom_statistic(df, "t", "missing")


def test_baseline_on_itself_never_drifts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spec = QualitySpec("1", key="event_id", numeric=("value",), category=("user_id", "event_type"))
    report = quality_report(events, spec, take_baseline(events, spec)).first()
    assert report.validation_result is True and report.sample_num == events.count()


def test_profile_then_check_then_nothing_new_then_failure(spark):
    base, results = fresh_dir(spark, "baseline"), fresh_dir(spark, "results")
    register_statistic("top", F.max)
    register_check("below", lambda c, d: F.struct((F.max(c) <= d.cast("double")).alias("pass"), F.lit("").alias("log")))
    df = spark.range(1, 101).selectExpr("id", "cast(id % 10 AS double) AS v", "cast(id % 2 AS string) AS c", "id % 10 AS w")
    spec = dict(name="t", numeric=("V",), category=("C",), custom={"W": CustomCheck("top", "below"), "v": CustomCheck("unused", "unused")}, key="id")
    assert run_quality(spark, df, QualitySpec("9", **spec), base, results) == "profiled"
    more = df.union(spark.sql("SELECT 101L, 3.0D, 'new', 3L"))
    assert run_quality(spark, more, QualitySpec("9", key_mark=100, **spec), base, results) == "checked"
    assert run_quality(spark, df, QualitySpec("9", key_mark=100, **spec), base, results, manual=True) == "checked"
    broken = df.withColumn("v", F.assert_true(F.col("id") < 50).cast("double"))
    assert run_quality(spark, broken, QualitySpec("9", key_mark=1, **spec), base, results) == "failed"
    found = {(r.task_status, r.sample_num): r for r in spark.read.parquet(results).collect()}
    assert found[(True, 1)].validation_result is False and found[(True, 1)].key_max == "101"
    assert found[(True, 0)].error_msg == NO_NEW_ROWS and found[(True, 0)].execution_type == "Manual"
    assert found[(True, 0)].validation_result is False and found[(False, None)].error_msg


def test_mark_moves_with_automatic_runs_only(spark):
    base, results = fresh_dir(spark, "baseline"), fresh_dir(spark, "results")
    spec = QualitySpec("5", key="id", numeric=("v",), expect_count=3)

    def run(until, manual=False, broken=False):
        df = spark.range(1, until + 1).selectExpr("id", "cast(id % 10 AS double) AS v")
        df = df.withColumn("v", F.assert_true(F.col("id") < 0).cast("double")) if broken else df
        return run_quality(spark, df, spec, base, results, manual)

    assert [run(100), run(120, manual=True), run(130), run(150, broken=True)] == ["profiled", "checked", "checked", "failed"]
    assert [run(150), run(200), run(200, manual=True)] == ["checked", "disabled", "checked"]
    found = rows(spark.read.parquet(results), "iteration", "sample_num", "key_min", "key_max", "task_status")
    assert found == [
        (-1, 20, "101", "120", True), (-1, 50, "151", "200", True), (1, 30, "101", "130", True),
        (2, None, None, None, False), (3, 20, "131", "150", True)]


def test_tasks_in_one_results_table_have_their_own_marks(spark):
    results = fresh_dir(spark, "results")
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id / 4) AS at, id * 1D AS v FROM range(9)")
    for task in ("a", "b"):
        spec, base = QualitySpec(task, ts="at", numeric=("v",)), fresh_dir(spark, "baseline")
        assert run_quality(spark, df.where("v < 5" if task == "a" else "v < 2"), spec, base, results) == "profiled"
        assert run_quality(spark, df, spec, base, results) == "checked"
    assert rows(spark.read.parquet(results), "task_id", "sample_num", "iteration") == [("a", 4, 1), ("b", 7, 1)]


def test_report_scans_the_new_rows_once(spark, sf_dir, monkeypatch):
    """All checks come from one scan; the report itself reads the stored counts only."""
    from millrace.operators import states

    plans = []
    plain = states.stored

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    register_statistic("peak", F.max)
    register_check("rate", lambda c, d: F.struct((F.sum(c) / F.count(c) < d.cast("double")).alias("pass"), d.alias("log")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spec = QualitySpec("1", key="event_id", numeric=("value", "user_id"), category=("event_type",), moments=4,
                       custom={"ts_hour": CustomCheck("peak", "rate")})
    events = events.withColumn("ts_hour", F.hour("ts"))
    baseline = take_baseline(events, spec)
    monkeypatch.setattr(states, "stored", recorded)
    report = quality_report(events, spec, baseline)
    assert [p.count("events.parquet") for p in plans] == [1] and plans[0].count("FileScan") == 1
    assert "events.parquet" not in report._jdf.queryExecution().executedPlan().toString()
    row = report.first()
    assert row.validation_result is True and all(c in row.detail for c in ("value", "user_id", "event_type", "ts_hour"))


def test_report_agrees_with_the_single_checks(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.expr("IF(event_id % 50 = 0, NULL, value)"))
    old, new = events.where("ts < '2024-01-05'"), events.where("ts >= '2024-01-05'")
    spec = QualitySpec("1", numeric=("value", "user_id"), chebyshev={"value": 0.05})
    baseline = take_baseline(old, spec)
    plain = numeric_profile(old, ["value", "user_id"], {"value": 0.05})
    names = ["column", "rows", "mean", "deviation", "min", "max", "bound", "multiplier"]
    assert rows(baseline["numbers"], *names) == rows(plain, *names)
    from millrace.operators.detect import number_verdicts
    from millrace.operators.states import scan

    found = number_verdicts(scan(new, spec.numeric), baseline["numbers"])
    single = check_numbers(new, spec.numeric, baseline["numbers"])
    names = ["column", "rows", "mean", "deviation", "min", "max", "beyond_3", "beyond_5", "beyond_custom", "is_pass", "reason"]
    assert rows(found, *names) == rows(single, *names)
    shape = {r.column: r.percentiles for r in found.collect()}
    assert shape["user_id"][0] == new.agg(F.min("user_id")).first()[0] and len(shape["value"]) == 11
