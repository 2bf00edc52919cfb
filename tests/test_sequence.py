"""Numbering, generated keys, samples and counters."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import sequence
from millrace.operators.incremental import (
    advance_marks,
    hash_sample,
    rows_above_key,
    rows_after,
    run_counters,
    run_iterations,
    sample_rows,
    size_probe,
)
from millrace.operators.model import hash_split
from millrace.operators.parts import list_parts
from millrace.operators.sequence import generated_key, running_number

BASE = "2024-03-01 00:00:00"


def test_every_row_gets_its_own_key(spark):
    df = spark.range(15000)
    out = generated_key(df, "made", BASE, unique=["id"])
    found = out.agg(F.count("*"), F.count_distinct("made"), F.min("made"), F.max("made")).first()
    assert tuple(found) == (15000, 15000, "2024-03-01 00:00:00.000000", "2024-03-01 00:00:00.014999")


def test_copies_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sequence, "_COPIES_PER_PART", 100)
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id % 50) AS a", "cast(null AS string) AS b")
    out = generated_key(df, "made", BASE)
    found = out.agg(F.count("*"), F.count_distinct("made"), F.max("made")).first()
    assert tuple(found) == (3000, 3000, "2024-03-01 00:00:00.002999")
    assert rows(out.groupBy("a").count()) == rows(df.groupBy("a").count())


def test_keys_do_not_depend_on_layout(spark):
    df = spark.range(500).selectExpr("id % 100 AS a", "id % 5 AS b")
    assert rows(generated_key(df.repartition(1), "m", BASE)) == rows(generated_key(df.repartition(17), "m", BASE))


def test_maps_need_identifying_columns(spark):
    df = spark.sql("SELECT map('a', 1) AS m, 1 AS id")
    with pytest.raises(ValueError):
        generated_key(df, "made", BASE)
    assert generated_key(df, "made", BASE, unique=["id"]).count() == 1


def test_running_number_with_a_hot_key(spark):
    df = spark.range(4000).selectExpr("IF(id % 3 > 0, null, id % 4) AS k", "id AS at")
    out = running_number(df, ["k"], F.col("at") / 100, ["at"], "n")
    seen = {}
    for k, at, n in sorted(rows(out, "k", "at", "n"), key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        assert n == seen[k]


def test_iterations_and_counters(spark):
    data = [(1, "2024-01-01 00:10:00", True, "Auto"), (1, "2024-01-01 05:00:00", False, "Auto"),
            (1, "2024-01-01 03:00:00", True, "Manual"), (2, "2024-01-02 00:00:00", True, "Auto")]
    df = spark.createDataFrame(data, "task_id int, at string, validation_result boolean, execution_type string")
    df = df.withColumn("at", F.col("at").cast("timestamp"))
    assert rows(run_iterations(df, "at"), "task_id", "iteration") == [(1, -1), (1, 1), (1, 2), (2, 1)]
    assert rows(run_counters(df, expect=2)) == [(1, 3, 2, 1, False), (2, 1, 1, 0, True)]


def test_marks(spark):
    marks = spark.createDataFrame([(1, 10), (2, 5)], "task_id int, mark int")
    probes = spark.createDataFrame([(1, 8), (3, 4), (2, 9)], "task_id int, key_max int")
    assert rows(advance_marks(marks, probes)) == [(1, 10), (2, 9), (3, 4)]
    assert rows(advance_marks(marks, probes, manual=True)) == [(1, 10), (2, 5)]


def test_new_rows_and_probe(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00.5' + make_interval(0,0,0,0,0,0,id) AS at FROM range(5)")
    assert rows_above_key(df, "id", 2).count() == 2 and rows_above_key(df, "id", None).count() == 5
    assert rows_after(df, "at", "2024-01-01 00:00:03.5").count() == 1
    assert rows_after(df, "at", "2024-01-01 00:00:03.5", whole_seconds=True).count() == 2
    assert tuple(size_probe(df, "id").first()) == (5, 0, 4)
    assert tuple(size_probe(df.limit(0), ts="at").first()) == (0, None, None)
    assert tuple(size_probe(df).first()) == (5,)


def test_marks_are_read_in_no_zone(spark):
    from datetime import datetime

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' AS at")
        assert rows_after(df, "at", datetime(2024, 1, 1, 11, 59)).count() == 1
        assert rows_after(df, "at", datetime(2024, 1, 1, 12, 0)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_samples(spark):
    df = spark.range(20000)
    part = hash_sample(df, "id", 10)
    assert 1700 < part.count() < 2300 and rows(part) == rows(hash_sample(df.repartition(3), "id", 10))
    assert sample_rows(df, "id", 500).count() == 500 and sample_rows(df, "id", 30000).count() == 20000
    assert rows(sample_rows(df, "id", 500)) == rows(sample_rows(df.repartition(5), "id", 500))
    assert 15500 < hash_split(df, "id").where("is_train").count() < 16500


def test_long_lists_are_cut_and_nothing_is_lost(spark):
    pairs = spark.range(1000).selectExpr("IF(id < 900, 'hot', cast(id AS string)) AS k", "cast(id AS string) AS item")
    out = list_parts(pairs, ["k"], "item", "items", limit=50)
    hot = out.where("k = 'hot'").collect()
    assert len(hot) > 10 and max(len(r["items"]) for r in hot) < 100
    assert sorted(i for r in hot for i in r["items"]) == sorted(str(i) for i in range(900))
    assert out.where("k <> 'hot'").count() == 100
