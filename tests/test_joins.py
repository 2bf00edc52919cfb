"""Left joins on inline rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.operators.joins import hot_keys, left_join
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "n")], "id int, r string")
    return left, right


def test_unmatched_null_and_duplicate_keys(sides):
    out = left_join(*sides, ["k"], ["id"])
    assert out.columns == ["k", "l", "r"]
    assert rows(out) == [(None, "c", None), (1, "a", "x"), (1, "a", "y"), (2, "b", None), (4, "d", None)]


def test_null_safe(sides):
    assert (None, "c", "n") in rows(left_join(*sides, ["k"], ["id"], null_safe=True))


def test_types_are_aligned(spark):
    left = spark.createDataFrame([("1",), ("1.0",), ("x",)], "k string")
    assert rows(left_join(left, spark.createDataFrame([(1, "m")], "k int, v string"), ["k"], ["k"])) == [("1", "m"), ("1.0", None), ("x", None)]
    whole = spark.createDataFrame([(1,), (2,)], "k bigint")
    assert rows(left_join(whole, spark.createDataFrame([(1.0, "m")], "f double, v string"), ["k"], ["f"])) == [(1, "m"), (2, None)]


def test_long_keys_meet_only_equal_doubles(spark):
    whole = spark.createDataFrame([(2**53,), (2**53 + 1,), (7,), (2**63 - 1,)], "k bigint")
    real = spark.createDataFrame([(float(2**53), "m"), (7.5, "n"), (float(2**63), "o"), (float("nan"), "p"), (None, "q")], "f double, v string")
    expected = [(7, None), (2**53, "m"), (2**53 + 1, None), (2**63 - 1, None)]
    assert rows(left_join(whole, real, ["k"], ["f"])) == expected


def test_self_join_and_shared_names(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    out = left_join(df, df, ["a"], ["b"])
    assert out.columns == ["a_x", "b", "a_y"] and rows(out) == [(1, 2, None), (2, 3, 1)]


def test_two_keys(spark):
    left = spark.createDataFrame([(1, "p"), (1, "q")], "a int, b string")
    right = spark.createDataFrame([("q", 1, 9)], "y string, x int, v int")
    assert rows(left_join(left, right, ["a", "b"], ["x", "y"])) == [(1, "p", None), (1, "q", 9)]


def test_keys_must_pair_up(sides):
    with pytest.raises(ValueError):
        left_join(*sides, ["k"], [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=20))
def test_unique_right_keys_keep_the_row_count(spark, keys):
    left = spark.createDataFrame([(k,) for k in keys], "k int")
    right = spark.createDataFrame([(i, str(i)) for i in range(4)], "id int, v string")
    assert left_join(left, right, ["k"], ["id"]).count() == len(keys)


def test_hot_keys_are_found_and_never_missed(spark):
    left = spark.range(0, 30_000, 1, 9).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 10 = 1 THEN NULL ELSE id END AS k", "id AS v")
    right = spark.range(20).selectExpr("cast(id AS double) AS id", "id AS r")
    hashes = {k: left.select(F.xxhash64(F.lit(k).cast("long"))).first()[0] for k in (7, None)}
    found = hot_keys(left, right, ["k"], ["id"], share=1 / 20)
    assert set(hashes.values()) <= set(found) and len(found) <= 20


@pytest.mark.parametrize("null_safe", [False, True])
def test_salting_changes_no_rows(spark, null_safe):
    left = spark.createDataFrame(
        [(k, v, {"m": 1}) for k in (1, 2, None) for v in ("a", "a", None) for _ in range(5)] + [(5, "z", None)],
        "k int, __v string, m map<string,int>",
    )
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "n"), (9, "q")], "id string, r string")
    hot = hot_keys(left, right, ["k"], ["id"], share=1 / 4)
    plain = left_join(left, right, ["k"], ["id"], null_safe)
    salted = left_join(left, right, ["k"], ["id"], null_safe, hot=hot, salts=5)
    assert hot and salted.columns == plain.columns and rows(salted) == rows(plain)


def test_an_array_of_hot_keys_of_two_columns(spark):
    left = spark.range(900).selectExpr("IF(id % 2 = 0, 1, id) AS a", "IF(id % 2 = 0, 'x', 'y') AS b", "id")
    right = spark.range(900).selectExpr("id AS c", "IF(id = 1, 'x', 'y') AS d", "id * 2 AS r")
    hot = hot_keys(left, right, ["a", "b"], ["c", "d"], share=1 / 4)
    assert rows(left_join(left, right, ["a", "b"], ["c", "d"], hot=hot)) == rows(left_join(left, right, ["a", "b"], ["c", "d"]))
