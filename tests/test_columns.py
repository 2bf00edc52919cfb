"""Column functions on inline rows: nulls, ties, empty tables, zero divisors."""

import pytest

from conftest import rows
from millrace.functions.columns import apply_types, arithmetic, combine, rename_columns
from millrace.functions.steps import apply_steps
from millrace.operators.split_merge import first_per_key, split_merge
from millrace.operators.totals import global_total, group_total, mode_value, pivot
from millrace.plans.spec import Arithmetic, ColumnSpec, Combine


@pytest.fixture(scope="module")
def table(spark):
    data = [("a", 1.0, "x"), ("a", 2.0, "y"), (None, 4.0, "x"), ("b", None, None), ("a", 5.0, "y")]
    return spark.createDataFrame(data, "k string, v double, c string")


def test_group_sum_keeps_all_rows_and_order(table):
    out = group_total(table, "ToSum", "v", ["k"], "s")
    assert out.columns == ["k", "v", "c", "s"]
    assert rows(out) == rows(out.sparkSession.createDataFrame(
        [("a", 1.0, "x", 8.0), ("a", 2.0, "y", 8.0), (None, 4.0, "x", None), ("b", None, None, None), ("a", 5.0, "y", 8.0)], out.schema))


def test_group_total_replaces_a_column_but_not_its_key(table):
    out = group_total(table, "ToAvg", "v", ["k"], "v")
    assert set(rows(out, "k", "v")) == {("a", 8.0 / 3), (None, None), ("b", None)}
    with pytest.raises(ValueError):
        group_total(table, "ToSum", "v", ["k"], "k")


def test_text_is_read_as_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("2",), (None,)], "t string")
    assert rows(global_total(df, "ToSum", "t", "s"), "s")[0] == (3.5,)


def test_global_totals_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert rows(global_total(df, "ToSum", "v", "s"), "s") == [(None,), (None,)]
    empty = df.limit(0)
    assert global_total(empty, "ToAvg", "v", "s").collect() == []
    assert group_total(empty, "ToSum", "v", ["v"], "s").collect() == []


def test_mode_ignores_nulls_and_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,), ("b",), ("a",), ("c",)], "c string")
    assert set(rows(mode_value(df, "c", "m"), "m")) == {("a",)}
    assert set(rows(mode_value(df.where("c is null"), "c", "m"), "m")) == {(None,)}


def test_combine_keeps_separators_next_to_nulls(spark):
    df = spark.createDataFrame([(1, None, "z"), (None, None, None)], "a int, b string, c string")
    assert rows(combine(df, ["a", "b", "c"], "-", "t"), "t") == [("--",), ("1--z",)]


@pytest.mark.parametrize("operator,expected", [("ADD", 9.0), ("SUB", 3.0), ("MUL", 12.0), ("DIV", 3.0)])
def test_arithmetic(spark, operator, expected):
    df = spark.createDataFrame([("6", 2, 1.0)], "a string, b int, c double")
    assert arithmetic(df, operator, ["a", "b", "c"], "r").first()["r"] == expected


def test_arithmetic_edge_cases(spark):
    df = spark.createDataFrame([("1", 0.0), ("x", 1.0), (None, 1.0)], "a string, b double")
    assert rows(arithmetic(df, "DIV", ["a", "b"], "r"), "r") == [(None,)] * 3
    assert arithmetic(df, "ADD", ["a"], "r").columns == ["a", "b"]
    assert arithmetic(df, "ADD", ["a", "b"], "r").schema["a"].dataType.simpleString() == "string"


def test_pivot_drops_null_categories(table):
    out = pivot(table, "c", "v", "SUM", ["k"])
    assert out.columns == ["k", "x", "y"]
    assert rows(out) == [(None, 4.0, None), ("a", 1.0, 7.0)]


def test_pivot_without_group_is_one_row(table):
    assert rows(pivot(table, "c", "v", "MAX")) == [(4.0, 5.0)]
    assert pivot(table, "c", "v", "AVG", values=["y", "z"]).collect()[0].asDict() == {"y": 3.5, "z": None}


def test_pivot_totals_equal_group_sums(table):
    per_key = {k: (x or 0) + (y or 0) for k, x, y in rows(pivot(table, "c", "v", "SUM", ["k"]))}
    sums = dict(rows(group_total(table.where("c is not null"), "ToSum", "v", ["k"], "s").where("k is not null"), "k", "s"))
    assert per_key["a"] == sums["a"]


def test_split_merge(spark):
    df = spark.createDataFrame([(3, "n1", "o1"), (1, "n1", "o2"), (2, None, "o3")], "id int, new string, old string")
    out = split_merge(df, "new", "old", ["id"])
    assert rows(out) == rows(df.union(spark.createDataFrame([(1, "n1", "n1"), (2, None, None)], df.schema)))


def test_first_per_key_does_not_depend_on_layout(spark):
    df = spark.range(2000).selectExpr("id % 7 AS k", "id % 3 AS a", "id")
    expected = rows(first_per_key(df, ["k"], ["a"]))
    assert all(rows(first_per_key(df.repartition(n), ["k"], ["a"])) == expected for n in (1, 17))


def test_steps_run_by_number(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    out = apply_steps(df, [Combine(2, ("a", "r"), "|", "t"), Arithmetic(1, "ADD", ("a", "b"), "r")])
    assert out.first()["t"] == "1.0|3.0"


def test_rename_and_types(spark):
    df = spark.createDataFrame([("7", "x")], ["*a_0", "b.c"])
    specs = [ColumnSpec("*a_0", "INTEGER", renames=True, new_name="n"), ColumnSpec("b.c", "DOUBLE")]
    out = apply_types(rename_columns(df, specs), specs)
    assert out.columns == ["n", "b.c"] and rows(out) == [(7, None)]


def test_renames_apply_in_list_order(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    specs = [ColumnSpec("a", renames=True, new_name="b"), ColumnSpec("b", renames=True, new_name="c")]
    assert rename_columns(df, specs).columns == ["c"]


def test_neighbouring_totals_share_one_join(spark):
    from millrace.functions.steps import batches
    from millrace.plans.spec import GroupTotal

    total = lambda step, kind, target, name, key="k": GroupTotal(kind, step, target, name, (key,))
    steps = [
        total(1, "ToSum", "v", "s"),
        total(2, "ToAvg", "v", "m"),
        total(3, "ToSum", "s", "of_s"),
        total(4, "ToSum", "v", "by_c", "c"),
        GroupTotal("ToSum", 5, "v", "all", ()),
    ]
    assert [len(b) for b in batches(steps)] == [2, 1, 1, 1]
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("b", 5.0, "x")], "k string, v double, c string")
    out = apply_steps(df, steps)
    assert out.columns == ["k", "v", "c", "s", "m", "of_s", "by_c", "all"]
    assert rows(out) == [("a", 1.0, "x", 4.0, 2.0, 8.0, 6.0, 9.0), ("a", 3.0, "y", 4.0, 2.0, 8.0, 3.0, 9.0), ("b", 5.0, "x", 5.0, 5.0, 5.0, 6.0, 9.0)]
