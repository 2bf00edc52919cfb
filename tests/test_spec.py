"""Parsing task documents and planning names, without Spark."""

import json

import pytest

from millrace.plans.naming import plan_names
from millrace.plans.quality import chebyshev_multiplier, parse_quality
from millrace.plans.spec import ColumnSpec, GroupTotal, MergeKeys, Mode, parse_task


def source(kind="mysql", table="t", functions=None, **extra):
    doc = {
        "ConnectionInfo": {"DbType": kind, "Ip": "h", "Port": 1, "UserName": "u", "Password": "secret"},
        "DbInfo": {"DbName": "d", "TableName": table, "ColumnsName": []},
        "SqlStatement": "",
    }
    if functions is not None:
        doc["Condition"] = {"FunctionCondition": functions}
    return doc | extra


def task(sources, merges=()):
    return {"TaskAction": {"TaskId": 5, "TableName": "out"}, "Base": {"Databases": sources}, "Merge": {"Tables": list(merges)}}


def pair(left, right):
    return [{"MergeColumnName": left}, {"MergeColumnName": right}]


def test_steps_are_ordered_and_ties_keep_kind_order():
    total = {"IsEnable": "True", "Step": 2, "TargetColumn": "a", "Naming": "s"}
    functions = {
        "ToMode": [{"IsEnable": "True", "Step": 1, "TargetColumn": "a", "Naming": "m1"}, {"IsEnable": "True", "Step": 2, "TargetColumn": "a", "Naming": "m2"}],
        "ToSum": [total, total | {"IsEnable": "False", "Step": 0}],
    }
    steps = parse_task(task([source(functions=functions)])).sources[0].functions
    assert [(type(s), s.step) for s in steps] == [(Mode, 1), (GroupTotal, 2), (Mode, 2)]


def test_all_group_keys_count_and_only_when_enabled():
    group = {"IsEnable": "True", "TargetColumnList": ["k", "other"]}
    item = {"IsEnable": "True", "Step": 1, "TargetColumn": "a", "Naming": "s", "GroupBy": group}
    off = item | {"GroupBy": {"IsEnable": "False", "TargetColumnList": ["k"]}}
    steps = parse_task(task([source(functions={"ToAvg": [item, off]})])).sources[0].functions
    assert [s.group_by for s in steps] == [("k", "other"), ()]


def test_operands_follow_their_order():
    items = [{"Column": "b", "Order": 2}, {"Column": "a", "Order": 1}]
    functions = {"ToArithmetic": [{"IsEnable": "True", "Step": 1, "Operator": "SUB", "TargetColumnList": items, "Naming": "n"}]}
    assert parse_task(json.dumps(task([source(functions=functions)]))).sources[0].functions[0].columns == ("a", "b")


def test_missing_condition_and_merges():
    spec = parse_task(task([source()]))
    assert spec.sources[0].functions == () and spec.merges == ()


def test_empty_second_source_skips_its_merge():
    spec = parse_task(task([source(), source("None"), source(table="u")], [pair(["a"], ["b"]), pair(["c"], ["d"])]))
    assert spec.merges == (MergeKeys(("c",), ("d",)),)


@pytest.mark.parametrize(
    "bad",
    [
        task([source("access")]),
        task([source("None")]),
        task([source(), source()], [pair(["a", "b"], ["c"])]),
        task([source(functions={"ToArithmetic": [{"IsEnable": "True", "Step": 1, "Operator": "POW", "TargetColumnList": [], "Naming": "n"}]})]),
    ],
)
def test_bad_documents_fail_while_parsing(bad):
    with pytest.raises(ValueError):
        parse_task(bad)


def test_password_is_not_shown():
    assert "secret" not in repr(parse_task(task([source()])))


def spec(column, new_name=None):
    return ColumnSpec(column, renames=new_name is not None, new_name=new_name or "")


def test_names_without_renames_are_numbered():
    plan = plan_names(["k", "x"], ["k2", "x"], ["k"], ["k2"], [spec("x"), spec("x")])
    assert plan.left == {"x": "x_1"} and plan.right == {"x": "x_2"}
    assert [s.column for s in plan.specs] == ["x_1", "x_2"] and plan.counters == {"x": 2}


def test_third_source_continues_the_numbers():
    plan = plan_names(["k", "x_1", "x_2"], ["k2", "x"], ["k"], ["k2"], [spec("x_1"), spec("x_2"), spec("x")], {"x": 2})
    assert plan.left == {} and plan.right == {"x": "x_3"} and plan.counters == {"x": 3}
    assert [s.column for s in plan.specs] == ["x_1", "x_2", "x_3"]


@pytest.mark.parametrize("side", [0, 1])
def test_one_rename_marks_only_its_side(side):
    specs = [spec("y"), spec("x"), spec("x")]
    specs[1 + side] = spec("x", "new")
    plan = plan_names(["k", "x"], ["k", "x"], ["k"], ["k"], specs)
    marked = {"x": f"*x_{1 + side}"}
    assert (plan.left, plan.right) == ((marked, {}) if side == 0 else ({}, marked))
    assert plan.specs[1 + side].column == marked["x"] and plan.specs[1 + side].output_name == "new"


def test_two_renames_mark_both_sides():
    plan = plan_names(["x"], ["x"], ["a"], ["b"], [spec("x", "p"), spec("x", "q")])
    assert plan.left == {"x": "*x_0"} and plan.right == {"x": "*x_1"} and plan.counters == {}


def test_keys_never_conflict_and_inputs_are_not_changed():
    specs, counters = [spec("k")], {"k": 2}
    plan = plan_names(["k", "a"], ["k", "b"], ["k"], ["k"], specs, counters)
    assert plan.left == {} and plan.right == {} and specs == [spec("k")] and counters == {"k": 2}


def test_quality_document():
    found = parse_quality({"TaskInfo": {"TaskID": 3, "IntPkCol": "", "TimestampCol": "ts", "IntColCheckList": ["A"], "ChebyshevBound": {"A": 0.04}}})
    assert found.key is None and found.ts == "ts"
    assert found.resolved(["a", "TS"]).numeric == ("a",) and found.resolved(["a", "TS"]).chebyshev == {"a": 0.04}
    with pytest.raises(ValueError):
        found.resolved(["b", "ts"])


def test_chebyshev_multiplier():
    assert chebyshev_multiplier(0.05) == 4.47 and chebyshev_multiplier(0.04) == 5.0


def test_a_source_without_merge_is_refused():
    with pytest.raises(ValueError, match="needs a merge"):
        parse_task({"Base": {"Databases": [source(), source()]}})
