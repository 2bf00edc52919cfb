"""Typed form of the JSON task documents.

Everything is validated while parsing, so a bad document fails before any Spark job starts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, Mapping

# Source kinds, function kinds and operator names used in task documents.
SQL_KINDS = ("mysql", "mssql", "phoenix", "oracle")
DOCUMENT_KINDS = ("elasticsearch", "mongodb")
FILE_KINDS = ("csv", "hds", "excel")
OTHER_KINDS = ("cassandra", "hbase")
EMPTY_KINDS = (None, "None", "dataframe")
ARITHMETIC_OPERATORS = ("ADD", "SUB", "MUL", "DIV")
PIVOT_AGGREGATES = ("MAX", "SUM", "AVG")
GENERATED_KEY = "AUTOTIMESTAMP_"


def flag(value: Any) -> bool:
    """Task documents spell booleans as the texts "True" and "False"."""
    return value is True or value == "True"


@dataclass(frozen=True)
class GroupTotal:
    """Sum or mean of a column, per group or over the whole table, added to every row."""

    kind: str
    step: int
    target: str
    naming: str
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mode:
    step: int
    target: str
    naming: str
    kind: str = "ToMode"


@dataclass(frozen=True)
class Combine:
    step: int
    columns: tuple[str, ...]
    separator: str
    naming: str
    kind: str = "ToColumnCombine"


@dataclass(frozen=True)
class Pivot:
    step: int
    target: str
    values: tuple[str, ...]
    column: str
    aggregate: str
    group_by: tuple[str, ...] = ()
    kind: str = "ToPivot"


@dataclass(frozen=True)
class Arithmetic:
    step: int
    operator: str
    columns: tuple[str, ...]
    naming: str
    kind: str = "ToArithmetic"


@dataclass(frozen=True)
class SplitMerge:
    step: int
    new: str
    old: str
    kind: str = "SplitMerge"


Step = GroupTotal | Mode | Combine | Pivot | Arithmetic | SplitMerge


@dataclass(frozen=True)
class Source:
    db_type: str | None
    ip: str = ""
    port: str = ""
    user_name: str = ""
    password: str = field(default="", repr=False)
    db_name: str = ""
    table_name: str = ""
    columns: tuple[str, ...] = ()
    statement: str = ""
    functions: tuple[Step, ...] = ()
    specials: tuple[Step, ...] = ()

    @property
    def is_empty(self) -> bool:
        return self.db_type in EMPTY_KINDS


@dataclass(frozen=True)
class MergeKeys:
    left: tuple[str, ...]
    right: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.left or len(self.left) != len(self.right):
            raise ValueError(f"join keys do not pair up: {self.left} and {self.right}")


@dataclass(frozen=True)
class ColumnSpec:
    column: str
    type: str = ""
    is_key: bool = False
    renames: bool = False
    new_name: str = ""

    @property
    def output_name(self) -> str:
        return self.new_name if self.renames else self.column


@dataclass(frozen=True)
class TaskSpec:
    task_id: str
    table_name: str
    sources: tuple[Source, ...]
    merges: tuple[MergeKeys, ...] = ()
    columns: tuple[ColumnSpec, ...] = ()
    store_table: bool = False
    append: bool = False
    user: str = ""


def _group_by(item: Mapping[str, Any]) -> tuple[str, ...]:
    group = item.get("GroupBy") or {}
    if not flag(group.get("IsEnable")):
        return ()
    return tuple(group["TargetColumnList"])


def _in_order(items: list[Mapping[str, Any]], name: str) -> tuple[str, ...]:
    return tuple(i[name] for i in sorted(items, key=lambda i: i["Order"]))


def _total(kind: str):
    def parse(item):
        return GroupTotal(kind, item["Step"], item["TargetColumn"], item["Naming"], _group_by(item))

    return parse


def _mode(item):
    return Mode(item["Step"], item["TargetColumn"], item["Naming"])


def _combine(item):
    columns = _in_order(item["TargetColumnList"], "TargetColumn")
    return Combine(item["Step"], columns, item["Separator"], item["Naming"])


def _pivot(item):
    aggregate = item["AggregateFunction"]
    if aggregate not in PIVOT_AGGREGATES:
        raise ValueError(f"unknown pivot aggregate {aggregate!r}")
    if len(item["AggregateColumn"]) != 1:
        raise ValueError("a pivot aggregates one column; add a pivot for each further one")
    return Pivot(
        item["Step"],
        item["TargetColumn"],
        tuple(item.get("TargetValues") or ()),
        item["AggregateColumn"][0]["Column"],
        aggregate,
        _group_by(item),
    )


def _arithmetic(item):
    operator = item["Operator"]
    if operator not in ARITHMETIC_OPERATORS:
        raise ValueError(f"unknown arithmetic operator {operator!r}")
    columns = _in_order(item["TargetColumnList"], "Column")
    return Arithmetic(item["Step"], operator, columns, item["Naming"])


def _split_merge(item):
    target = item["TargetColumn"]
    return SplitMerge(item["Step"], target["NewLot"], target["OldLot"])


# The order of this table is the order in which equal steps run.
_FUNCTION_PARSERS = {
    "ToSum": _total("ToSum"),
    "ToAvg": _total("ToAvg"),
    "ToMode": _mode,
    "ToColumnCombine": _combine,
    "ToPivot": _pivot,
    "ToArithmetic": _arithmetic,
}
_SPECIAL_PARSERS = {"SplitMerge": _split_merge}


def _parse_steps(section: Mapping[str, Any] | None, parsers: Mapping[str, Any]) -> tuple[Step, ...]:
    section = section or {}
    steps = [
        parse(item)
        for kind, parse in parsers.items()
        for item in section.get(kind) or ()
        if flag(item.get("IsEnable"))
    ]
    return tuple(sorted(steps, key=lambda s: s.step))


def _parse_source(doc: Mapping[str, Any]) -> Source:
    connection = doc.get("ConnectionInfo") or {}
    info = doc.get("DbInfo") or {}
    condition = doc.get("Condition") or {}
    kind = connection.get("DbType")
    known = SQL_KINDS + DOCUMENT_KINDS + FILE_KINDS + OTHER_KINDS + EMPTY_KINDS
    if kind not in known:
        raise ValueError(f"unsupported source kind {kind!r}")
    return Source(
        db_type=kind,
        ip=str(connection.get("Ip") or ""),
        port=str(connection.get("Port") or ""),
        user_name=connection.get("UserName") or "",
        password=connection.get("Password") or "",
        db_name=info.get("DbName") or "",
        table_name=info.get("TableName") or "",
        columns=tuple(info.get("ColumnsName") or ()),
        statement=doc.get("SqlStatement") or "",
        functions=_parse_steps(condition.get("FunctionCondition"), _FUNCTION_PARSERS),
        specials=_parse_steps(condition.get("SpecialFunction"), _SPECIAL_PARSERS),
    )


def _parse_column(doc: Mapping[str, Any]) -> ColumnSpec:
    rename = doc.get("Rename") or {}
    return ColumnSpec(
        column=doc["Column"],
        type=doc.get("Type") or "",
        is_key=flag(doc.get("IsPrimaryKey")),
        renames=flag(rename.get("IsEnable")),
        new_name=rename.get("NewName") or "",
    )


def parse_task(document: str | Mapping[str, Any]) -> TaskSpec:
    doc = json.loads(document) if isinstance(document, str) else document
    action = doc.get("TaskAction") or {}
    sources = tuple(_parse_source(d) for d in doc["Base"]["Databases"])
    if not sources or sources[0].is_empty:
        raise ValueError("a task needs a first source")
    merges = tuple(
        MergeKeys(tuple(left["MergeColumnName"]), tuple(right["MergeColumnName"]))
        for left, right in (
            (pair[0], pair[1])
            for i, pair in enumerate((doc.get("Merge") or {}).get("Tables") or ())
            if i + 1 < len(sources) and not sources[i + 1].is_empty
        )
    )
    if len(merges) != sum(not s.is_empty for s in sources[1:]):
        raise ValueError("each source after the first needs a merge")
    result = doc.get("ResultParameterSetting") or {}
    return TaskSpec(
        task_id=str(action.get("TaskId") or ""),
        table_name=action.get("TableName") or "",
        sources=sources,
        merges=merges,
        columns=tuple(_parse_column(c) for c in result.get("ColumnTypeList") or ()),
        store_table=flag(action.get("Phoenix")),
        append=flag(action.get("AppendPhoenix")),
        user=action.get("SubmittedUser") or "",
    )
