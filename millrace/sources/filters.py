"""JSON filters of document stores as Spark predicates."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES: dict[str, Callable[[Column, Any], Column]] = {
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
}
_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: ~c.eqNullSafe(v),
    "$in": lambda c, v: c.isin(list(v)),
    **{f"${name}": test for name, test in _RANGES.items()},
}

Lookup = Callable[[str], Column]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _document(filter_json: str | Mapping[str, Any]) -> Mapping[str, Any]:
    if isinstance(filter_json, str):
        return json.loads(filter_json) if filter_json.strip() else {}
    return filter_json


def search_filter(filter_json: str | Mapping[str, Any], lookup: Lookup = F.col) -> Column:
    """`term`, `range` and `bool.must` filters; an empty filter keeps every row."""
    doc = _document(filter_json)
    doc = doc.get("query", doc)

    def build(node: Mapping[str, Any]) -> Column:
        tests = []
        for kind, body in node.items():
            if kind == "term":
                for name, value in body.items():
                    wanted = value["value"] if isinstance(value, Mapping) else value
                    tests.append(lookup(name) == wanted)
            elif kind == "range":
                for name, limits in body.items():
                    tests += [_RANGES[limit](lookup(name), v) for limit, v in limits.items()]
            elif kind == "bool":
                unknown = set(body) - {"must", "filter"}
                if unknown:
                    raise ValueError(f"unsupported bool clauses {sorted(unknown)}")
                for clause in ("must", "filter"):
                    inner = body.get(clause) or []
                    tests += [build(n) for n in ([inner] if isinstance(inner, Mapping) else inner)]
            elif kind != "match_all":
                raise ValueError(f"unsupported filter {kind!r}")
        return _all(tests)

    return build(doc)


def find_filter(filter_json: str | Mapping[str, Any], lookup: Lookup = F.col) -> Column:
    """Equality and `$eq $ne $in $gt $gte $lt $lte` filters, all of which must hold."""
    tests = []
    for name, wanted in _document(filter_json).items():
        if name == "$and":
            tests += [find_filter(part, lookup) for part in wanted]
        elif name.startswith("$"):
            raise ValueError(f"unsupported filter {name!r}")
        elif isinstance(wanted, Mapping):
            for operator, value in wanted.items():
                if operator not in _OPERATORS:
                    raise ValueError(f"unsupported operator {operator!r}")
                tests.append(_OPERATORS[operator](lookup(name), value))
        else:
            tests.append(lookup(name).isNull() if wanted is None else lookup(name) == wanted)
    return _all(tests)
