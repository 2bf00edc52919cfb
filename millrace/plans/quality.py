"""Typed form of the JSON quality tasks."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


def chebyshev_multiplier(share: float) -> float:
    """How many deviations leave at most `share` of any distribution outside."""
    return round(math.sqrt(1 / share), 2)


@dataclass(frozen=True)
class CustomCheck:
    """Names of a registered statistic and of a registered check on it."""

    statistic: str
    check: str


@dataclass(frozen=True)
class QualitySpec:
    task_id: str
    name: str = ""
    key: str | None = None
    key_mark: int | str | None = None
    ts: str | None = None
    ts_mark: str | None = None
    numeric: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    custom: Mapping[str, CustomCheck] = field(default_factory=dict)
    chebyshev: Mapping[str, float] = field(default_factory=dict)
    moments: int = 0
    expect_count: int | None = None
    interval_hours: int = 24

    def resolved(self, columns: Sequence[str]) -> "QualitySpec":
        """The same task with every name spelled as in the table, whatever its case.

        A column has one check: listed more than once, it counts as numeric before category
        before custom.
        """
        exact = {c.lower(): c for c in columns}

        def name(wanted: str | None) -> str | None:
            if not wanted:
                return None
            if wanted.lower() not in exact:
                raise ValueError(f"no column {wanted!r} in {list(columns)}")
            return exact[wanted.lower()]

        numeric = tuple(dict.fromkeys(map(name, self.numeric)))
        category = tuple(c for c in dict.fromkeys(map(name, self.category)) if c not in numeric)
        custom = {name(c): v for c, v in self.custom.items()}
        return QualitySpec(
            task_id=self.task_id,
            name=self.name,
            key=name(self.key),
            key_mark=self.key_mark,
            ts=name(self.ts),
            ts_mark=self.ts_mark,
            numeric=numeric,
            category=category,
            custom={c: v for c, v in custom.items() if c not in numeric and c not in category},
            chebyshev={name(c): v for c, v in self.chebyshev.items()},
            moments=self.moments,
            expect_count=self.expect_count,
            interval_hours=self.interval_hours,
        )


def parse_quality(document: str | Mapping[str, Any]) -> QualitySpec:
    doc = json.loads(document) if isinstance(document, str) else document
    info = doc["TaskInfo"]
    settings = info.get("UserDefColSetting") or {}
    return QualitySpec(
        task_id=str(info["TaskID"]),
        name=info.get("TaskName") or "",
        key=info.get("IntPkCol") or None,
        key_mark=info.get("PkMax"),
        ts=info.get("TimestampCol") or None,
        ts_mark=info.get("TimestampMax"),
        numeric=tuple(info.get("IntColCheckList") or ()),
        category=tuple(info.get("StrColCheckList") or ()),
        custom={
            c: CustomCheck(settings[c]["StatisticFuncName"], settings[c]["DetectionFuncName"])
            for c in info.get("UserDefColCheckList") or ()
        },
        chebyshev=info.get("ChebyshevBound") or {},
        moments=info.get("moment") or 0,
        expect_count=info.get("ExpectCount") or None,
        interval_hours=info.get("Intervals") or 24,
    )
