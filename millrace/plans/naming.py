"""Column names across joins: pure planning on name lists, no Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from millrace.plans.spec import ColumnSpec


@dataclass(frozen=True)
class NamePlan:
    """Renames for both sides of one join, and the state to carry to the next join."""

    left: dict[str, str]
    right: dict[str, str]
    specs: tuple[ColumnSpec, ...]
    counters: dict[str, int]


def plan_names(
    left_columns: Sequence[str],
    right_columns: Sequence[str],
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    specs: Sequence[ColumnSpec] = (),
    counters: Mapping[str, int] | None = None,
) -> NamePlan:
    """Give every non-key column of the join a name of its own.

    A name suffixed by an earlier join gets the next number on the right side. Otherwise the
    first two entries of `specs` with that name stand for left and right: without renames they
    become `name_1` and `name_2`; a side with a rename becomes `*name_<entry>`, so that the
    rename of that entry finds exactly this column later.
    """
    keys = {*left_keys, *right_keys}
    seen_counts = dict(counters or {})
    out = list(specs)
    left_map: dict[str, str] = {}
    right_map: dict[str, str] = {}
    on_right = set(right_columns)

    shared = [c for c in left_columns if c in on_right and c not in keys]
    again = [c for c in right_columns if c in seen_counts and c not in shared and c not in right_keys]

    for name in shared + again:
        entries = [i for i, s in enumerate(out) if s.column == name][:2]

        if name in seen_counts:
            seen_counts[name] += 1
            right_map[name] = f"{name}_{seen_counts[name]}"
            if entries:
                out[entries[0]] = replace(out[entries[0]], column=right_map[name])
            continue

        sides = (left_map, right_map)
        marked = [(side, i) for side, i in enumerate(entries) if out[i].renames]
        if marked:
            for side, i in marked:
                sides[side][name] = f"*{name}_{i}"
        else:
            for side in (0, 1):
                sides[side][name] = f"{name}_{side + 1}"
            seen_counts[name] = 2
        for side, i in enumerate(entries):
            if name in sides[side]:
                out[i] = replace(out[i], column=sides[side][name])

    return NamePlan(left_map, right_map, tuple(out), seen_counts)
