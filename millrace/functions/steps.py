"""Running the column functions of a source in their declared order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from millrace.functions.columns import arithmetic, combine
from millrace.operators.split_merge import split_merge
from millrace.operators.totals import global_total, group_total, group_totals, mode_value, pivot
from millrace.plans.spec import Arithmetic, Combine, GroupTotal, Mode, Pivot, SplitMerge, Step


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    match step:
        case GroupTotal(group_by=()):
            return global_total(df, step.kind, step.target, step.naming)
        case GroupTotal():
            return group_total(df, step.kind, step.target, step.group_by, step.naming)
        case Mode():
            return mode_value(df, step.target, step.naming)
        case Combine():
            return combine(df, step.columns, step.separator, step.naming)
        case Pivot():
            # TargetValues may name columns and leave out categories: all categories of the data count
            return pivot(df, step.target, step.column, step.aggregate, step.group_by)
        case Arithmetic():
            return arithmetic(df, step.operator, step.columns, step.naming)
        case SplitMerge():
            return split_merge(df, step.new, step.old)
    raise TypeError(f"not a step: {step!r}")


def batches(steps: Sequence[Step]) -> list[list[Step]]:
    """Steps by ascending number (equal numbers keep the given order), with neighbouring totals
    over the same group put together unless one needs a column of another."""
    out: list[list[Step]] = []
    for step in sorted(steps, key=lambda s: s.step):
        last = out[-1] if out else []
        made = {s.naming for s in last if isinstance(s, GroupTotal)}
        joins_last = (
            isinstance(step, GroupTotal)
            and step.group_by
            and all(isinstance(s, GroupTotal) and s.group_by == step.group_by for s in last)
            and not made & {step.target, step.naming, *step.group_by}
        )
        if last and joins_last:
            last.append(step)
        else:
            out.append([step])
    return out


def apply_batch(df: DataFrame, batch: Sequence[Step]) -> DataFrame:
    if len(batch) == 1:
        return apply_step(df, batch[0])
    return group_totals(df, [(s.kind, s.target, s.naming) for s in batch], batch[0].group_by)


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return reduce(apply_batch, batches(steps), df)
