"""Aggregates attached to every row, and pivots.

None of these uses a window over the group key: a window would move whole rows and sort the
largest group in a single task. Grouped totals aggregate first (partial sums before the
shuffle, so a hot key costs one row per task) and join the small result back. Spark sees that
the joined side is unique per key, so it drops the join from branches that do not need it, and
adaptive execution broadcasts that side when its measured size allows or splits skewed
partitions of the row side when it does not (`spread` in `left_join` makes sure it can).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_number, quoted
from millrace.operators.joins import left_join

_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "ToSum": F.sum,
    "ToAvg": F.avg,
    "MAX": F.max,
    "SUM": F.sum,
    "AVG": F.avg,
}


def group_totals(
    df: DataFrame, wanted: Sequence[tuple[str, str, str]], keys: Sequence[str]
) -> DataFrame:
    """Sums or means per group on every row, from (kind, target, name) entries: one aggregate and
    one join for all of them. Rows with a null key keep null totals."""
    names = [name for _, _, name in wanted]
    if set(names) & set(keys):
        raise ValueError(f"totals {names} would overwrite the group keys {list(keys)}")
    values = [_AGGREGATES[kind](as_number(df, target)).alias(name) for kind, target, name in wanted]
    totals = df.groupBy(*[quoted(k) for k in keys]).agg(*values)
    return left_join(df.drop(*names), totals, keys, keys, spread=True)


def group_total(df: DataFrame, kind: str, target: str, keys: Sequence[str], naming: str) -> DataFrame:
    return group_totals(df, [(kind, target, naming)], keys)


def global_total(df: DataFrame, kind: str, target: str, naming: str) -> DataFrame:
    """Sum or mean of the whole column on every row, through a scalar subquery."""
    total = df.agg(_AGGREGATES[kind](as_number(df, target)).alias("total"))
    return df.withColumn(naming, total.scalar())


def most_frequent(df: DataFrame, target: str) -> DataFrame:
    """One row with the most frequent value: nulls ignored, lowest value on ties."""
    counts = df.where(quoted(target).isNotNull()).groupBy(quoted(target).alias("value")).count()
    return counts.agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))


def mode_value(df: DataFrame, target: str, naming: str) -> DataFrame:
    return df.withColumn(naming, most_frequent(df, target).scalar())


def pivot(
    df: DataFrame,
    target: str,
    column: str,
    aggregate: str,
    keys: Sequence[str] = (),
    values: Sequence[str] = (),
) -> DataFrame:
    """One output column per category of `target`; rows without a category are left out.

    Without keys the result is a single row. Pass `values` to save the job that looks for them.
    """
    rows = df.where(quoted(target).isNotNull())
    value = as_number(df, column) if aggregate != "MAX" else quoted(column)
    grouped = rows.groupBy(*[quoted(k) for k in keys])
    return grouped.pivot(target, list(values) or None).agg(_AGGREGATES[aggregate](value))
