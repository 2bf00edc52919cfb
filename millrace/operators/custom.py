"""User-defined statistics and checks, registered by name.

A statistic is an aggregate over a column; a check is an aggregate over the new rows that sees
the stored statistic and gives `struct<pass boolean, log string>`. Both are column expressions,
so they run with partial aggregation like any built-in. A statistic that needs Python is given
as three functions on partial states and never sees a whole column at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import quoted

_MERGE_FAN_IN = 256


@dataclass(frozen=True)
class PartialStatistic:
    """`start` turns a batch into a state, `merge` joins two states, `finish` gives the text."""

    start: Callable[[pd.Series], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], str]


Statistic = Callable[[Column], Column] | PartialStatistic
Check = Callable[[Column, Column], Column]

_statistics: dict[str, Statistic] = {}
_checks: dict[str, Check] = {}


def register_statistic(name: str, statistic: Statistic) -> None:
    _statistics[name] = statistic


def register_check(name: str, check: Check) -> None:
    _checks[name] = check


def _named(registry: dict[str, Any], name: str, what: str):
    if name not in registry:
        raise ValueError(f"no {what} is registered as {name!r}")
    return registry[name]


def named_statistic(name: str) -> Statistic:
    return _named(_statistics, name, "statistic")


def named_check(name: str) -> Check:
    return _named(_checks, name, "check")


def _merged(states: Iterable[bytes], merge: Callable[[Any, Any], Any]) -> bytes:
    return pickle.dumps(reduce(merge, map(pickle.loads, states)))


def _partial_statistic(df: DataFrame, column: str, statistic: PartialStatistic) -> DataFrame:
    start, merge, finish = statistic.start, statistic.merge, statistic.finish

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, seen = None, False
        for batch in batches:
            part = start(batch["value"])
            state, seen = (merge(state, part), True) if seen else (part, True)
        if seen:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def merge_states(states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": [_merged(states["state"], merge)]})

    def finish_states(states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"data": [finish(pickle.loads(_merged(states["state"], merge)))]})

    # one small state per partition, merged in two rounds
    states = df.select(quoted(column).alias("value")).mapInPandas(per_partition, "state binary")
    slot = F.pmod(F.xxhash64("state"), F.lit(_MERGE_FAN_IN))
    some = states.groupBy(slot).applyInPandas(merge_states, "state binary")
    return some.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(finish_states, "data string")


def custom_statistic(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row (column, data) with the statistic as text."""
    statistic = named_statistic(name)
    if isinstance(statistic, PartialStatistic):
        found = _partial_statistic(df, column, statistic)
    else:
        found = df.agg(statistic(quoted(column)).cast("string").alias("data"))
    return found.select(F.lit(column).alias("column"), "data")


def custom_check(df: DataFrame, column: str, name: str, data: Column) -> DataFrame:
    """One row (column, is_pass, log) from the registered check against the stored `data`."""
    check = named_check(name)
    verdict = df.agg(check(quoted(column), data).alias("verdict"))
    return verdict.select(
        F.lit(column).alias("column"),
        F.col("verdict").getField("pass").alias("is_pass"),
        F.col("verdict").getField("log").alias("log"),
    )
