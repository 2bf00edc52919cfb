"""Marks of tasks in the state of a stream: rows at or below the mark of earlier batches are late.

The state of a task is the greatest time of its rows in all earlier micro-batches. It lives in the state
store, so it moves with the checkpoint: a run that is cut short starts again at the same mark and splits its
rows in the same way, and tasks of one stream have their own marks.

A task may have most of the rows. So its rows are dealt to `slots` states, and every slot learns the mark of
the whole task: each input partition adds one row for its greatest time to every slot. A key then costs a
few small rows for each partition, and no slot waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.columns import quoted

SLOTS = 8
_TASK, _SLOT, _AT, _MARKER = "__task", "__slot", "__at", "__marker"


def flag_by_mark(stream: DataFrame, task: str, ts: str, slots: int = SLOTS) -> DataFrame:
    """All rows with `is_late`: at or below the greatest time of the task in earlier micro-batches.

    A null task is a task. A null time is never late and moves no mark.
    """
    plain = (T.StringType, T.DoubleType, T.FloatType, T.BooleanType, T.StructType, T.ArrayType, T.MapType)
    # pandas keeps no nulls among whole numbers and no early dates: these pass through it as text
    as_text = [f.name for f in stream.schema if not isinstance(f.dataType, plain)]
    names = stream.columns
    at = F.unix_micros(quoted(ts).cast("timestamp")).cast("double")  # micros of 285 years are whole doubles
    rows = stream.select(
        *[quoted(c).cast("string").alias(c) if c in as_text else quoted(c) for c in names],
        F.to_json(F.struct(quoted(task).alias("t"))).alias(_TASK),
        at.alias(_AT),
        F.lit(0).alias(_SLOT),
        F.lit(False).alias(_MARKER),
    )

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict[str, tuple[float, pd.DataFrame]] = {}
        count = 0
        for batch in batches:
            for key, part in batch.groupby(_TASK):
                top = part[_AT].max()
                if not pd.isna(top) and (key not in tops or top > tops[key][0]):
                    tops[key] = (top, part.iloc[[0]])
            batch[_SLOT] = [(count + i) % slots for i in range(len(batch))]
            count += len(batch)
            yield batch
        for top, row in tops.values():
            markers = pd.concat([row] * slots)
            markers[_AT], markers[_SLOT], markers[_MARKER] = top, list(range(slots)), True
            yield markers

    def nullable(fields) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def split(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        top = mark
        for batch in batches:
            new = batch.loc[batch[_MARKER], _AT].max()
            if not pd.isna(new):
                top = new if top is None else max(top, new)
            own = batch.loc[~batch[_MARKER]]
            if len(own):
                late = own[_AT] <= mark if mark is not None else pd.Series(False, own.index)
                yield own[names].assign(is_late=late.astype(bool))
        if top is not None:
            state.update((float(top),))

    out = nullable([f for f in rows.schema if f.name in names])
    out.add("is_late", T.BooleanType())
    dealt = rows.mapInPandas(deal, nullable(rows.schema)).groupBy(_TASK, _SLOT)
    found = dealt.applyInPandasWithState(split, out, "mark double", "append", GroupStateTimeout.NoTimeout)
    return found.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in stream.schema], "is_late")


def split_outputs(out: str, spark) -> tuple[DataFrame, DataFrame]:
    """On-time and late rows of what `drain(..., partition_by=["is_late"])` wrote."""
    written = spark.read.parquet(out)
    flag = F.col("is_late").cast("boolean")  # the names of folders are read as text
    return tuple(written.where(flag == late).drop("is_late") for late in (False, True))
