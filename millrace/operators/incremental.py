"""New rows above a stored mark, how many there are, samples, marks and run counters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import quoted
from millrace.operators.sequence import running_number

SAMPLE_ABOVE = 100_000  # fixed value: row count above which a check may use a sample


def rows_above_key(df: DataFrame, key: str, mark: int | None) -> DataFrame:
    return df if mark is None else df.where(quoted(key) > F.lit(mark).cast(df.schema[key].dataType))


def mark_value(df: DataFrame, ts: str, mark: Any) -> Column:
    """A stored mark in the type of the time column.

    For columns without a zone, a Python time is taken as it reads, not shifted between the zones
    of the driver process and of the session.
    """
    kind = df.schema[ts].dataType
    if isinstance(mark, datetime) and isinstance(kind, T.TimestampNTZType):
        mark = mark.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(mark).cast(kind)


def rows_after(df: DataFrame, ts: str, mark: Any | None, whole_seconds: bool = False) -> DataFrame:
    """Rows later than `mark`; `whole_seconds` cuts the mark first, which re-reads its second."""
    if mark is None:
        return df
    bound = mark_value(df, ts, mark)
    if whole_seconds:
        bound = F.date_trunc("second", bound).cast(df.schema[ts].dataType)
    return df.where(quoted(ts) > bound)


def size_probe(df: DataFrame, key: str | None = None, ts: str | None = None) -> DataFrame:
    """One row: number of rows, and the range of the key, or of the time when there is no key."""
    measures = [F.count("*").alias("row_count")]
    if key:
        measures += [F.min(quoted(key)).alias("key_min"), F.max(quoted(key)).alias("key_max")]
    elif ts:
        measures += [F.min(quoted(ts)).alias("key_min"), F.max(quoted(ts)).alias("key_max")]
    return df.agg(*measures)


def hash_number(*columns: Column) -> Column:
    """A number in [0, 2**32) from the md5 of the columns: equal on every run and cluster."""
    text = F.concat_ws("\u0001", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """About `percent` of the rows, chosen by their key: a filter without shuffle."""
    return df.where(hash_number(quoted(key)) % 100 < percent)


def sample_rows(df: DataFrame, key: str, rows: int = SAMPLE_ABOVE) -> DataFrame:
    """Exactly `rows` rows (or all, if fewer), the lowest by hash of a unique key.

    A threshold on the hash, taken from the row count with a wide margin, keeps nearly all other
    rows out of the top-n. Should the threshold leave too few, the plain top-n answers.
    """
    order = [hash_number(quoted(key)), quoted(key)]
    total = df.count()
    if total <= rows:
        return df
    margin = rows + 10 * rows**0.5 + 100
    near = df.where(hash_number(quoted(key)) <= int(2**32 * min(1.0, margin / total)))
    pool = near if near.count() >= rows else df
    return pool.orderBy(*order).limit(rows)


def stored_mark(profiled: DataFrame, results: DataFrame | None, kind: T.DataType) -> str | None:
    """The mark of a task as text: the greatest of what was profiled and of its automatic, completed runs."""
    marks = profiled.select(F.col("key_max").cast("string"))
    if results is not None:
        done = results.where("execution_type = 'Auto' AND task_status")
        marks = marks.unionByName(done.select(F.col("key_max").cast("string")))
    return marks.agg(F.max(F.col("key_max").cast(kind)).cast("string")).first()[0]


def advance_marks(marks: DataFrame, probes: DataFrame, manual: bool = False) -> DataFrame:
    """Marks (task_id, mark) after a run; manual runs leave them as they are."""
    if manual:
        return marks
    both = marks.select("task_id", "mark").unionByName(
        probes.select("task_id", F.col("key_max").alias("mark"))
    )
    return both.groupBy("task_id").agg(F.max("mark").alias("mark"))


def run_counters(results: DataFrame, expect: int | None = None) -> DataFrame:
    """Executions, successes and failures per task; a task stays enabled below `expect` runs."""
    counts = results.groupBy("task_id").agg(
        F.count("*").alias("executions"),
        F.count_if("validation_result").alias("successes"),
        F.count_if(~F.col("validation_result")).alias("failures"),
    )
    enabled = F.lit(True) if expect is None else F.col("executions") < expect
    return counts.withColumn("enabled", enabled)


def run_iterations(results: DataFrame, ts: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Number the automatic runs of each task by time; manual runs get -1."""
    automatic = results.where(F.col("execution_type") == "Auto")
    manual = results.where(F.col("execution_type") != "Auto")
    numbered = running_number(automatic, ["task_id"], F.date_trunc("minute", quoted(ts)), [ts, *tie_break], "iteration")
    return numbered.unionByName(manual.withColumn("iteration", F.lit(-1).cast("bigint")))
