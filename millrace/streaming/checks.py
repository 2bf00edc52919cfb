"""Quality checks on streams, with the same expressions as the batch checks.

Baselines are tables that do not change while a stream runs. The source's checkpoint takes the
place of the stored mark.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import as_double, quoted
from millrace.operators.detect import FAR, NEAR, baseline_bounds, beyond, numeric_passes
from millrace.operators.incremental import hash_number, mark_value
from millrace.workspace import fresh_dir

DRIFT_SALTS = 32


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def as_utc(ts: Column) -> Column:
    """Zone-less timestamps read as UTC, whatever the zone of the session."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Make a time column usable for watermarks."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, as_utc(quoted(ts)))
    return df


def flag_rows(stream: DataFrame, column: str, baseline: DataFrame) -> DataFrame:
    """Every row with its outlier flags: a narrow transformation, no state and no shuffle."""
    b, v = baseline_bounds(baseline)[column], as_double(quoted(column))
    flags = {
        "beyond_3": beyond(v, b["mean"], b["deviation"], F.lit(NEAR)),
        "beyond_5": beyond(v, b["mean"], b["deviation"], F.lit(FAR)),
        "beyond_custom": beyond(v, b["mean"], b["deviation"], b["multiplier"]),
    }
    return stream.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in flags.items()})


def window_verdicts(
    stream: DataFrame, column: str, ts: str, baseline: DataFrame, hours: int, delay: str = "1 hour"
) -> DataFrame:
    """One verdict per closed interval, from partial counts that are merged per window.

    Without a baseline, or without a number in the interval, it fails.
    """
    b = baseline_bounds(baseline)[column]
    flagged = flag_rows(event_time(stream, ts), column, baseline).withWatermark(ts, delay)
    counted = flagged.groupBy(F.window(ts, f"{hours} hours")).agg(
        F.count("*").alias("rows"),
        F.count_if("beyond_3").alias("beyond_3"),
        F.count_if("beyond_5").alias("beyond_5"),
        F.count_if("beyond_custom").alias("beyond_custom"),
        F.count(as_double(quoted(column))).alias("numbers"),
    )
    known = b["mean"].isNotNull() & (F.col("numbers") > 0)
    verdict = known & numeric_passes(F.col("rows"), F.col("beyond_3"), F.col("beyond_custom"), b["bound"])
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "rows",
        "beyond_3",
        "beyond_5",
        "beyond_custom",
        verdict.alias("is_pass"),
    )


def drift_rows(stream: DataFrame, column: str, known: DataFrame, salts: int = DRIFT_SALTS) -> DataFrame:
    """Rows whose category is not in the baseline; null is never known.

    The stream side is spread over `salts`, so that in a shuffle join no value, and no null, sends
    all its rows to one task. There is no hint: Spark broadcasts known values that it sees to be small.
    """
    values = known.where(F.col("column") == column).select("value")
    text = quoted(column).cast("string")
    salted = values.select(
        F.col("value").alias("__known"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__slot")
    )
    slot = (hash_number(F.to_json(F.struct(*[quoted(c) for c in stream.columns]))) % salts).cast("int")
    match = (text == F.col("__known")) & (F.col("__salt") == F.col("__slot"))
    return stream.withColumn("__salt", slot).join(salted, match, "left_anti").drop("__salt")


def split_late(stream: DataFrame, ts: str, mark: Any | None) -> tuple[DataFrame, DataFrame]:
    """On-time and late rows of a run: late means at or below the mark of the runs before it.

    The mark is fixed while a run lasts, so this is a plain filter; `next_mark` moves it on.
    """
    flagged = flag_late(stream, ts, mark)
    return tuple(flagged.where(F.col("is_late") == late).drop("is_late") for late in (False, True))


def flag_late(stream: DataFrame, ts: str, mark: Any | None) -> DataFrame:
    """All rows of a run with `is_late`, for one drain into both outputs.

    Two drains of the parts of `split_late` judge a file that arrives in between by two marks;
    one drain with `partition_by=["is_late"]` puts each row into exactly one of them.
    """
    late = F.lit(False) if mark is None else quoted(ts) <= mark_value(stream, ts, mark)
    return stream.withColumn("is_late", F.coalesce(late, F.lit(False)))


def next_mark(written: DataFrame, ts: str, mark: str | None = None) -> str | None:
    """Highest time among the rows a run wrote, as text and never below the old mark."""
    top = written.agg(F.max(quoted(ts)).cast("string").alias("top")).first()["top"]
    return mark if top is None or (mark is not None and mark > top) else top


def drain(stream: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Process all rows that are available now, then stop; a rerun continues at the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def drain_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Drain a stream into a new shared folder and read the result back."""
    spark = stream.sparkSession
    root = fresh_dir(spark, label)
    drain(stream, f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
