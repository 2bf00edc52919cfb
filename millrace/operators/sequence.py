"""Numbering rows without one task sorting a whole group.

A group is cut into buckets that follow the wanted order. Rows are numbered inside their bucket,
and every bucket starts where the buckets before it end. Only the bucket sizes are summed up in
one place, never the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import quoted
from millrace.operators.joins import left_join

_COPIES_PER_PART = 100_000


def _bucket_starts(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("__bucket")
    before = F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*keys, "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))


def running_number(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order_by: Sequence[str],
    naming: str,
) -> DataFrame:
    """Row number per key (from 1) in `order_by` order.

    `bucket` must not decrease along that order and should cut the largest key into pieces a
    task can sort.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__size"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*[quoted(c) for c in order_by])
    numbered = rows.withColumn("__inside", F.row_number().over(inside))
    joined = left_join(
        numbered, _bucket_starts(sizes, keys), [*keys, "__bucket"], [*keys, "__bucket"], null_safe=True
    )
    number = F.col("__start") + F.col("__inside")
    return joined.withColumn(naming, number.cast("bigint")).drop("__bucket", "__inside", "__start")


def generated_key(df: DataFrame, naming: str, base: str, unique: Sequence[str] = ()) -> DataFrame:
    """Add a distinct time text per row: `base` plus one microsecond per row.

    Rows are ordered by the md5 of their content, whose first 16 bits are the bucket, so the
    65,536 buckets are even however the data is distributed and a lost executor recomputes the
    same keys. `unique` names columns that identify a row; without it, equal rows are counted
    first and get neighbouring keys, so a large group of copies stays one row until the end.
    """
    by = list(unique) or df.columns
    if any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in by):
        raise ValueError("name identifying columns: rows with maps cannot be ordered")
    rows = df.withColumn("__copies", F.lit(1).cast("bigint"))
    if not unique:
        rows = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("__copies"))

    single_text = len(by) == 1
    content = quoted(by[0]).cast("string") if single_text else F.to_json(F.struct(*[quoted(c) for c in by]))
    rows = rows.withColumn("__md5", F.md5(F.coalesce(content, F.lit(""))))
    rows = rows.withColumn("__bucket", F.substring("__md5", 1, 4))

    starts = _bucket_starts(rows.groupBy("__bucket").agg(F.sum("__copies").alias("__size")), [])
    order = Window.partitionBy("__bucket").orderBy("__md5", *[quoted(c) for c in by])
    inside = F.sum("__copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    # one row per bucket, 65,536 at most
    placed = placed.join(F.broadcast(starts), "__bucket").withColumn(
        "__from", F.col("__start") + F.col("__inside")
    )
    if unique:
        placed = placed.withColumn("__seq", F.col("__from"))
    else:
        placed = _expand_copies(placed)
    seconds = (F.col("__seq").cast("decimal(24,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    zero = F.lit(0)
    moment = F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return placed.withColumn(naming, F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")).select(*df.columns, naming)


def _expand_copies(placed: DataFrame) -> DataFrame:
    """One row per copy. Large groups are cut into parts that are spread before they grow."""
    copies, size = F.col("__copies"), F.lit(_COPIES_PER_PART)
    few = placed.where(copies <= size).withColumn("__seq", F.explode(F.sequence(F.col("__from"), F.col("__from") + copies - 1)))
    many = placed.where(copies > size)
    many = many.withColumn("__part", F.explode(F.sequence(F.lit(0), F.ceil(copies / size) - 1)))
    many = many.repartition("__md5", "__part")
    first = F.col("__from") + F.col("__part") * size
    last = F.least(first + size, F.col("__from") + copies) - 1
    return few.unionByName(many.withColumn("__seq", F.explode(F.sequence(first, last))).drop("__part"))
