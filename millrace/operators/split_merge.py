"""First row per key, and appending those rows to the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import quoted


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The lowest row per key by `order_by`, then by all other columns.

    An aggregate, not a window: every task keeps one candidate per key before the shuffle, so a
    key that holds a third of the rows is no larger than any other. The full tie order makes
    the choice independent of how rows are partitioned.
    """
    rest = [c for c in df.columns if c not in order_by and c not in keys]
    order = F.struct(*[quoted(c) for c in [*order_by, *rest]])
    row = F.struct(*[quoted(c) for c in df.columns])
    firsts = df.groupBy(*[quoted(k).alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, order).alias("__row")
    )
    return firsts.select([F.col("__row").getField(c).alias(c) for c in df.columns])


def split_merge(df: DataFrame, new: str, old: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Append one row per distinct `new` value in which `old` equals `new`."""
    extra = first_per_key(df, [new], order_by).withColumn(old, quoted(new))
    return df.unionByName(extra)
