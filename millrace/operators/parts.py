"""Lists per key, cut into parts of bounded size.

A list of everything related to a key is unbounded when the key is popular. A list longer than
the limit is stored as several rows, each with its part number, and no member is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.incremental import hash_number
from millrace.operators.joins import left_join

PART_SIZE = 1000


def assign_parts(pairs: DataFrame, keys: Sequence[str], item: str, limit: int = PART_SIZE) -> DataFrame:
    """Add `size`, `parts` and `part` to distinct (keys, item) rows."""
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("size") / F.lit(limit)).cast("bigint"))
    # a shuffled join, even where the sizes are few: it leaves the items of a key together, so that
    # what is grouped by part behind it is nearly whole before it moves
    joined = left_join(pairs, sizes.hint("shuffle_hash"), keys, keys, null_safe=True, spread=True)
    return joined.withColumn("part", hash_number(F.col(item)) % F.col("parts"))


def list_parts(
    pairs: DataFrame, keys: Sequence[str], item: str, naming: str, limit: int = PART_SIZE
) -> DataFrame:
    """Rows (keys, size, parts, part, list) from distinct (keys, item) rows; lists are sorted."""
    # the join is by key and its hash, which is no grouping column: so the grouping has a shuffle by
    # part of its own, behind partial lists, and the parts of a popular key go to different tasks
    return assign_parts(pairs, keys, item, limit).groupBy(*keys, "size", "parts", "part").agg(
        F.array_sort(F.collect_list(item)).alias(naming)
    )
