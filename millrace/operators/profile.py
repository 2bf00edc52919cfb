"""Baseline profile of a table: numbers, moments, deciles, categories, custom statistics."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, quoted
from millrace.operators.moments import moment_state, moments_of
from millrace.operators.states import deciles, number_profiles
from millrace.plans.quality import chebyshev_multiplier


def _per_column(columns: Sequence[str], cells) -> Column:
    """Explode one wide row of aggregates into one row per checked column."""
    return F.explode(F.array(*[F.struct(*cells(i, c)) for i, c in enumerate(columns)]))


def numeric_profile(
    df: DataFrame, columns: Sequence[str], chebyshev: Mapping[str, float] | None = None
) -> DataFrame:
    """Rows (column, rows, mean, deviation, min, max, bound, multiplier), from one scan.

    Mean and deviation are rounded half-even to whole numbers, since the checks compare with the
    rounded values. A single row has deviation 0.
    """
    shares = chebyshev or {}
    measures = []
    for i, c in enumerate(columns):
        v = as_double(quoted(c))
        measures += [
            F.count(v).alias(f"n{i}"),
            F.bround(F.avg(v)).alias(f"mean{i}"),
            F.bround(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"dev{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]

    def cells(i: int, c: str) -> list[Column]:
        share = shares.get(c)
        multiplier = chebyshev_multiplier(share) if share else None
        return [
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("rows"),
            F.col(f"mean{i}").cast("bigint").alias("mean"),
            F.col(f"dev{i}").cast("bigint").alias("deviation"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            F.lit(share).cast("double").alias("bound"),
            F.lit(multiplier).cast("double").alias("multiplier"),
        ]

    return df.agg(*measures).select(_per_column(columns, cells).alias("c")).select("c.*")


def central_moments(df: DataFrame, columns: Sequence[str], highest: int) -> DataFrame:
    """Rows (column, order, moment) with the biased central moments 3..highest, from one scan."""
    return moments_of(moment_state(df, columns, highest), columns, highest)


def profile_of(states: DataFrame, chebyshev: Mapping[str, float] | None = None, moments: int = 0) -> DataFrame:
    """`numeric_profile` and the shape (percentiles, moments) of the numeric columns, from scanned states."""
    shares = chebyshev or {}
    kinds = "map<string,double>"
    bounds = F.from_json(F.lit(json.dumps(shares)), kinds)
    multipliers = F.from_json(F.lit(json.dumps({c: chebyshev_multiplier(s) for c, s in shares.items() if s})), kinds)
    found = number_profiles(states, moments).join(deciles(states), "column", "left")
    return found.select(
        "column",
        F.col("numbers").alias("rows"),
        F.bround("mean").cast("bigint").alias("mean"),
        F.bround(F.coalesce("deviation", F.lit(0.0))).cast("bigint").alias("deviation"),
        "min",
        "max",
        bounds[F.col("column")].alias("bound"),
        multipliers[F.col("column")].alias("multiplier"),
        "percentiles",
        "moments",
    )


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value, rows) with values as text; null is a value of its own."""
    texts = df.select([quoted(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("rows"))


def category_set(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value): the known values of each column, as a table of any size."""
    return category_counts(df, columns).where(F.col("value").isNotNull()).select("column", "value")


