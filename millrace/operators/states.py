"""All checks of a table from one scan of its rows.

Each row is expanded once into cells (kind, column, value): one for its size and key, and one for each
checked column. The cells are counted per different value, with partial sums before the shuffle, and
this table of counts is stored. Profiles, verdicts, deciles, moments, categories and the size are then
aggregates over the counts, and the rows are not read again.

User aggregates get the cells of their own column, unchanged, as a group of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, quoted
from millrace.operators.quantiles import magnitude_bucket, quantiles_of
from millrace.workspace import stored

SIZE, NUMBER, CATEGORY, CUSTOM = "size", "number", "category", "custom"
#: An aggregate of a column.
Aggregate = Callable[[Column], Column]


def scan(
    df: DataFrame, numeric: Sequence[str] = (), category: Sequence[str] = (),
    custom: Mapping[str, Aggregate] | None = None, key: str | None = None,
) -> DataFrame:
    """Stored rows (kind, column, octave, value, text, n, least, most, custom0, ...).

    `least` and `most` are the range of the key, in the row of the size. Null and NaN are values.
    """
    own = dict(custom or {})
    at = quoted(key) if key else F.lit(None).cast("bigint")

    def cell(kind: str, column: str | None = None, number=None, text=None, place: int | None = None) -> Column:
        given = [
            (quoted(c) if i == place else F.lit(None).cast(df.schema[c].dataType)).alias(f"given{i}")
            for i, c in enumerate(own)
        ]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(column).cast("string").alias("column"),
            (F.lit(None) if number is None else number).cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
            (at if kind == SIZE else F.lit(None).cast(df.schema[key].dataType if key else "bigint")).alias("at"),
            *given,
        )

    cells = [cell(SIZE)]
    cells += [cell(NUMBER, c, number=as_double(quoted(c))) for c in numeric]
    cells += [cell(CATEGORY, c, text=quoted(c)) for c in category]
    cells += [cell(CUSTOM, c, place=i) for i, c in enumerate(own)]
    measures = [F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most")]
    for i, (c, aggregate) in enumerate(own.items()):
        mine = (F.col("kind") == CUSTOM) & (F.col("column") == c)
        measures.append(F.when(mine, aggregate(F.col(f"given{i}"))).alias(f"custom{i}"))
    counted = df.select(F.inline(F.array(*cells))).groupBy("kind", "column", "value", "text").agg(*measures)
    return stored(counted.withColumn("octave", magnitude_bucket(F.col("value"))), "check_states")


def size_of(states: DataFrame) -> DataFrame:
    """One row (row_count, key_min, key_max), also without rows."""
    own = states.where(F.col("kind") == SIZE)
    return own.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.min("least").alias("key_min"), F.max("most").alias("key_max")
    )


def number_counts(states: DataFrame) -> DataFrame:
    """Rows (column, octave, value, n) of the numbers."""
    there = (F.col("kind") == NUMBER) & F.col("value").isNotNull() & ~F.isnan("value")
    return states.where(there).select("column", "octave", "value", "n")


def number_profiles(states: DataFrame, moments: int = 0, flags: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for each numeric column: rows, numbers, mean, deviation (not rounded), min, max, and `moments`
    by order; of each flag (a test of `column` and `value`) the number of rows that pass it."""
    own = states.where(F.col("kind") == NUMBER)
    value, times = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    means = own.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(times), F.lit(0)).alias("numbers"),
        F.try_divide(F.sum(value * times), F.sum(times)).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        *[F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name) for name, test in (flags or {}).items()],
    )
    # the counts are read twice, not the rows: powers are taken about the mean, so no digits are lost
    orders = range(2, max(moments, 2) + 1)
    apart = own.join(means.select("column", "mean"), "column").withColumn("apart", value - F.col("mean"))
    powers = apart.groupBy("column").agg(*[F.sum(F.col("apart") ** k * F.col("n")).alias(f"m{k}") for k in orders])
    deviation = F.sqrt(F.when(F.col("numbers") > 1, F.col("m2") / (F.col("numbers") - 1)).otherwise(0.0))
    listed = [x for k in range(3, moments + 1) for x in (F.lit(k), F.col(f"m{k}") / F.col("numbers"))]
    by_order = F.create_map(*listed) if listed else F.lit(None).cast("map<int,double>")
    there = F.col("numbers") > 0
    return means.join(powers, "column").select(
        "column", "rows", "numbers", "mean", F.when(there, deviation).alias("deviation"),
        "min", "max", *(flags or {}), F.when(there, by_order).alias("moments"),
    )


def deciles(states: DataFrame) -> DataFrame:
    """Rows (column, percentiles): eleven deciles to 2 decimals."""
    found = quantiles_of(number_counts(states)).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("probability", F.round("quantile", 2).alias("q")))).alias("p")
    )
    return found.select("column", F.col("p.q").alias("percentiles"))


def category_counts_of(states: DataFrame) -> DataFrame:
    """Rows (column, value, rows); null is a value of its own."""
    own = states.where(F.col("kind") == CATEGORY)
    return own.select("column", F.col("text").alias("value"), F.col("n").alias("rows"))


def custom_of(states: DataFrame, custom: Sequence[str]) -> list[DataFrame]:
    """For each custom column one row (column, found): what its aggregate gave."""
    own = states.where(F.col("kind") == CUSTOM)
    return [
        own.where(F.col("column") == c).select("column", F.col(f"custom{i}").alias("found")) for i, c in enumerate(custom)
    ]
