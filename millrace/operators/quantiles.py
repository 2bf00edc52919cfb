"""Exact quantiles of any number of columns without gathering a column in one task.

The built-in exact percentile merges all distinct values of a column in a single task. Here the
order statistics are found by narrowing, at every size: values are counted per distinct value (so
copies collapse before anything else) in a stored table. A column is a bucket of values; a bucket of
one value is done, one of at most MOST_KINDS different values is ranked value by value, and any other is
split, of which only the parts that hold a wanted rank are looked at further. The first split is by
magnitude (about 67,000 parts), each later one into 65,536 equal parts. After two of these a bucket
spans fewer than 2**17 doubles, so every window is bounded.

Only the live buckets come to the driver: at most two per wanted quantile and column.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import as_double, quoted
from millrace.workspace import stored

DECILES = tuple(i / 10 for i in range(11))
#: Different values that are ranked in one window.
MOST_KINDS = 1 << 17

_SPLITS = 65536
_STEPS_PER_OCTAVE = 16
_LOWEST_EXPONENT = 1100  # below the exponent of the smallest positive double


def unpivot_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value) with the non-null numbers of the given columns."""
    cells = df.select([as_double(quoted(c)).alias(c) for c in columns])
    long = cells.unpivot([], list(columns), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def magnitude_bucket(value: Column) -> Column:
    exponent = F.least(F.log2(F.abs(value)), F.lit(float(_LOWEST_EXPONENT)))
    size = F.floor((exponent + _LOWEST_EXPONENT) * _STEPS_PER_OCTAVE).cast("int") + 1
    return F.when(value == 0, 0).when(value > 0, size).otherwise(-size)


def _linear_bucket(value: Column, low: Column, high: Column) -> Column:
    part = F.floor((value - low) / (high - low) * _SPLITS).cast("int")
    return F.when(high > low, F.least(part, F.lit(_SPLITS - 1))).otherwise(0)


def _floats(probabilities: Sequence[float]) -> list[float]:
    return [float(p) for p in probabilities]


def _one_pass(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], measure: Column
) -> DataFrame:
    found = unpivot_numbers(df, columns).groupBy("column").agg(measure.alias("quantile"))
    at = F.array(*[F.lit(p) for p in _floats(probabilities)])
    pairs = F.arrays_zip(at.alias("probability"), F.col("quantile"))
    return found.select("column", F.inline(pairs))


_LIVE = "column string, low double, high double, start bigint, kinds bigint, total bigint, ranks array<bigint>"
#: Ranges of values that a filter names one by one.
_MOST_NAMED = 100


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as literals of the plan, many as a table."""
    fields = T.StructType.fromDDL(schema)
    if not 0 < len(rows) <= _MOST_NAMED:
        return spark.createDataFrame(rows, fields)

    def literal(value, kind: T.DataType) -> Column:
        listed = isinstance(value, list)
        return (F.array(*map(F.lit, value)) if listed else F.lit(value)).cast(kind)

    cells = [F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*cells)))


def _wanted(parts: DataFrame, bucket: str) -> list[Row]:
    """Of the parts of each live bucket those that hold a wanted rank; `start` is the rank at which the bucket begins."""
    so_far = Window.partitionBy("column", "start").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("start") + F.coalesce(F.sum("n").over(so_far), F.lit(0))
    inside = F.filter("ranks", lambda r: (r >= F.col("begin")) & (r < F.col("begin") + F.col("n")))
    placed = parts.withColumn("begin", begin).withColumn("ranks", inside).where(F.size("ranks") > 0)
    return placed.select("column", "low", "high", F.col("begin").alias("start"), "kinds", "total", "ranks").collect()


def histogram(counts: DataFrame) -> DataFrame:
    """Rows (column, octave, n, kinds, low, high): bounded for each column, and mergeable."""
    return counts.groupBy("column", "octave").agg(*_measures())


def _measures() -> list[Column]:
    return [F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("value").alias("low"), F.max("value").alias("high")]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, octave, value, n): how often each number occurs."""
    counts = unpivot_numbers(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.select("column", magnitude_bucket(F.col("value")).alias("octave"), "value", "n")


def _places(total: int, probability: float) -> tuple[int, int, float]:
    """The ranks (from 0) next to a quantile, and how far it is from the first."""
    position = (total - 1) * probability
    return math.floor(position), math.ceil(position), position - math.floor(position)


def quantiles_of(
    counts: DataFrame, probabilities: Sequence[float] = DECILES, buckets: DataFrame | None = None
) -> DataFrame:
    """Rows (column, probability, quantile) from a table (column, octave, value, n).

    The table is read a few times: give a stored one. `buckets` is its histogram, if there is one already;
    then only the values of the magnitudes that hold a wanted rank are read.
    """
    spark = counts.sparkSession
    asked = _floats(probabilities)
    if buckets is None:
        whole = counts.groupBy("column").agg(*_measures()).collect()
    else:
        own = [F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.min("low").alias("low"), F.max("high").alias("high")]
        whole = buckets.groupBy("column").agg(*own).collect()
    totals = {r.column: r.n for r in whole}
    ranks = {c: sorted({r for p in asked for r in _places(n, p)[:2]}) for c, n in totals.items()}
    live = [Row(**dict(zip(_NAMES, (r.column, r.low, r.high, 0, r.kinds, r.n, ranks[r.column])))) for r in whole]
    at: dict[str, dict[int, float]] = defaultdict(dict)
    first = True
    while live:
        for r in live:
            if r.low == r.high:
                at[r.column].update(dict.fromkeys(r.ranks, r.low))
        live = [r for r in live if r.low != r.high]
        stop = MOST_KINDS if buckets is None or not first else 0
        single, many = [r for r in live if r.kinds <= stop], [r for r in live if r.kinds > stop]
        if single:
            one = [F.col("value").alias("low"), F.col("value").alias("high"), F.lit(1).cast("bigint").alias("kinds")]
            found = _inside(counts, single).drop("low", "high", "kinds").select("*", *one)
            for r in _wanted(found, "value"):
                at[r.column].update(dict.fromkeys(r.ranks, r.low))
        if not many:
            break
        if first and buckets is not None:
            parts = buckets.join(_named(spark, many).drop("low", "high", "kinds"), "column")
        else:
            parts = _split(counts, many, first)
        live, first = _wanted(parts, "octave" if first else "bucket"), False
    rows = []
    for column, found in at.items():
        for p in asked:
            below, above, part = _places(totals[column], p)
            low, high = found[below], found[above]
            # from the nearer end, so that neighbours a single step apart are not both rounded down
            rows.append((column, p, low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)))
    return local_rows(spark, rows, "column string, probability double, quantile double")


_NAMES = [field.split()[0] for field in _LIVE.split(", ")]


def _named(spark: SparkSession, live: list[Row]) -> DataFrame:
    """The live buckets: at most two for each probability and column."""
    return F.broadcast(local_rows(spark, [tuple(r) for r in live], _LIVE))


def _inside(counts: DataFrame, live: list[Row]) -> DataFrame:
    """Values of the live buckets."""
    if len(live) <= _MOST_NAMED:  # a plain filter reaches the files, which the join does not
        ranges = [(F.col("column") == r.column) & F.col("value").between(r.low, r.high) for r in live]
        counts = counts.where(reduce(lambda a, b: a | b, ranges))
    between = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    return counts.join(_named(counts.sparkSession, live), "column").where(between)


def _split(counts: DataFrame, live: list[Row], by_magnitude: bool) -> DataFrame:
    bucket = F.col("octave") if by_magnitude else _linear_bucket(F.col("value"), F.col("low"), F.col("high"))
    name = "octave" if by_magnitude else "bucket"
    parts = _inside(counts, live).withColumn(name, bucket).drop("low", "high", "kinds")
    return parts.groupBy("column", "start", "total", "ranks", name).agg(*_measures())


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = DECILES
) -> DataFrame:
    """Rows (column, probability, quantile) with linear interpolation; nulls are ignored."""
    return quantiles_of(stored(value_counts(df, columns), "value_counts"), probabilities)


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = DECILES,
    accuracy: int = 10000,
) -> DataFrame:
    """Same shape from one pass with a mergeable sketch; rank error at most 1/accuracy."""
    return _one_pass(
        df, columns, probabilities, F.percentile_approx("value", _floats(probabilities), accuracy)
    )
