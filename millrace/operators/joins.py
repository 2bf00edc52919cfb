"""Left joins with the key rules of task documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import quoted


def common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """Type both keys are compared in; None when they already agree."""
    if left == right:
        return None
    pair = (left, right)
    if all(isinstance(t, T.NumericType) for t in pair):
        if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in pair):
            # whole numbers above 2 ** 53 would match their neighbours as doubles
            return T.LongType() if any(isinstance(t, T.IntegralType) for t in pair) else T.DoubleType()
        scales = [t.scale for t in pair if isinstance(t, T.DecimalType)]
        return T.DecimalType(38, max(scales)) if scales else T.LongType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in pair):
        return T.TimestampNTZType() if T.TimestampNTZType() in pair else T.TimestampType()
    return T.StringType()


def _comparable(value: Column, kind: T.DataType, target: T.DataType) -> Column:
    """The value in the common type; a fraction has no whole number that it equals."""
    cast = value.try_cast(target)
    if isinstance(target, T.LongType) and isinstance(kind, (T.FloatType, T.DoubleType)):
        # what does not fit, and infinity, becomes null; the highest long itself is no double
        return F.when((value == F.floor(value)) & (value.cast("double") < 2.0**63), cast)
    return cast


#: A key with more than this share of the left rows is hot, and its rows are dealt to so many tasks.
HOT_SHARE, HOT_SALTS = 1 / 64, 32


def _pairs(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], named: Mapping[str, str]
) -> list[tuple[Column, Column]]:
    """The keys of both sides in their common types; `named` has the right columns' names in the join."""
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError(f"join keys do not pair up: {left_keys} and {right_keys}")

    def aligned(left_key: str, right_key: str) -> tuple[Column, Column]:
        a, b = quoted(left_key), quoted(named[right_key])
        kinds = left.schema[left_key].dataType, right.schema[right_key].dataType
        target = common_type(*kinds)
        if target is None:
            return a, b
        # an unparsable value must not fail the join: it simply matches nothing
        return _comparable(a, kinds[0], target), _comparable(b, kinds[1], target)

    return list(map(aligned, left_keys, right_keys))


def hot_keys(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], share: float = HOT_SHARE
) -> list[int]:
    """Hashes of the join keys that hold more than `share` of the left rows, null keys included.

    They come from a summary of frequent items: each task keeps at most 1 / share counters, and the
    summaries of the tasks merge. It never misses a hot key; some that are not hot may be among them,
    which costs copies of their right rows and changes no result. Only the key columns are read.
    """
    keys = [a for a, _ in _pairs(left, right, left_keys, right_keys, {c: c for c in right.columns})]
    return sorted(left.select(F.xxhash64(*keys).alias("key")).stat.freqItems(["key"], share).first()[0])


def _salted(left: DataFrame, keys: Sequence[Column], hot: Sequence[int], salts: int) -> DataFrame:
    """Left rows with their salt: 0, or for hot keys one of many.

    It comes from the row and from the task that holds it, so that copies of a row are dealt out as well, and a
    task that runs again gives the same salts.
    """
    content = [quoted(f.name) for f in left.schema if not isinstance(f.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType))]
    dealt = F.pmod(F.xxhash64(F.spark_partition_id(), *content), F.lit(salts)).cast("int")
    return left.withColumn(_SALT, F.when(F.xxhash64(*keys).isin(list(hot)), dealt).otherwise(0))


def _copied(right: DataFrame, keys: Sequence[Column], hot: Sequence[int], salts: int) -> DataFrame:
    """Right rows once, those of hot keys once for each salt."""
    places = F.when(F.xxhash64(*keys).isin(list(hot)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return right.select("*", F.explode(places).alias(f"{_SALT}_right"))


_SALT = "__salt"


def left_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    null_safe: bool = False,
    spread: bool = False,
    hot: Sequence[int] = (),
    salts: int = HOT_SALTS,
) -> DataFrame:
    """Left outer join; the result has all left columns, then the right columns without keys.

    Keys of different types are compared in a common type, and the left key keeps its own type.
    A name that both sides still share gets the suffixes `_x` and `_y`. Right columns are
    renamed before the join, so both sides may come from the same table.

    Set `spread` when the right side is an aggregate over its keys. Such a side is already
    partitioned by them, and adaptive execution splits a skewed left partition only when both
    sides come straight from a shuffle. A hash of the keys as one more key brings that shuffle
    about; it moves the aggregated rows only.

    `hot` has the hashes of hot left keys, from `hot_keys`: their left rows are dealt to `salts` tasks
    and only their right rows are copied, whatever adaptive execution sees or does.
    """
    hidden = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    renamed = right.select([quoted(c).alias(hidden[c]) for c in right.columns])

    pairs = _pairs(left, right, left_keys, right_keys, hidden)
    columns = left.columns
    tests = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    if spread:
        tests.append(F.xxhash64(*[a for a, _ in pairs]) == F.xxhash64(*[b for _, b in pairs]))
    if hot:
        left = _salted(left, [a for a, _ in pairs], hot, salts)
        renamed = _copied(renamed, [b for _, b in pairs], hot, salts)
        tests.append(quoted(_SALT) == quoted(f"{_SALT}_right"))
    condition = reduce(lambda x, y: x & y, tests)
    kept = [c for c in right.columns if c not in right_keys]
    clash = set(columns) & set(kept)
    out = [quoted(c).alias(f"{c}_x" if c in clash else c) for c in columns]
    out += [quoted(hidden[c]).alias(f"{c}_y" if c in clash else c) for c in kept]
    return left.join(renamed, condition, "left").select(out)
