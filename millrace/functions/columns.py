"""Row-wise column functions: combine, arithmetic, rename, declared types."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.spec import ColumnSpec


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or stars."""
    return F.col("`" + name.replace("`", "``") + "`")


def joined_id(*names: str) -> Column:
    """Columns as one text with colons in between; different columns never give the same text.

    Colons and backslashes inside a value get a backslash, and a null is written as `\\N`.
    """

    def part(name: str) -> Column:
        text = F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit(":"), F.lit("\\:")), F.lit("\\N"))

    return F.concat_ws(":", *map(part, names))


def as_double(column: Column) -> Column:
    """Text that is not a number becomes null."""
    return column.try_cast("double")


def as_number(df: DataFrame, name: str) -> Column:
    """The column itself when numeric, its text read as a number otherwise."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return quoted(name)
    return as_double(quoted(name))


def combine(df: DataFrame, columns: Sequence[str], separator: str, naming: str) -> DataFrame:
    """Join columns as text; a null counts as empty text and keeps its separator."""
    parts: list[Column] = []
    for i, name in enumerate(columns):
        if i:
            parts.append(F.lit(separator))
        parts.append(F.coalesce(quoted(name).cast("string"), F.lit("")))
    return df.withColumn(naming, F.concat(*parts))


_FOLDS = {
    "ADD": lambda a, b: a + b,
    "SUB": lambda a, b: a - b,
    "MUL": lambda a, b: a * b,
    "DIV": F.try_divide,
}


def arithmetic(df: DataFrame, operator: str, columns: Sequence[str], naming: str) -> DataFrame:
    """Left-to-right arithmetic as double; division by zero gives null.

    With fewer than two operands there is nothing to compute and no column is added.
    """
    if len(columns) < 2:
        return df
    operands = [as_double(quoted(c)) for c in columns]
    return df.withColumn(naming, reduce(_FOLDS[operator], operands))


def rename_columns(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Apply the declared renames in list order, as one projection."""
    names = list(df.columns)
    for spec in specs:
        if spec.renames:
            names = [spec.new_name if n == spec.column else n for n in names]
    if names == df.columns:
        return df
    return df.select([quoted(old).alias(new) for old, new in zip(df.columns, names)])


# Type names of the result settings that Spark spells differently.
_TYPE_NAMES = {
    "VARCHAR": "string",
    "CHAR": "string",
    "TEXT": "string",
    "INTEGER": "int",
    "UNSIGNED_INT": "int",
    "UNSIGNED_LONG": "bigint",
    "UNSIGNED_FLOAT": "float",
    "UNSIGNED_DOUBLE": "double",
}


def spark_type(declared: str) -> str:
    base = declared.split("(")[0].strip().upper()
    return _TYPE_NAMES.get(base, declared.lower())


def apply_types(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Cast result columns to their declared types; values that do not fit become null."""
    types = {s.output_name: spark_type(s.type) for s in specs if s.type}
    return df.select(
        [quoted(c).try_cast(types[c]).alias(c) if c in types else quoted(c) for c in df.columns]
    )
