"""Turning documents and wide rows into flat columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import quoted


def json_path(name: str) -> str:
    return "$" + "".join(f"['{part}']" for part in name.split("."))


def parse_documents(df: DataFrame, document: str, parsed: str = "parsed") -> DataFrame:
    """Adds the parsed form of a JSON text column: each document is parsed once, whatever is read from it."""
    return df.withColumn(parsed, F.try_parse_json(quoted(document)))


def flatten_json(df: DataFrame, document: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One text column per requested name of a JSON document column.

    Dots walk into objects. A missing top-level name gives empty text; objects and arrays give
    their JSON text. A document is parsed once for all names. The parsed form sorts the keys of objects, so only an
    object asked for as a whole is taken from the text again, and so is text that is no document (it may
    repeat a key).
    """
    parsed = "__parsed"

    def field(name: str) -> Column:
        path = json_path(name)
        value = F.try_variant_get(quoted(parsed), path, "string")
        holds_object = value.startswith("{") | (value.startswith("[") & value.contains("{"))
        again = quoted(parsed).isNull() | holds_object
        value = F.when(again, F.get_json_object(quoted(document), path)).otherwise(value)
        return (value if "." in name else F.coalesce(value, F.lit(""))).alias(name)

    return parse_documents(df, document, parsed).select(*[quoted(k) for k in keep], *[field(n) for n in names])


def flatten_struct(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same for documents that the connector already read as nested columns."""
    fields = {f.name: f.dataType for f in df.schema}

    def field(name: str) -> Column:
        top, *rest = name.split(".")
        if top not in fields:
            if rest:
                raise ValueError(f"no field {top!r} for {name!r}")
            return F.lit("").alias(name)
        value, kind = quoted(top), fields[top]
        for part in rest:
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                raise ValueError(f"no field {part!r} for {name!r}")
            value, kind = value.getField(part), kind[part].dataType
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        if nested:
            value = F.to_json(value)
        if not rest and (nested or isinstance(kind, T.StringType)):
            # only an absent value of a top-level name becomes empty text
            value = F.coalesce(value, F.lit(""))
        return value.alias(name)

    return df.select([field(n) for n in names])


def wide_cells(df: DataFrame, cells: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Chosen `family:qualifier` cells of a map of bytes, as text; a missing cell is empty text."""
    value_type = df.schema[cells].dataType.valueType

    def cell(name: str) -> Column:
        value = F.try_element_at(quoted(cells), F.lit(name))
        if isinstance(value_type, T.BinaryType):
            value = F.decode(value, "UTF-8")
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return df.select(*[quoted(k) for k in keep], *[cell(n) for n in names])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def column_subset(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; an empty list keeps all."""
    return df.select([quoted(n) for n in names]) if names else df
