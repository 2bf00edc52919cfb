"""Column catalogue of tables, nested documents, wide rows and schemaless documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nested_names(schema: T.StructType) -> list[str]:
    """Names to depth two: `a` for plain fields, `a.b` for the fields of an object."""
    names: list[str] = []
    for field in schema:
        if isinstance(field.dataType, T.StructType):
            names += [f"{field.name}.{inner}" for inner in field.dataType.fieldNames()]
        else:
            names.append(field.name)
    return list(dict.fromkeys(names))


def describe_table(
    df: DataFrame, db_type: str, ip: str, port: str, db: str, table: str, counted: bool = True
) -> DataFrame:
    """One row with the column list and row count of a table. Credentials are never stored.

    The count reads the whole table; with `counted=False` it is null and nothing is read, for live sources.
    """
    literals = {"db_type": db_type, "ip": ip, "port": port, "db": db, "table": table}
    if counted:
        size = df.agg(F.count("*").alias("row_count"))
    else:
        size = df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
    return size.select(
        F.lit(f"{ip}:{port}:{db}:{table}").alias("id"),
        *[F.lit(v).alias(k) for k, v in literals.items()],
        F.array(*map(F.lit, nested_names(df.schema))).alias("columns"),
        "row_count",
    )


def map_names(df: DataFrame, cells: Column) -> DataFrame:
    """Distinct names in a wide-row map column, over the whole table."""
    return df.select(F.explode(F.map_keys(cells)).alias("column")).distinct()


def document_names(df: DataFrame, document: Column) -> DataFrame:
    """Distinct top-level names of JSON documents, over the whole table."""
    return df.select(F.explode(F.json_object_keys(document)).alias("column")).distinct()


def parsed_names(df: DataFrame, parsed: str) -> DataFrame:
    """The same from a column of parsed documents, so that the rows and their names share one parse."""
    cells = df.sparkSession.tvf.variant_explode(F.col(parsed).outer())
    return df.select(parsed).lateralJoin(cells).where("key is not null").select(F.col("key").alias("column")).distinct()
