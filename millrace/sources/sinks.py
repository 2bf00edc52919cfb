"""Writing results: CSV, typed tables, appends, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import apply_types, quoted
from millrace.operators.sequence import generated_key
from millrace.plans.spec import GENERATED_KEY, ColumnSpec, TaskSpec


def write_csv(df: DataFrame, root: str, table: str) -> str:
    """A folder of CSV parts with headers, named by the upper-cased table."""
    path = f"{root.rstrip('/')}/{table.upper()}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def table_ddl(table: str, specs: Sequence[ColumnSpec]) -> str:
    """CREATE TABLE text with the declared types, the primary key last."""
    keys = [s for s in specs if s.is_key]
    if len(keys) != 1:
        raise ValueError(f"a stored table needs one primary key, got {[k.column for k in keys]}")
    key = keys[0]
    lines = [f'"{s.output_name}" {s.type}' for s in specs if not s.is_key]
    lines += [f'"{key.output_name}" {key.type} not null', f'CONSTRAINT pk PRIMARY KEY ("{key.output_name}")']
    return f"CREATE TABLE {table.upper()} ({', '.join(lines)});"


def with_key(df: DataFrame, specs: Sequence[ColumnSpec], base: str) -> DataFrame:
    """Add the generated key column when the settings ask for one."""
    for spec in specs:
        if spec.is_key and spec.column == GENERATED_KEY:
            return generated_key(df, spec.output_name, base)
    return df


def write_table(df: DataFrame, path: str, specs: Sequence[ColumnSpec], append: bool = False) -> None:
    """A parquet table with the declared types."""
    apply_types(df, specs).write.mode("append" if append else "errorifexists").parquet(path)


def store_result(df: DataFrame, spec: TaskSpec, specs: Sequence[ColumnSpec], root: str, base: str) -> str:
    """Write a task result as its document asks: a typed table, or CSV."""
    if not spec.store_table:
        return write_csv(df, root, spec.table_name)
    path = f"{root.rstrip('/')}/{spec.table_name.upper()}"
    write_table(with_key(df, specs, base), path, specs, spec.append)
    return path


def jdbc_write_options(url: str, driver: str, table: str, batch: int = 10_000) -> dict[str, str]:
    return {"url": url, "driver": driver, "dbtable": table, "batchsize": str(batch)}


def write_relational(df: DataFrame, options: dict[str, str], specs: Sequence[ColumnSpec], append: bool = False) -> None:
    """The typed rows to a relational table, one connection per partition."""
    writer = apply_types(df, specs).write.format("jdbc").options(**options)
    writer.mode("append" if append else "errorifexists").save()


def upsert(
    stored: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """Stored rows replaced or extended by the updates; per key the last update wins.

    An aggregate rather than a window: each task keeps one row per key before the shuffle, so
    many updates of one key cost no more than one. Write the result to a new path.
    """
    names = stored.columns
    both = stored.withColumn("__update", F.lit(0)).unionByName(
        updates.select(stored.columns).withColumn("__update", F.lit(1))
    )
    rest = [c for c in names if c not in version and c not in keys]
    rank = F.struct("__update", *[quoted(c) for c in [*version, *rest]])
    row = F.struct(*[quoted(c) for c in names])
    last = both.groupBy(*[quoted(k).alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, rank).alias("__row")
    )
    return last.select([F.col("__row").getField(c).alias(c) for c in names])
