"""The default resolver: from the source entry of a task to a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.plans.spec import SQL_KINDS, Source
from millrace.sources import options
from millrace.sources.filters import find_filter, search_filter
from millrace.sources.shaping import (
    column_subset,
    flatten_json,
    flatten_struct,
    upper_names,
    wide_cells,
)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns=()
) -> DataFrame:
    """A CSV with header. Without a schema all columns are text: inferring would read it twice."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return column_subset(reader.csv(path), columns)


def run_statement(tables: Mapping[str, DataFrame], statement: str) -> DataFrame:
    """A SELECT over named DataFrames, as one lazy plan."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    # the plan is resolved here, so the names are not needed any longer
    result = spark.sql(statement)
    for name in tables:
        spark.catalog.dropTempView(name)
    return result


@dataclass
class Resolver:
    """Reads every source kind in the executors.

    `tables` replaces live stores by DataFrames (tests, lake copies): statements then run on
    them as Spark SQL, and document and wide-row sources are shaped from them. `splits` gives
    the key ranges of parallel relational reads, `schemas` the declared types of CSV files.
    """

    spark: SparkSession
    upload_root: str = ""
    result_root: str = ""
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    splits: Mapping[str, options.SplitBy] = field(default_factory=dict)
    schemas: Mapping[str, T.StructType | str] = field(default_factory=dict)

    def __call__(self, source: Source) -> DataFrame:
        kind = source.db_type
        if kind in SQL_KINDS:
            df = self._relational(source)
            return upper_names(df) if kind == "oracle" else df
        if kind == "cassandra":
            return self._cassandra(source)
        if kind in ("elasticsearch", "mongodb"):
            return self._documents(source)
        if kind == "hbase":
            return self._wide_rows(source)
        if kind in ("csv", "hds"):
            return self._file(source)
        raise ValueError(f"source kind {kind!r} is not read here; convert it to CSV or parquet first")

    def _load(self, format_name: str, settings: Mapping[str, str]) -> DataFrame:
        return self.spark.read.format(format_name).options(**settings).load()

    def _statement(self, source: Source) -> DataFrame:
        if source.statement:
            return run_statement(self.tables, source.statement)
        return self.tables[source.table_name]

    def _relational(self, source: Source) -> DataFrame:
        if source.table_name in self.tables:
            return self._statement(source)
        return self._load("jdbc", options.jdbc_options(source, self.splits.get(source.table_name)))

    def _cassandra(self, source: Source) -> DataFrame:
        if source.table_name in self.tables:
            return self._statement(source)
        df = self._load("org.apache.spark.sql.cassandra", options.cassandra_options(source))
        if not source.statement:
            return column_subset(df, source.columns)
        return run_statement({source.table_name: df}, source.statement)

    def _documents(self, source: Source) -> DataFrame:
        search = source.db_type == "elasticsearch"
        if source.table_name in self.tables:
            df = self.tables[source.table_name]
            df = df.where((search_filter if search else find_filter)(source.statement))
        elif search:
            df = self._load("org.elasticsearch.spark.sql", options.elasticsearch_options(source))
            return flatten_json(df, df.columns[-1], source.columns)
        else:
            df = self._load("mongodb", options.mongodb_options(source))
        if search:
            return flatten_struct(df, source.columns)
        return column_subset(df.drop("_id"), source.columns)

    def _wide_rows(self, source: Source) -> DataFrame:
        if source.table_name in self.tables:
            df = self.tables[source.table_name]
        else:
            df = self._load("org.apache.hadoop.hbase.spark", options.hbase_options(source))
        cells = next(f.name for f in df.schema if isinstance(f.dataType, T.MapType))
        return wide_cells(df, cells, source.columns)

    def _file(self, source: Source) -> DataFrame:
        if source.table_name in self.tables:
            return column_subset(self.tables[source.table_name], source.columns)
        root = self.upload_root if source.db_type == "csv" else self.result_root
        path = f"{root}/{source.table_name}"
        return read_csv(self.spark, path, self.schemas.get(source.table_name), source.columns)
