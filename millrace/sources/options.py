"""Reader and writer options for external stores. Pure functions; the connection is Spark's."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from millrace.plans.spec import Source

# JDBC addresses and driver classes by source kind.
_JDBC = {
    "mysql": ("jdbc:mysql://{ip}:{port}/{db}", "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://{ip}:{port};databaseName={db}", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "phoenix": ("jdbc:phoenix:thin:url=http://{ip}:{port};serialization=PROTOBUF", "org.apache.phoenix.queryserver.client.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{ip}:{port}/{db}", "oracle.jdbc.OracleDriver"),
}
FETCH_SIZE = 10_000  # fixed value: rows per round trip


@dataclass(frozen=True)
class SplitBy:
    """Numeric column that cuts a relational pull into parallel range reads."""

    column: str
    low: int
    high: int
    parts: int


def jdbc_options(source: Source, split: SplitBy | None = None) -> dict[str, str]:
    """Options of a relational pull; with `split` every executor reads its own key range."""
    if source.db_type not in _JDBC:
        raise ValueError(f"{source.db_type!r} is not a relational source")
    url, driver = _JDBC[source.db_type]
    options = {
        "url": url.format(ip=source.ip, port=source.port, db=source.db_name),
        "driver": driver,
        "fetchsize": str(FETCH_SIZE),
    }
    if source.user_name:
        options |= {"user": source.user_name, "password": source.password}
    if split is None:
        if source.statement:
            return options | {"query": source.statement}
        return options | {"dbtable": source.table_name}
    table = f"({source.statement}) task_source" if source.statement else source.table_name
    return options | {
        "dbtable": table,
        "partitionColumn": split.column,
        "lowerBound": str(split.low),
        "upperBound": str(split.high),
        "numPartitions": str(split.parts),
    }


def cassandra_options(source: Source) -> dict[str, str]:
    return {
        "spark.cassandra.connection.host": source.ip,
        "spark.cassandra.connection.port": source.port,
        "spark.cassandra.auth.username": source.user_name,
        "spark.cassandra.auth.password": source.password,
        "keyspace": source.db_name,
        "table": source.table_name,
    }


def elasticsearch_options(source: Source) -> dict[str, str]:
    """The filter goes to the store as it is, and only the asked fields come back."""
    tops = dict.fromkeys(c.split(".")[0] for c in source.columns)
    options = {
        "es.nodes": source.ip,
        "es.port": source.port,
        "es.net.http.auth.user": source.user_name,
        "es.net.http.auth.pass": source.password,
        "es.resource": source.table_name,
        "es.output.json": "true",
    }
    if source.statement:
        options["es.query"] = source.statement
    if tops:
        options["es.read.field.include"] = ",".join(tops)
    return options


def mongodb_options(source: Source) -> dict[str, str]:
    """Filter and projection as an aggregation; `_id` is always left out."""
    login = f"{source.user_name}:{source.password}@" if source.user_name else ""
    steps: list[Mapping] = []
    if source.statement:
        steps.append({"$match": json.loads(source.statement)})
    steps.append({"$project": {"_id": 0} | {c: 1 for c in source.columns}})
    return {
        "connection.uri": f"mongodb://{login}{source.ip}:{source.port}/",
        "database": source.db_name,
        "collection": source.table_name,
        "aggregation.pipeline": json.dumps(steps),
    }


def hbase_options(source: Source) -> dict[str, str]:
    return {
        "hbase.zookeeper.quorum": source.ip,
        "hbase.zookeeper.property.clientPort": source.port,
        "hbase.table": source.table_name,
        "hbase.columns": " ".join(source.columns),
        "hbase.filter": source.statement,
    }
