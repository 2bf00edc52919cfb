"""Sources and sinks: statements, files, documents, wide rows, appends, upserts, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.sequence import generated_key
from millrace.plans.spec import ColumnSpec
from millrace.sources.bucketed import BucketedTable
from millrace.sources.filters import find_filter, search_filter
from millrace.sources.readers import read_csv, run_statement
from millrace.sources.shaping import column_subset, flatten_json, upper_names, wide_cells
from millrace.sources.sinks import upsert, with_key, write_csv, write_table
from millrace.workload.registry import query, table
from millrace.workspace import fresh_dir


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def sql_statement(spark, sf_dir):
    statement = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"
    return run_statement({"orders": table(spark, sf_dir, "orders")}, statement)


@query("SELECT p_partkey, p_brand FROM part", name="column_subset")
def column_subset_part(spark, sf_dir):
    return column_subset(table(spark, sf_dir, "part"), ["p_partkey", "p_brand"])


@query('SELECT s_suppkey AS "S_SUPPKEY", s_name AS "S_NAME", s_nationkey AS "S_NATIONKEY", s_acctbal AS "S_ACCTBAL" FROM supplier', name="upper_names")
def upper_case_names(spark, sf_dir):
    return upper_names(table(spark, sf_dir, "supplier"))


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    path = write_csv(customers, fresh_dir(spark, "csv"), "customers")
    return read_csv(spark, path, customers.schema, ["c_custkey", "c_acctbal", "c_mktsegment"])


@query(
    """
    SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS "user.kind",
           '{"kind":"' || event_type || '","no":' || user_id || '}' AS user,
           '["' || event_type || '",' || '"' || user_id || '"]' AS tags, '' AS absent,
           regexp_extract(props, '[0-9]+') AS "props.k"
    FROM events
    """
)
def doc_flatten(spark, sf_dir):
    documents = table(spark, sf_dir, "events").select(
        "event_id",
        F.to_json(
            F.struct(
                F.col("event_id").alias("id"),
                F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("no")).alias("user"),
                F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("tags"),
                F.from_json("props", "k int").alias("props"),
            )
        ).alias("doc"),
    )
    return flatten_json(documents, "doc", ["id", "user.kind", "user", "tags", "absent", "props.k"], keep=["event_id"])


@query(
    """
    SELECT event_id, event_type, value FROM events
    WHERE (value < 20 AND value >= 5 AND event_type = 'error')
       OR (user_id IN (1, 2, 3) AND event_type <> 'view' AND value > 10)
    """
)
def doc_filter(spark, sf_dir):
    search = {
        "query": {
            "bool": {"must": [{"range": {"value": {"lt": 20, "gte": 5}}}, {"term": {"event_type": "error"}}]}
        }
    }
    find = {"user_id": {"$in": [1, 2, 3]}, "event_type": {"$ne": "view"}, "value": {"$gt": 10}}
    events = table(spark, sf_dir, "events")
    return events.where(search_filter(search) | find_filter(find)).select("event_id", "event_type", "value")


@query(
    """
    SELECT event_id, event_type AS "cf:type",
           CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS "cf:user", '' AS "cf:none"
    FROM events
    """
)
def wide_row(spark, sf_dir):
    def cell(name, value):
        return F.struct(F.lit(name).alias("name"), F.encode(value, "UTF-8").alias("cell"))

    user = F.when(F.col("event_type") != "view", F.array(cell("cf:user", F.col("user_id").cast("string"))))
    cells = F.concat(
        F.array(cell("cf:type", F.col("event_type"))), F.coalesce(user, F.array().cast("array<struct<name:string,cell:binary>>"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.map_from_entries(cells).alias("cells"))
    return wide_cells(rows, "cells", ["cf:type", "cf:user", "cf:none"], keep=["event_id"])


_SPECS = (
    ColumnSpec("o_orderkey", "BIGINT", is_key=True),
    ColumnSpec("o_orderstatus", "VARCHAR"),
    ColumnSpec("o_totalprice", "DOUBLE"),
)
_NAMES = [s.column for s in _SPECS]


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sink_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(_NAMES)
    path = fresh_dir(spark, "append")
    write_table(orders.where("o_orderstatus = 'F'"), path, _SPECS)
    write_table(orders.where("o_orderstatus <> 'F'"), path, _SPECS, append=True)
    return spark.read.parquet(path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice FROM orders")
def sink_table(spark, sf_dir):
    specs = (ColumnSpec("order_id", "VARCHAR(20)", is_key=True), ColumnSpec("o_totalprice", "decimal(12,2)"))
    path = fresh_dir(spark, "table")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_id", "o_totalprice")
    write_table(orders, path, specs)
    return spark.read.parquet(path).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice
    FROM orders
    UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice FROM orders WHERE o_orderstatus = 'P'
    """
)
def sink_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    changes = urgent.selectExpr("o_orderkey", "'U' AS o_orderstatus", "o_totalprice + 1 AS o_totalprice").unionByName(
        urgent.selectExpr("o_orderkey", "'U' AS o_orderstatus", "o_totalprice + 2 AS o_totalprice")
    )
    added = orders.where("o_orderstatus = 'P'").selectExpr("-o_orderkey - 1 AS o_orderkey", "'N' AS o_orderstatus", "o_totalprice")
    path = fresh_dir(spark, "upsert")
    merged = upsert(orders.select(_NAMES), changes.unionByName(added), ["o_orderkey"], ["o_totalprice"])
    merged.write.parquet(path)
    return spark.read.parquet(path)


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 1000 = 7 THEN 'Z' WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 1000 = 7 THEN -1.0 WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice
    FROM orders
    UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice FROM orders WHERE o_orderkey % 1000 = 8
    """
)
def sink_upsert_buckets(spark, sf_dir):
    """Three versions of a table in hash buckets; the last upsert has few keys and leaves most buckets alone."""
    orders = table(spark, sf_dir, "orders")
    stored_table = BucketedTable(spark, fresh_dir(spark, "buckets"), ["o_orderkey"], ["o_totalprice"])
    stored_table.create(orders.select(_NAMES), buckets=32)
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    stored_table.upsert(
        urgent.selectExpr("o_orderkey", "'U' AS o_orderstatus", "explode(array(o_totalprice + 1, o_totalprice + 2)) AS o_totalprice")
    )
    few = orders.where("o_orderkey % 1000 = 7").selectExpr("o_orderkey", "'Z' AS o_orderstatus", "-1.0D AS o_totalprice")
    more = orders.where("o_orderkey % 1000 = 8").selectExpr("-o_orderkey - 1 AS o_orderkey", "'N' AS o_orderstatus", "o_totalprice")
    stored_table.upsert(few.unionByName(more))
    return stored_table.read()


_BASE = "2024-01-01 00:00:00"


@query(
    """
    SELECT o_orderkey, o_totalprice,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(
             row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1), '%Y-%m-%d %H:%M:%S.%f') AS made_at
    FROM orders
    """
)
def auto_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return generated_key(orders, "made_at", _BASE, unique=["o_orderkey"])


@query(
    """
    SELECT l_returnflag, l_linestatus,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(
             row_number() OVER (ORDER BY md5('{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}')) - 1),
             '%Y-%m-%d %H:%M:%S.%f') AS "AUTOTIMESTAMP_"
    FROM lineitem
    """
)
def auto_key_copies(spark, sf_dir):
    """Six distinct rows in many copies: keys stay unique and gapless."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return with_key(lines, [ColumnSpec("AUTOTIMESTAMP_", "VARCHAR", is_key=True)], _BASE)
