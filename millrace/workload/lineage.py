"""Lineage tables, with orders as runs, return flags as actions and suppliers as inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import lineage
from millrace.plans.runner import plan_task
from millrace.plans.spec import parse_task
from millrace.sources.readers import Resolver
from millrace.workload.registry import query, table
from millrace.workspace import fresh_dir, stored


def _events(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_returnflag) AS run",
        "l_returnflag AS action",
        "l_suppkey AS input",
        "concat('out-', l_linestatus, l_partkey % 50) AS output",
        "l_shipdate AS shipped",
        "l_orderkey",
    )


_EVENTS_SQL = """
    ev AS (SELECT l_orderkey || '-' || l_returnflag AS run, l_returnflag AS action, l_suppkey AS input,
                  'out-' || l_linestatus || (l_partkey % 50) AS output, l_shipdate AS shipped, l_orderkey FROM lineitem),
    sets AS (SELECT run, action, list(DISTINCT input ORDER BY input) AS inputs FROM ev GROUP BY 1, 2),
    mem AS (SELECT run, action, len(inputs) AS size, 'p:' || min(run) OVER (PARTITION BY action, inputs) AS process_id FROM sets)
"""


@query(f"WITH {_EVENTS_SQL} SELECT input, count(DISTINCT run) AS runs FROM ev GROUP BY 1")
def lineage_data_nodes(spark, sf_dir):
    return lineage.data_nodes(_events(spark, sf_dir), ["input"], "run")


_HASH = "CAST('0x' || substr(md5(run), 1, 8) AS BIGINT)"


@query(
    f"""
    WITH {_EVENTS_SQL}, p AS (SELECT DISTINCT input, run FROM ev), n AS (SELECT input, count(*) AS size FROM p GROUP BY 1)
    SELECT input, size, (size + 99) // 100 AS parts, {_HASH} % ((size + 99) // 100) AS part,
           string_agg(run, ',' ORDER BY run) AS run_ids
    FROM p JOIN n USING (input) GROUP BY ALL
    """
)
def lineage_node_runs(spark, sf_dir):
    out = lineage.data_node_runs(_events(spark, sf_dir), ["input"], "run", limit=100)
    return out.withColumn("run_ids", F.array_join("run_ids", ","))


def _members(spark, sf_dir):
    return lineage.process_members(_events(spark, sf_dir), "run", ["action"], "input")


def _labelled(members):
    """Process ids replaced by the first run of the node, which SQL can compute too."""
    # ids of a node as bytes, half as long as their text; both readers share the one shuffle of the sets
    members = members.withColumn("process_id", F.unhex("process_id"))
    nodes = lineage.process_nodes(members, "run", ["action"]).select("process_id", "first_run")
    named = members.join(nodes, "process_id")
    return named.select("run", "action", "size", F.concat(F.lit("p:"), "first_run").alias("process_id"))


@query(
    f"""
    WITH {_EVENTS_SQL}
    SELECT action, min(run) AS first_run, count(*) AS runs, max(size) AS inputs FROM mem GROUP BY action, process_id
    """
)
def lineage_process_nodes(spark, sf_dir):
    return lineage.process_nodes(_members(spark, sf_dir), "run", ["action"]).drop("process_id")


@query(
    f"""
    WITH {_EVENTS_SQL}
    SELECT run, process_id, date_diff('second', min(shipped), max(shipped)) AS duration_seconds
    FROM ev JOIN mem USING (run) GROUP BY run, process_id
    """
)
def lineage_runs(spark, sf_dir):
    runs = _events(spark, sf_dir).groupBy("run").agg(F.min("shipped").alias("start"), F.max("shipped").alias("end"))
    out = lineage.run_rows(runs, _labelled(_members(spark, sf_dir)), "run", "start", "end")
    return out.select("run", "process_id", "duration_seconds")


@query(
    f"""
    WITH {_EVENTS_SQL}
    SELECT DISTINCT 'd:' || input AS src, process_id AS dst FROM ev JOIN mem USING (run)
    UNION
    SELECT a.process_id, b.process_id FROM mem b JOIN mem a
      ON b.action <> 'A' AND a.run = split_part(b.run, '-', 1) || '-A'
    UNION
    SELECT process_id, output FROM ev JOIN mem USING (run)
    """
)
def lineage_edges(spark, sf_dir):
    """Every run of another action also reads the run of action A on the same order."""
    events = _events(spark, sf_dir)
    members = stored(_labelled(_members(spark, sf_dir)), "members")
    data = events.select("run", F.lit("data").alias("input_kind"), F.concat(F.lit("d:"), "input").alias("input"))
    runs = events.where("action <> 'A'").select(
        "run", F.lit("run").alias("input_kind"), F.concat("l_orderkey", F.lit("-A")).alias("input")
    )
    return lineage.lineage_edges(data.unionByName(runs), events.select("run", "output"), members, "run")


def _totals_task(of, column, group):
    """Load a table, then sum a column per group."""
    total = {"IsEnable": "True", "Step": 1, "Naming": "total", "TargetColumn": column, "GroupBy": {"IsEnable": "True", "TargetColumnList": [group]}}
    return parse_task({
        "TaskAction": {"TaskId": of, "TableName": f"{of}_totals", "SubmittedUser": "user"},
        "Base": {"Databases": [{
            "ConnectionInfo": {"DbType": "mysql", "Ip": "db", "Port": "3306", "UserName": "u", "Password": ""},
            "DbInfo": {"DbName": "shop", "TableName": of, "ColumnsName": []},
            "SqlStatement": "",
            "Condition": {"FunctionCondition": {"ToSum": [total]}, "SpecialFunction": {}},
        }]},
        "Merge": {"Tables": []},
        "ResultParameterSetting": {"ColumnTypeList": []},
    })


@query(
    """
    SELECT * FROM (VALUES
      ('orders', 'DF10-1', 2), ('DF10-1', 'DF40-1', 2), ('DF40-1', 'DF60-1', 2), ('DF60-1', 'ORDERS_TOTALS', 2),
      ('customer', 'DF10-1', 1), ('DF10-1', 'DF40-1', 1), ('DF40-1', 'DF60-1', 1), ('DF60-1', 'CUSTOMER_TOTALS', 1)
    ) AS e(src, dst, runs), (SELECT count(*) AS stored_rows FROM orders)
    """
)
def lineage_task_twice(spark, sf_dir):
    """Edges of a task run twice and of another one; the same action on the same inputs is one node."""
    start = datetime(2024, 1, 1)
    events = path = None
    for of, column, group in (("customer", "c_acctbal", "c_nationkey"), *[("orders", "o_totalprice", "o_custkey")] * 2):
        root = fresh_dir(spark, "results")
        run = plan_task(_totals_task(of, column, group), Resolver(spark, tables={of: table(spark, sf_dir, of)}))
        path = run.store(root, "2024-01-01 00:00:00")
        # each run has its own folder here; the result counts as the same table
        rows = run.lineage(spark, start, start).withColumn(
            "output_data", F.transform("output_data", lambda o: o.withField("db_name", F.lit("results"))))
        events = rows if events is None else events.unionByName(rows)
    events = stored(events, "events")
    names = lineage.event_members(events).groupBy("process_id").agg(
        F.first("action_id").alias("name"), F.count("*").alias("runs"))
    edges = lineage.event_edges(events)
    data = lambda c: F.get_json_object(c, "$.table_name")
    source, target = (names.select(F.col("process_id").alias(c), F.col("name").alias(f"{c}_name"), F.col("runs").alias(f"{c}_runs")) for c in ("src", "dst"))
    named = edges.join(source, "src", "left").join(target, "dst", "left")
    kept = spark.read.option("header", True).csv(path).agg(F.count("*")).scalar()
    return named.select(
        F.coalesce("src_name", data("src")).alias("src"), F.coalesce("dst_name", data("dst")).alias("dst"),
        F.coalesce("dst_runs", "src_runs").cast("int").alias("runs"), kept.alias("stored_rows"),
    )
