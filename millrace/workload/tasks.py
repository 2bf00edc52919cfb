"""Whole task documents: load, functions, joins, renames."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import apply_types
from millrace.plans.runner import plan_task, run_task
from millrace.plans.spec import parse_task
from millrace.sources.readers import Resolver
from millrace.workload.registry import query, table


def _source(name, statement="", functions=None, specials=None, kind="mysql", columns=()):
    return {
        "ConnectionInfo": {"DbType": kind, "Ip": "db", "Port": "3306", "UserName": "u", "Password": ""},
        "DbInfo": {"DbName": "shop", "TableName": name, "ColumnsName": list(columns)},
        "SqlStatement": statement,
        "Condition": {"FunctionCondition": functions or {}, "SpecialFunction": specials or {}},
    }


def _merge(left, right):
    return [{"MergeColumnName": [left]}, {"MergeColumnName": [right]}]


def _column(name, new_name=None, type_="VARCHAR"):
    rename = {"IsEnable": "True" if new_name else "False", "NewName": new_name or ""}
    return {"Column": name, "Type": type_, "IsPrimaryKey": "False", "Rename": rename}


def _task(sources, merges, columns=(), table_name="result"):
    return parse_task(
        {
            "TaskAction": {"TaskId": "1", "TableName": table_name, "SubmittedUser": "user"},
            "Base": {"Databases": sources},
            "Merge": {"Tables": merges},
            "ResultParameterSetting": {"ColumnTypeList": list(columns)},
        }
    )


def _resolver(spark, sf_dir, *names):
    return Resolver(spark, tables={n: table(spark, sf_dir, n) for n in names})


ORDER_FUNCTIONS = {
    "ToArithmetic": [
        {
            "IsEnable": "True",
            "Step": 2,
            "Operator": "DIV",
            "Naming": "share",
            "TargetColumnList": [{"Column": "cust_total", "Order": 2}, {"Column": "o_totalprice", "Order": 1}],
        }
    ],
    "ToColumnCombine": [
        {
            "IsEnable": "True",
            "Step": 3,
            "Separator": "|",
            "Naming": "label",
            "TargetColumnList": [{"TargetColumn": "o_orderkey", "Order": 1}, {"TargetColumn": "o_orderpriority", "Order": 2}],
        }
    ],
    "ToSum": [
        {
            "IsEnable": "True",
            "Step": 1,
            "TargetColumn": "o_totalprice",
            "Naming": "cust_total",
            "GroupBy": {"IsEnable": "True", "TargetColumnList": ["o_custkey"]},
        },
        {"IsEnable": "False", "Step": 0, "TargetColumn": "o_totalprice", "Naming": "unused"},
    ],
}


@query(
    """
    SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority,
           round(t.cust_total, 2) AS cust_total, round(o.o_totalprice / t.cust_total, 6) AS share,
           o.o_orderkey || '|' || o.o_orderpriority AS label,
           c.c_name AS customer_name, c.c_nationkey, n.n_name AS nation_name, n.n_regionkey
    FROM orders o
    JOIN (SELECT o_custkey, sum(o_totalprice) AS cust_total FROM orders GROUP BY 1) t USING (o_custkey)
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    """
)
def task_orders(spark, sf_dir):
    spec = _task(
        [
            _source("orders", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders", ORDER_FUNCTIONS),
            _source("customer", "SELECT c_custkey, c_name, c_nationkey FROM customer"),
            _source("nation"),
        ],
        [_merge("o_custkey", "c_custkey"), _merge("c_nationkey", "n_nationkey")],
        [_column("c_name", "customer_name"), _column("n_name", "nation_name")],
    )
    result = run_task(spec, _resolver(spark, sf_dir, "orders", "customer", "nation"))
    return result.withColumns({"cust_total": F.round("cust_total", 2), "share": F.round("share", 6)})


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice AS amount_1, c_acctbal AS amount_2,
           c_name AS name_1, c_nationkey AS nationkey, n_name AS name_2,
           CAST(n_regionkey AS DOUBLE) AS amount_3
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    """
)
def conflict_rename(spark, sf_dir):
    spec = _task(
        [
            _source("orders", "SELECT o_orderkey, o_custkey, o_totalprice AS amount FROM orders"),
            _source("customer", "SELECT c_custkey, c_acctbal AS amount, c_name AS name, c_nationkey AS nationkey FROM customer"),
            _source("nation", "SELECT n_nationkey, n_name AS name, cast(n_regionkey AS double) AS amount FROM nation"),
        ],
        [_merge("o_custkey", "c_custkey"), _merge("nationkey", "n_nationkey")],
        [_column(c) for c in ("amount", "amount", "name", "name", "amount")],
    )
    return run_task(spec, _resolver(spark, sf_dir, "orders", "customer", "nation"))


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice AS order_amount, c_acctbal AS balance, c_name AS name
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    """
)
def conflict_rename_declared(spark, sf_dir):
    spec = _task(
        [
            _source("orders", "SELECT o_orderkey, o_custkey, o_totalprice AS amount FROM orders"),
            _source("customer", "SELECT c_custkey, c_acctbal AS amount, c_name AS name FROM customer"),
        ],
        [_merge("o_custkey", "c_custkey")],
        [_column("o_orderkey"), _column("amount", "order_amount"), _column("amount", "balance"), _column("name")],
    )
    return run_task(spec, _resolver(spark, sf_dir, "orders", "customer"))


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on,
           CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
           CAST(NULL AS DOUBLE) AS status
    FROM orders
    """
)
def rename_cast(spark, sf_dir):
    spec = _task(
        [
            _source(
                "orders",
                "SELECT o_orderkey, o_orderdate, substr(o_orderpriority, 1, 1) AS p, o_orderstatus FROM orders",
            )
        ],
        [],
        [
            _column("o_orderkey", "id"),
            _column("o_orderdate", "ordered_on", "DATE"),
            _column("p", "level", "INTEGER"),
            _column("o_orderstatus", "status", "DOUBLE"),
        ],
    )
    run = plan_task(spec, _resolver(spark, sf_dir, "orders"))
    typed = apply_types(run.result, run.columns)
    return typed.withColumn("ordered_on", F.date_format("ordered_on", "yyyy-MM-dd"))


@query(
    """
    SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled,
           round(sum(o_totalprice * 2) OVER (PARTITION BY o_orderpriority), 2) AS doubled_total
    FROM orders
    """
)
def step_order(spark, sf_dir):
    functions = {
        "ToSum": [
            {
                "IsEnable": "True",
                "Step": 2,
                "TargetColumn": "doubled",
                "Naming": "doubled_total",
                "GroupBy": {"IsEnable": "True", "TargetColumnList": ["o_orderpriority"]},
            }
        ],
        "ToArithmetic": [
            {
                "IsEnable": "True",
                "Step": 1,
                "Operator": "ADD",
                "Naming": "doubled",
                "TargetColumnList": [{"Column": "o_totalprice", "Order": 1}, {"Column": "o_totalprice", "Order": 2}],
            }
        ],
    }
    result = run_task(_task([_source("orders", functions=functions)], []), _resolver(spark, sf_dir, "orders"))
    return result.select("o_orderkey", F.round("doubled", 2).alias("doubled"), F.round("doubled_total", 2).alias("doubled_total"))


@query(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
                 CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 3 = 1 THEN l_suppkey END AS suppkey FROM lineitem),
         t AS (SELECT ps, count(*) AS parts FROM (SELECT l_suppkey AS ps, l_partkey FROM lineitem GROUP BY ALL) GROUP BY ps)
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CAST(suppkey AS DOUBLE) AS suppkey, s_name,
           CAST(parts AS DOUBLE) AS parts
    FROM l LEFT JOIN supplier ON suppkey = s_suppkey LEFT JOIN t ON suppkey = ps
    """
)
def task_hot_key(spark, sf_dir):
    """One supplier has a third of the lines, and another third has none; both joins are by this key."""
    key = "CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 3 = 1 THEN l_suppkey END AS suppkey"
    parts = "SELECT ps, count(*) AS parts FROM (SELECT DISTINCT l_suppkey AS ps, l_partkey FROM lineitem) GROUP BY ps"
    spec = _task(
        [
            _source("lineitem", f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, {key} FROM lineitem"),
            _source("supplier", "SELECT s_suppkey, s_name FROM supplier"),
            _source("lineitem", parts),
        ],
        [_merge("suppkey", "s_suppkey"), _merge("suppkey", "ps")],
    )
    result = run_task(spec, _resolver(spark, sf_dir, "lineitem", "supplier"), hot_bytes=0)
    return result.withColumns({c: F.col(c).cast("double") for c in ("suppkey", "parts")})
