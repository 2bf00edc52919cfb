"""Column functions: totals, modes, pivots, arithmetic, combine, split-merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import arithmetic, combine
from millrace.operators.split_merge import split_merge
from millrace.operators.totals import global_total, group_total, mode_value, pivot
from millrace.workload.registry import query, table

# means are taken over whole cents: exact in any order of summation
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_GROUPED = "CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS grp"


def _grouped(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", _GROUPED, "o_totalprice", f"{CENTS} AS cents")


def _group_sql(total: str, name: str) -> str:
    return f"""
    WITH o AS (SELECT o_orderkey, {_GROUPED}, o_totalprice, {CENTS} AS cents FROM orders),
         t AS (SELECT grp, {total} AS {name} FROM o WHERE grp IS NOT NULL GROUP BY grp)
    SELECT o_orderkey, CAST(grp AS DOUBLE) AS grp, {name} FROM o LEFT JOIN t USING (grp)
    """


def _shown(out, name):
    return out.select("o_orderkey", F.col("grp").cast("double").alias("grp"), name)


@query(_group_sql("round(sum(o_totalprice), 4)", "grp_sum"))
def sum_group(spark, sf_dir):
    out = group_total(_grouped(spark, sf_dir), "ToSum", "o_totalprice", ["grp"], "grp_sum")
    return _shown(out.withColumn("grp_sum", F.round("grp_sum", 4)), "grp_sum")


@query(_group_sql("avg(cents)", "grp_avg"))
def avg_group(spark, sf_dir):
    out = group_total(_grouped(spark, sf_dir), "ToAvg", "cents", ["grp"], "grp_avg")
    return _shown(out, "grp_avg")


@query("SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER () AS total FROM lineitem")
def sum_global(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return global_total(lines, "ToSum", "l_quantity", "total")


@query(f"SELECT o_orderkey, {CENTS} AS cents, avg({CENTS}) OVER () AS mean FROM orders")
def avg_global(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{CENTS} AS cents")
    return global_total(orders, "ToAvg", "cents", "mean")


@query(
    """
    WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders),
         m AS (SELECT priority FROM o WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)
    SELECT o.o_orderkey, o.priority, m.priority AS usual FROM o, m
    """,
    name="mode_value",
)
def mode_priority(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "nullif(o_orderpriority, '1-URGENT') AS priority")
    return mode_value(orders, "priority", "usual")


_STATUSES = ("F", "O", "P")


def _pivot_sql(function: str) -> str:
    cells = ", ".join(
        f"CAST({function}({CENTS}) FILTER (o_orderstatus = '{s}') AS DOUBLE) AS {s}" for s in _STATUSES
    )
    return f"SELECT o_custkey, {cells} FROM orders GROUP BY o_custkey"


def _pivoted(spark, sf_dir, function):
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderstatus", f"{CENTS} AS cents")
    out = pivot(orders, "o_orderstatus", "cents", function, ["o_custkey"], _STATUSES)
    return out.withColumns({s: F.col(s).cast("double") for s in _STATUSES})


@query(_pivot_sql("max"))
def pivot_max(spark, sf_dir):
    return _pivoted(spark, sf_dir, "MAX")


@query(_pivot_sql("sum"))
def pivot_sum(spark, sf_dir):
    return _pivoted(spark, sf_dir, "SUM")


@query(_pivot_sql("avg"))
def pivot_avg(spark, sf_dir):
    return _pivoted(spark, sf_dir, "AVG")


@query(
    """
    SELECT round(avg(value) FILTER (event_type = 'click'), 4) AS click,
           round(avg(value) FILTER (event_type = 'error'), 4) AS error,
           round(avg(value) FILTER (event_type = 'purchase'), 4) AS purchase,
           round(avg(value) FILTER (event_type = 'signup'), 4) AS signup
    FROM events
    """
)
def pivot_global(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("nullif(event_type, 'view') AS kind", "value")
    out = pivot(events, "kind", "value", "AVG")
    return out.select([F.round(c, 4).alias(c) for c in out.columns])


@query(
    """
    SELECT l_orderkey, l_linenumber,
           l_orderkey || '-' || l_linenumber || '-' || coalesce(nullif(l_returnflag, 'N'), '') || '-' || l_linestatus AS tag
    FROM lineitem
    """,
    name="combine",
)
def combine_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "nullif(l_returnflag, 'N') AS flag", "l_linestatus"
    )
    out = combine(lines, ["l_orderkey", "l_linenumber", "flag", "l_linestatus"], "-", "tag")
    return out.select("l_orderkey", "l_linenumber", "tag")


def _arith_sql(expression: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, round({expression}, 6) AS result FROM lineitem"


def _arith(spark, sf_dir, operator, columns):
    out = arithmetic(table(spark, sf_dir, "lineitem"), operator, columns, "result")
    return out.select("l_orderkey", "l_linenumber", F.round("result", 6).alias("result"))


@query(_arith_sql("l_quantity + l_tax + l_linenumber"))
def arith_add(spark, sf_dir):
    return _arith(spark, sf_dir, "ADD", ["l_quantity", "l_tax", "l_linenumber"])


@query(_arith_sql("l_extendedprice - l_quantity - l_discount"))
def arith_sub(spark, sf_dir):
    return _arith(spark, sf_dir, "SUB", ["l_extendedprice", "l_quantity", "l_discount"])


@query(_arith_sql("l_quantity * l_discount * l_tax"))
def arith_mul(spark, sf_dir):
    return _arith(spark, sf_dir, "MUL", ["l_quantity", "l_discount", "l_tax"])


@query(_arith_sql("l_extendedprice / l_quantity / nullif(l_tax, 0)"))
def arith_div(spark, sf_dir):
    return _arith(spark, sf_dir, "DIV", ["l_extendedprice", "l_quantity", "l_tax"])


@query(
    """
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
    UNION ALL
    SELECT p_partkey, p_name, p_brand, p_brand, p_size, p_retailprice FROM f WHERE rn = 1
    """,
    name="split_merge",
)
def split_merge_lots(spark, sf_dir):
    return split_merge(table(spark, sf_dir, "part"), "p_brand", "p_type", ["p_partkey"])
