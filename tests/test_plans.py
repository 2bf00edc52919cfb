"""What the plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators.incremental import hash_sample, rows_above_key
from millrace.operators.joins import left_join
from millrace.operators.split_merge import split_merge
from millrace.operators.totals import global_total, group_total, mode_value


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def test_totals_use_no_window_and_no_cross_join(orders):
    built = global_total(group_total(orders, "ToSum", "o_totalprice", ["o_custkey"], "s"), "ToSum", "s", "t")
    text = plan(mode_value(built, "o_orderpriority", "m"))
    assert "Window" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "partial_sum" in text


def test_attached_total_is_not_joined_where_it_is_not_used(orders):
    built = group_total(group_total(orders, "ToSum", "o_totalprice", ["o_custkey"], "a"), "ToAvg", "o_totalprice", ["o_orderpriority"], "b")
    assert plan(built.select("o_orderkey", "b")).count("Join") == 1


def test_filters_and_columns_reach_the_scan(orders):
    text = plan(rows_above_key(orders, "o_orderkey", 10).select("o_orderkey", "o_custkey"))
    assert "GreaterThan(o_orderkey,10)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "Exchange" not in plan(hash_sample(orders, "o_orderkey", 5))


def test_only_used_columns_are_read_by_a_join(spark, sf_dir, orders):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = plan(left_join(orders, customers, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_name"))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_first_rows_are_an_aggregate(spark, sf_dir):
    text = plan(split_merge(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", "p_type", ["p_partkey"]))
    assert "Window" not in text and "partial_min_by" in text


def test_joins_do_not_depend_on_broadcast(spark, sf_dir):
    """With broadcasting switched off the same rows come from shuffled joins."""
    names = ["task_orders", "sum_group", "category_drift", "related_edges", "lineage_process_nodes", "run_iterations"]
    usual = {n: sorted(map(str, entry.queries()[n](spark, sf_dir).collect())) for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            assert sorted(map(str, entry.queries()[n](spark, sf_dir).collect())) == usual[n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_builds_a_cartesian_product(spark, sf_dir, name):
    if name == "model_select":
        pytest.skip("returns the ranking, not a plan over the table")
    assert "CartesianProduct" not in plan(entry.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("hot", ["7", "null"])
def test_skewed_rows_are_split(spark, hot):
    """A key with a third of the rows is cut into several tasks by the join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 200000, 1, 8).selectExpr(f"IF(id % 3 = 0, {hot}, id) AS k", "id AS v")
        out = group_total(df, "ToSum", "v", ["k"], "s")
        rows = out.selectExpr("bit_xor(hash(k, v, s)) AS x")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_a_hot_key_of_a_task_is_spread_over_tasks(spark):
    """One key has a third of the rows, in many copies, and no key a fifth: without adaptive splits, each task
    of the join gets its fair share."""
    from millrace.plans.runner import run_task
    from millrace.plans.spec import MergeKeys, Source, TaskSpec

    orders = spark.range(0, 120_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS k", "id % 3 AS v"
    )
    other = spark.range(50_000).selectExpr("id AS n", "id * 2 AS r")
    spec = TaskSpec("1", "t", (Source("mysql", table_name="orders"), Source("mysql", table_name="other")), (MergeKeys(("k",), ("n",)),))
    tables = {"orders": orders, "other": other}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    shares = {}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for name, least in (("plain", 1 << 60), ("salted", 0)):
            joined = run_task(spec, lambda source: tables[source.table_name], hot_bytes=least)
            assert name == "plain" or "__salt" in plan(joined)
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 120_000
            shares[name] = max(sizes) / 120_000
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert shares["plain"] > 0.33 and shares["salted"] < 0.25  # eight tasks


def test_small_tasks_are_not_searched_for_hot_keys(spark, sf_dir, monkeypatch):
    from millrace.plans import runner

    monkeypatch.setattr(runner, "hot_keys", lambda *_: pytest.fail("read at plan time"))
    entry.queries()["task_orders"](spark, sf_dir)
