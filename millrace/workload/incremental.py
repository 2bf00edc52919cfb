"""New rows, size probes, samples, marks and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.incremental import (
    advance_marks,
    hash_sample,
    rows_above_key,
    rows_after,
    run_counters,
    run_iterations,
    sample_rows,
    size_probe,
)
from millrace.operators.model import hash_split
from millrace.workload.registry import query, table


@query("SELECT event_id, user_id FROM events WHERE event_id > 4000")
def incr_pk(spark, sf_dir):
    return rows_above_key(table(spark, sf_dir, "events"), "event_id", 4000).select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-16 00:00:00'")
def incr_ts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rows_after(events, "ts", "2024-01-16 00:00:00.654321", whole_seconds=True).select("event_id", "value")


@query(
    """
    SELECT count(*) AS row_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS key_min,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS key_max
    FROM events WHERE ts > TIMESTAMP '2024-01-16 00:00:00'
    """,
    name="size_probe",
)
def size_of_new_rows(spark, sf_dir):
    probe = size_probe(rows_after(table(spark, sf_dir, "events"), "ts", "2024-01-16 00:00:00"), ts="ts")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("key_min", "key_max")}
    return probe.withColumns(shown)


_HASH = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT)"


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_HASH.format('o_orderkey')} % 100 < 20", name="hash_sample")
def sample_percent(spark, sf_dir):
    return hash_sample(table(spark, sf_dir, "orders"), "o_orderkey", 20).select("o_orderkey", "o_totalprice")


@query(f"SELECT event_id, value FROM events ORDER BY {_HASH.format('event_id')}, event_id LIMIT 1000")
def sample_top_n(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 1000)


@query("SELECT event_type AS task_id, max(event_id) AS mark FROM events GROUP BY 1")
def marks_advance(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "task_id")
    first, later = events.where("ts < '2024-01-16'"), events.where("ts >= '2024-01-16'")
    marks = first.groupBy("task_id").agg(F.max("event_id").alias("mark"))
    probes = later.groupBy("task_id").agg(F.max("event_id").alias("key_max"))
    return advance_marks(marks, probes)


def _results(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS task_id",
        "event_id",
        "ts",
        "value < 60 AS validation_result",
        "CASE WHEN event_type = 'view' THEN 'Manual' ELSE 'Auto' END AS execution_type",
    )


@query(
    """
    SELECT user_id AS task_id, count(*) AS executions, count(*) FILTER (value < 60) AS successes,
           count(*) FILTER (value >= 60) AS failures, count(*) < 60 AS enabled
    FROM events GROUP BY 1
    """,
    name="run_counters",
)
def counters_per_task(spark, sf_dir):
    return run_counters(_results(spark, sf_dir), expect=60)


@query(
    """
    SELECT event_id, user_id AS task_id,
           CASE WHEN event_type = 'view' THEN -1
                ELSE row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts, event_id) END AS iteration
    FROM events
    """,
    name="run_iterations",
)
def iterations_per_task(spark, sf_dir):
    return run_iterations(_results(spark, sf_dir), "ts", ["event_id"]).select("event_id", "task_id", "iteration")


@query(
    """
    SELECT o_orderkey, CAST('0x' || substr(md5('42' || chr(1) || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 AS is_train
    FROM orders
    """
)
def split_80_20(spark, sf_dir):
    return hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
