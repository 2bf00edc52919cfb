"""Streaming checks over the event files, drained with what is available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.streaming.checks import (
    drain,
    drain_to_table,
    drift_rows,
    flag_late,
    flag_rows,
    next_mark,
    read_files,
    window_verdicts,
)
from millrace.streaming.marks import flag_by_mark, split_outputs
from millrace.workload import quality
from millrace.workload.quality import FIRST_DAY, SHARE, SPLIT
from millrace.workload.registry import query, table
from millrace.workspace import fresh_dir, stored


def value_baseline(spark, sf_dir):
    """Stored first, or each micro-batch would profile the baseline rows again."""
    return stored(quality.value_baseline(spark, sf_dir), "baseline")


def known_users(spark, sf_dir):
    return stored(quality.known_users(spark, sf_dir), "known")


def _stream(spark, sf_dir):
    return read_files(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


_BASE = f"""
    b AS (SELECT round_even(avg(value), 0) AS m, round_even(stddev_samp(value), 0) AS s FROM events WHERE ts < '{SPLIT}'),
    f AS (SELECT *, value > m + 3 * s OR value < m - 3 * s AS o3, value > m + 5 * s OR value < m - 5 * s AS o5,
                 value > m + 4.47 * s OR value < m - 4.47 * s AS oc FROM events, b)
"""


@query(
    f"""
    WITH {_BASE}
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS rows,
           count(*) FILTER (o3) AS beyond_3, count(*) FILTER (o5) AS beyond_5, count(*) FILTER (oc) AS beyond_custom,
           count(*) FILTER (oc) <= count(*) * {SHARE} AS is_pass
    FROM f GROUP BY date_trunc('day', ts)
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    """
)
def stream_window_verdict(spark, sf_dir):
    """Closed windows only: the last ones stay open until the watermark passes them."""
    verdicts = window_verdicts(_stream(spark, sf_dir), "value", "ts", value_baseline(spark, sf_dir), 24)
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz"))
    shown = F.date_format(start, "yyyy-MM-dd HH:mm:ss")
    return drain_to_table(verdicts, "verdicts").withColumn("window_start", shown).drop("window_end")


@query(f"WITH {_BASE} SELECT event_id, o3 AS beyond_3, o5 AS beyond_5, oc AS beyond_custom FROM f")
def stream_detect(spark, sf_dir):
    flagged = flag_rows(_stream(spark, sf_dir), "value", value_baseline(spark, sf_dir))
    return drain_to_table(flagged.select("event_id", "beyond_3", "beyond_5", "beyond_custom"), "flags")


_DRIFT = f"""
    SELECT event_id, user_id FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < '{FIRST_DAY}')
"""


@query(_DRIFT)
def stream_drift(spark, sf_dir):
    stream = _stream(spark, sf_dir).select("event_id", "user_id")
    return drain_to_table(drift_rows(stream, "user_id", known_users(spark, sf_dir)), "drift")


@query(_DRIFT)
def stream_drift_salted(spark, sf_dir):
    """The same with fewer salts."""
    stream = _stream(spark, sf_dir).select("event_id", "user_id")
    return drain_to_table(drift_rows(stream, "user_id", known_users(spark, sf_dir), salts=8), "drift")


@query(
    """
    WITH a AS (SELECT event_id, ts, ts < TIMESTAMP '2024-01-20' AND event_type <> 'error' AS early FROM events)
    SELECT event_id, NOT early AND ts <= (SELECT max(ts) FROM a WHERE early) AS is_late FROM a
    """
)
def stream_late(spark, sf_dir):
    """Two runs: errors of the first weeks arrive only in the second run, below its mark."""
    early = "ts < timestamp_ntz'2024-01-20' AND event_type <> 'error'"
    first = drain_to_table(_stream(spark, sf_dir).where(early).select("event_id", "ts"), "first")
    mark = next_mark(first, "ts")
    second = _stream(spark, sf_dir).where(f"NOT ({early})").select("event_id", "ts")
    both = drain_to_table(flag_late(second, "ts", mark), "second").select("event_id", "is_late")
    return first.select("event_id", F.lit(False).alias("is_late")).unionByName(both)


@query(
    """
    WITH a AS (SELECT event_id, event_type, ts,
                 ts < CASE WHEN event_type IN ('view', 'click') THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-10' END
                 AND user_id % 7 <> 3 AS early FROM events),
         m AS (SELECT event_type, max(ts) AS mark FROM a WHERE early GROUP BY event_type)
    SELECT event_id, event_type, NOT early AND ts <= mark AS is_late FROM a JOIN m USING (event_type)
    """
)
def stream_marks(spark, sf_dir):
    """Two drains of one stream with a task for each event type; the users left out of the first arrive late."""
    events = table(spark, sf_dir, "events")
    early = (
        "ts < IF(event_type IN ('view', 'click'), timestamp_ntz'2024-01-20', timestamp_ntz'2024-01-10')"
        " AND user_id % 7 <> 3"
    )
    root = fresh_dir(spark, "marks")
    for part in (early, f"NOT ({early})"):
        events.where(part).write.mode("append").parquet(f"{root}/in")
        stream = read_files(spark, f"{root}/in", events.schema).select("event_id", "event_type", "ts")
        drain(flag_by_mark(stream, "event_type", "ts"), f"{root}/out", f"{root}/checkpoint", ["is_late"])
    on_time, late = split_outputs(f"{root}/out", spark)
    both = on_time.withColumn("is_late", F.lit(False)).unionByName(late.withColumn("is_late", F.lit(True)))
    return both.select("event_id", "event_type", "is_late")
