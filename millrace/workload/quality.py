"""Baseline profiles and checks. The first half of January is the baseline, the rest is checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from millrace.operators.custom import (
    PartialStatistic,
    custom_check,
    custom_statistic,
    register_check,
    register_statistic,
)
from millrace.operators.detect import (
    check_categories,
    check_numbers,
    drifting_rows,
    outliers,
    quality_report,
    run_quality,
    take_baseline,
    unseen_values,
)
from millrace.operators.number_store import NumberStore
from millrace.operators.profile import category_set, central_moments, numeric_profile
from millrace.operators.quantiles import exact_quantiles
from millrace.plans.quality import QualitySpec
from millrace.workload.registry import query, table
from millrace.workspace import fresh_dir

SPLIT = "2024-01-16"
FIRST_DAY = "2024-01-02"
SHARE = 0.05


def baseline_rows(spark, sf_dir, until=SPLIT):
    return table(spark, sf_dir, "events").where(f"ts < '{until}'")


def checked_rows(spark, sf_dir, since=SPLIT):
    return table(spark, sf_dir, "events").where(f"ts >= '{since}'")


def value_baseline(spark, sf_dir):
    return numeric_profile(baseline_rows(spark, sf_dir), ["value"], {"value": SHARE})


def known_users(spark, sf_dir):
    return category_set(baseline_rows(spark, sf_dir, FIRST_DAY), ["user_id"])


_PROFILE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


def _profile_sql(column: str) -> str:
    return f"""
    SELECT '{column}' AS "column", count({column}) AS rows, CAST(round_even(avg({column}), 0) AS BIGINT) AS mean,
           CAST(round_even(stddev_samp({column}), 0) AS BIGINT) AS deviation, min({column}) AS min, max({column}) AS max,
           {"CAST(0.04 AS DOUBLE)" if column == "l_quantity" else "CAST(NULL AS DOUBLE)"} AS bound,
           {"CAST(5.0 AS DOUBLE)" if column == "l_quantity" else "CAST(NULL AS DOUBLE)"} AS multiplier
    FROM lineitem
    """


@query(" UNION ALL ".join(map(_profile_sql, _PROFILE_COLUMNS)))
def profile_numeric(spark, sf_dir):
    return numeric_profile(table(spark, sf_dir, "lineitem"), _PROFILE_COLUMNS, {"l_quantity": 0.04})


_DECILES_SQL = """
    SELECT c AS "column", p / 10.0::DOUBLE AS probability, round(q[p + 1], 4) AS quantile
    FROM (SELECT 'o_totalprice' AS c, quantile_cont(o_totalprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM orders
          UNION ALL
          SELECT 'o_custkey', quantile_cont(CAST(o_custkey AS DOUBLE), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FROM orders),
         (SELECT CAST(range AS INTEGER) AS p FROM range(11))
    """


def _deciles(spark, sf_dir, columns=("o_totalprice", "o_custkey")):
    out = exact_quantiles(table(spark, sf_dir, "orders"), columns)
    return out.withColumn("quantile", F.round("quantile", 4))


@query(_DECILES_SQL)
def profile_deciles(spark, sf_dir):
    return _deciles(spark, sf_dir)


@query(_DECILES_SQL)
def profile_deciles_distributed(spark, sf_dir):
    """Each column by itself gives what both give together."""
    return _deciles(spark, sf_dir, ["o_totalprice"]).unionByName(_deciles(spark, sf_dir, ["o_custkey"]))


_FOLDED = ("value", "user_id")


def _folded_store(spark, sf_dir):
    """The state of two batches; the second one comes twice, as after a crash."""
    store = NumberStore(spark, fresh_dir(spark, "numbers"))
    store.add(baseline_rows(spark, sf_dir), _FOLDED, "old")
    for _ in range(2):
        store.add(checked_rows(spark, sf_dir), _FOLDED, "new")
    return store


@query(
    """
    SELECT c AS "column", p / 10.0::DOUBLE AS probability, round(q[p + 1], 4) AS quantile
    FROM (SELECT 'value' AS c, quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM events
          UNION ALL
          SELECT 'user_id', quantile_cont(CAST(user_id AS DOUBLE), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FROM events),
         (SELECT CAST(range AS INTEGER) AS p FROM range(11))
    """
)
def deciles_folded(spark, sf_dir):
    """Deciles of all rows from the stored state of their parts."""
    return _folded_store(spark, sf_dir).quantiles().withColumn("quantile", F.round("quantile", 4))


@query(
    """
    WITH m AS (SELECT avg(value) AS mv, avg(user_id) AS mu FROM events)
    SELECT 'value' AS "column", 3 AS "order", round(avg(pow(value - mv, 3)) / pow(stddev_pop(value), 3), 6) AS moment FROM events, m
    UNION ALL SELECT 'value', 4, round(avg(pow(value - mv, 4)) / pow(stddev_pop(value), 4), 6) FROM events, m
    UNION ALL SELECT 'user_id', 3, round(avg(pow(user_id - mu, 3)) / pow(stddev_pop(user_id), 3), 6) FROM events, m
    UNION ALL SELECT 'user_id', 4, round(avg(pow(user_id - mu, 4)) / pow(stddev_pop(user_id), 4), 6) FROM events, m
    """
)
def moments_folded(spark, sf_dir):
    """Skewness and kurtosis of all rows from the stored state of their parts."""
    found = _folded_store(spark, sf_dir).moments(_FOLDED)
    widths = table(spark, sf_dir, "events").agg(*[F.stddev_pop(c).alias(c) for c in _FOLDED]).unpivot([], list(_FOLDED), "column", "width")
    scaled = F.round(F.col("moment") / F.pow("width", "order"), 6)
    return found.join(widths, "column").select("column", "order", scaled.alias("moment"))


@query(
    """
    WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem)
    SELECT 'l_quantity' AS "column", 3 AS "order", round(avg(pow(l_quantity - mq, 3)), 4) AS moment FROM lineitem, m
    UNION ALL SELECT 'l_quantity', 4, round(avg(pow(l_quantity - mq, 4)), 4) FROM lineitem, m
    UNION ALL SELECT 'l_discount', 3, round(avg(pow(l_discount - md, 3)), 4) FROM lineitem, m
    UNION ALL SELECT 'l_discount', 4, round(avg(pow(l_discount - md, 4)), 4) FROM lineitem, m
    """
)
def profile_moments(spark, sf_dir):
    out = central_moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 4)
    return out.withColumn("moment", F.round("moment", 4))


@query(
    """
    SELECT DISTINCT 'event_type' AS "column", event_type AS value FROM events
    UNION ALL SELECT DISTINCT 'user_id', CAST(user_id AS VARCHAR) FROM events
    """,
    name="category_set",
)
def category_values(spark, sf_dir):
    return category_set(table(spark, sf_dir, "events"), ["event_type", "user_id"])


_BASE_SQL = f"""
    b AS (SELECT round_even(avg(value), 0) AS m, round_even(stddev_samp(value), 0) AS s FROM events WHERE ts < '{SPLIT}'),
    n AS (SELECT * FROM events WHERE ts >= '{SPLIT}')
"""


def _outlier_sql(k: str) -> str:
    return f"WITH {_BASE_SQL} SELECT event_id, value FROM n, b WHERE value > m + {k} * s OR value < m - {k} * s"


def _outliers(spark, sf_dir, k):
    return outliers(checked_rows(spark, sf_dir), "value", value_baseline(spark, sf_dir), k).select("event_id", "value")


@query(_outlier_sql("3"))
def outliers_3(spark, sf_dir):
    return _outliers(spark, sf_dir, 3)


@query(_outlier_sql("5"))
def outliers_5(spark, sf_dir):
    return _outliers(spark, sf_dir, 5)


@query(_outlier_sql("4.47"))
def outliers_chebyshev(spark, sf_dir):
    return _outliers(spark, sf_dir, "custom")


@query(
    f"""
    WITH {_BASE_SQL}, c AS (
      SELECT count(*) AS rows, CAST(round_even(avg(value), 0) AS BIGINT) AS mean,
             CAST(round_even(stddev_samp(value), 0) AS BIGINT) AS deviation, min(value) AS min, max(value) AS max,
             count(*) FILTER (value > m + 3 * s OR value < m - 3 * s) AS beyond_3,
             count(*) FILTER (value > m + 5 * s OR value < m - 5 * s) AS beyond_5,
             count(*) FILTER (value > m + 4.47 * s OR value < m - 4.47 * s) AS beyond_custom FROM n, b)
    SELECT 'value' AS "column", *, beyond_custom <= rows * {SHARE} AS is_pass FROM c
    """
)
def verdict_numeric(spark, sf_dir):
    return check_numbers(checked_rows(spark, sf_dir), ["value"], value_baseline(spark, sf_dir)).drop("reason")


_DRIFT_SQL = f"""
    k AS (SELECT DISTINCT user_id FROM events WHERE ts < '{FIRST_DAY}'),
    n AS (SELECT event_id, nullif(user_id, 5) AS user_id, event_type FROM events WHERE ts >= '{FIRST_DAY}'),
    d AS (SELECT * FROM n WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM k))
"""


def _new_users(spark, sf_dir):
    return checked_rows(spark, sf_dir, FIRST_DAY).selectExpr("event_id", "nullif(user_id, 5) AS user_id", "event_type")


@query(f"WITH {_DRIFT_SQL} SELECT event_id, CAST(user_id AS DOUBLE) AS user_id FROM d")
def category_drift(spark, sf_dir):
    rows = drifting_rows(_new_users(spark, sf_dir), "user_id", known_users(spark, sf_dir))
    return rows.select("event_id", F.col("user_id").cast("double").alias("user_id"))


@query(f"""WITH {_DRIFT_SQL} SELECT 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value, count(*) AS rows FROM d GROUP BY user_id""")
def category_unseen(spark, sf_dir):
    return unseen_values(_new_users(spark, sf_dir), ["user_id"], known_users(spark, sf_dir))


@query(
    f"""
    WITH {_DRIFT_SQL}
    SELECT 'user_id' AS "column", (SELECT count(*) FROM n) AS rows, count(*) AS unseen_rows,
           count(DISTINCT coalesce(user_id, -1)) AS unseen_values, count(*) = 0 AS is_pass FROM d
    UNION ALL SELECT 'event_type', (SELECT count(*) FROM n), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true
    """
)
def verdict_category(spark, sf_dir):
    known = category_set(baseline_rows(spark, sf_dir, FIRST_DAY), ["user_id", "event_type"])
    return check_categories(_new_users(spark, sf_dir), ["user_id", "event_type"], known)


register_statistic("mean", lambda c: F.round(F.avg(c), 4))
register_statistic(
    "log_mean",
    PartialStatistic(
        start=lambda values: (float(np.log1p(values).sum()), int(values.count())),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        finish=lambda state: f"{state[0] / state[1]:.4f}",
    ),
)
register_check(
    "near_mean",
    lambda c, data: F.struct(
        (F.abs(F.avg(c) - data.cast("double")) < 2).alias("pass"),
        F.concat(F.lit("moved by "), F.format_number(F.abs(F.avg(c) - data.cast("double")), 3)).alias("log"),
    ),
)


@query(
    f"""
    WITH b AS (SELECT round(avg(value), 4) AS data, avg(ln(1 + value)) AS log_mean FROM events WHERE ts < '{SPLIT}'),
         n AS (SELECT avg(value) AS m FROM events WHERE ts >= '{SPLIT}')
    SELECT 'value' AS "column", abs(m - data) < 2 AS is_pass, printf('moved by %.3f', abs(m - data)) AS log,
           printf('%.4f', log_mean) AS log_mean
    FROM n, b
    """,
    name="custom_check",
)
def custom_checks(spark, sf_dir):
    base = baseline_rows(spark, sf_dir)
    stored = custom_statistic(base, "value", "mean").select("data").scalar()
    other = custom_statistic(base, "value", "log_mean").select("data").scalar()
    return custom_check(checked_rows(spark, sf_dir), "value", "near_mean", stored).withColumn("log_mean", other)


@query(
    f"""
    WITH b AS (SELECT round_even(avg(value), 0) AS m, round_even(stddev_samp(value), 0) AS s FROM events WHERE ts < '{FIRST_DAY}'),
         k AS (SELECT DISTINCT user_id FROM events WHERE ts < '{FIRST_DAY}'),
         n AS (SELECT * FROM events WHERE ts >= '{FIRST_DAY}')
    SELECT '7' AS task_id, true AS task_status, count(*) AS sample_num,
           CAST(min(event_id) AS VARCHAR) AS key_min, CAST(max(event_id) AS VARCHAR) AS key_max,
           count(*) FILTER (value > m + 3 * s OR value < m - 3 * s) AS beyond_3,
           count(*) FILTER (user_id NOT IN (SELECT user_id FROM k)) AS unseen_users,
           count(*) FILTER (value > m + 3 * s OR value < m - 3 * s) <= count(*) / 9.0
             AND count(*) FILTER (user_id NOT IN (SELECT user_id FROM k)) = 0 AS validation_result,
           'Auto' AS execution_type
    FROM n, b
    """,
    name="quality_report",
)
def quality_run(spark, sf_dir):
    spec = QualitySpec(task_id="7", name="events", key="EVENT_ID", numeric=("Value",), category=("event_type", "user_id"))
    baseline = take_baseline(baseline_rows(spark, sf_dir, FIRST_DAY), spec)
    report = quality_report(checked_rows(spark, sf_dir, FIRST_DAY), spec, baseline)

    def number(column, name):
        inner = F.get_json_object("detail", f"$.{column}.detail")
        return F.get_json_object(inner, f"$.{name}").cast("bigint")

    return report.select(
        "task_id",
        "task_status",
        "validation_result",
        "sample_num",
        "key_min",
        "key_max",
        number("value", "beyond_3").alias("beyond_3"),
        number("user_id", "unseen_rows").alias("unseen_users"),
        "execution_type",
    )


@query(
    """
    SELECT '7' AS task_id, false AS validation_result, count(*) AS sample_num,
           'No new data between two detection periods.' AS error_msg
    FROM events WHERE event_id > (SELECT max(event_id) FROM events)
    """
)
def no_new_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    top = events.agg(F.max("event_id")).first()[0]
    spec = QualitySpec(task_id="7", key="event_id", key_mark=top, numeric=("value",))
    report = quality_report(events, spec, take_baseline(baseline_rows(spark, sf_dir), _plain(spec)))
    return report.select("task_id", "validation_result", "sample_num", "error_msg")


def _plain(spec):
    return QualitySpec(task_id=spec.task_id, key=spec.key, numeric=spec.numeric)


@query(
    f"""
    WITH o AS (SELECT * FROM events WHERE ts < '{FIRST_DAY}'),
         b AS (SELECT round_even(avg(value), 0) AS m, round_even(stddev_samp(value), 0) AS s FROM o),
         k AS (SELECT DISTINCT event_type FROM o),
         n AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM o)),
         one AS (SELECT count(*) AS sample_num, max(ts) AS mark,
                   count(*) FILTER (value > m + 3 * s OR value < m - 3 * s) <= count(*) / 9.0
                   AND count(*) FILTER (event_type NOT IN (SELECT event_type FROM k)) = 0 AS validation_result
                 FROM n, b)
    SELECT i AS iteration, CASE WHEN i < 0 THEN 'Manual' ELSE 'Auto' END AS execution_type, true AS task_status,
           CASE WHEN i = 2 THEN 0 ELSE sample_num END AS sample_num, i <> 2 AND validation_result AS validation_result,
           CASE WHEN i <> 2 THEN mark END AS mark,
           CASE WHEN i = 2 THEN 'No new data between two detection periods.' END AS error_msg
    FROM one, (VALUES (-1), (1), (2)) AS v(i)
    """
)
def quality_two_runs(spark, sf_dir):
    """Profile, a manual run, an automatic one over the same new rows, and one that finds nothing new."""
    spec = QualitySpec(task_id="8", name="events", ts="TS", numeric=("value",), category=("event_type",), expect_count=2)
    base, results = fresh_dir(spark, "baseline"), fresh_dir(spark, "results")
    events = table(spark, sf_dir, "events")
    run_quality(spark, baseline_rows(spark, sf_dir, FIRST_DAY), spec, base, results)
    for manual in (True, False, False, False):  # the last is beyond the expected number
        run_quality(spark, events, spec, base, results, manual)
    return spark.read.parquet(results).select(
        "iteration", "execution_type", "task_status", "sample_num", "validation_result",
        F.col("key_max").cast("timestamp_ntz").alias("mark"), "error_msg",
    )
