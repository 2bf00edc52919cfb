"""Streams give what the batch checks give over the same rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators.detect import drifting_rows, outliers
from millrace.operators.profile import category_set, numeric_profile
from millrace.streaming.checks import drain, drain_to_table, drift_rows, flag_late, flag_rows, next_mark, read_files, split_late, window_verdicts
from millrace.workspace import fresh_dir


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@pytest.fixture()
def stream(spark, sf_dir, events):
    return read_files(spark, sf_dir, events.schema, "events.parquet")


def test_flags_equal_batch_outliers(stream, events):
    baseline = numeric_profile(events, ["value"])
    flagged = drain_to_table(flag_rows(stream, "value", baseline).where("beyond_3"), "flags")
    assert rows(flagged, "event_id") == rows(outliers(events, "value", baseline), "event_id")


@pytest.mark.parametrize("salts", [1, 3])
def test_drift_equals_batch(stream, events, salts):
    known = category_set(events.where("ts < '2024-01-03'"), ["user_id"])
    found = drain_to_table(drift_rows(stream, "user_id", known, salts=salts), "drift")
    assert rows(found, "event_id") == rows(drifting_rows(events, "user_id", known), "event_id")


def test_closed_windows_hold_all_their_rows(stream, events):
    verdicts = drain_to_table(window_verdicts(stream, "value", "ts", numeric_profile(events, ["value"]), 24), "windows")
    closed = dict(rows(verdicts, F.date_format("window_start", "yyyy-MM-dd").alias("d"), "rows"))
    days = dict(rows(events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).count()))
    assert closed and all(days[d] == n for d, n in closed.items())


def test_late_rows_over_two_runs_with_one_checkpoint(spark):
    folder, out, checkpoint = (fresh_dir(spark, n) for n in ("in", "out", "checkpoint"))
    first = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0,0,0,0,id) AS at FROM range(10)")
    first.write.parquet(folder)
    source = lambda: read_files(spark, folder, first.schema, "*.parquet")
    drain(source(), out, checkpoint)
    mark = next_mark(spark.read.parquet(out), "at")
    second = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0,0,0,0,id - 5) AS at FROM range(10, 20)")
    second.write.mode("append").parquet(folder)
    on_time, late = split_late(source(), "at", mark)
    late_rows = drain_to_table(late.where("id >= 10"), "late")
    drain(on_time, out, checkpoint)
    assert rows(late_rows, "id") == [(i,) for i in range(10, 15)]
    assert rows(spark.read.parquet(out), "id") == [(i,) for i in range(10)] + [(i,) for i in range(15, 20)]
    assert next_mark(spark.read.parquet(out), "at", mark) > mark
    assert split_late(first, "at", None)[1].count() == 0


def test_a_file_between_two_runs_lands_in_one_output(spark):
    """One drain writes late and on-time rows, so a file that comes later waits for the next run."""
    folder, out, checkpoint = (fresh_dir(spark, n) for n in ("in", "out", "checkpoint"))
    at = "timestamp'2024-01-01' + make_interval(0,0,0,0,%s) AS at"
    first = spark.sql(f"SELECT id, {at % 'id'} FROM range(10)")
    first.write.parquet(folder)
    run = lambda mark: drain(flag_late(read_files(spark, folder, first.schema, "*.parquet"), "at", mark), out, checkpoint, ["is_late"])
    run("2024-01-01 04:00:00")
    spark.sql(f"SELECT id + 10 AS id, {at % 'id + 3'} FROM range(10)").write.mode("append").parquet(folder)
    run("2024-01-01 09:00:00")
    found = spark.read.parquet(out)
    assert rows(found.where("is_late = 'true'"), "id") == [(i,) for i in [0, 1, 2, 3, 4, *range(10, 17)]]
    assert rows(found.where("is_late = 'false'"), "id") == [(i,) for i in [5, 6, 7, 8, 9, 17, 18, 19]]


def test_marks_of_tasks_survive_a_restart(spark):
    """Each task has its own mark; a drain that starts again at the checkpoint splits its rows in the same way."""
    from millrace.streaming.checks import drain, read_files
    from millrace.streaming.marks import flag_by_mark, split_outputs

    schema = "id long, task string, at timestamp_ntz, big long, note string"
    rows_ = lambda *x: spark.createDataFrame([(i, t, None if a is None else datetime(2024, 1, a), None if i % 2 else 2**62 + i, n) for i, t, a, n in x], schema)
    parts = [
        rows_((1, "a", 5, "x"), (2, "b", 9, None), (3, None, 7, "x"), (4, "a", 3, "x"), (5, "a", None, "x")),
        rows_((6, "a", 5, None), (7, "a", 6, "x"), (8, "b", 9, "x"), (9, None, 8, "x"), (10, "c", 1, "x"), (11, "a", None, "x")),
        rows_((12, "a", 6, "x"), (13, "c", 2, "x"), (14, None, 8, "x")),
    ]
    expected = {1: False, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False, 8: True, 9: False, 10: False, 11: False, 12: True, 13: False, 14: True}
    found = []
    for slots in (1, 3):
        root = fresh_dir(spark, "marks")
        for i, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = read_files(spark, f"{root}/in", part.schema)
            drain(flag_by_mark(stream, "task", "at", slots), f"{root}/out", f"{root}/checkpoint", ["is_late"])
            if i == 1:  # nothing new: nothing is written twice
                drain(flag_by_mark(stream, "task", "at", slots), f"{root}/out", f"{root}/checkpoint", ["is_late"])
        on_time, late = split_outputs(f"{root}/out", spark)
        assert {r.id: False for r in on_time.collect()} | {r.id: True for r in late.collect()} == expected
        assert on_time.count() + late.count() == 14
        whole = on_time.unionByName(late)
        found.append(rows(whole, *whole.columns))
        assert found[-1] == rows(parts[0].unionByName(parts[1]).unionByName(parts[2]), *whole.columns)
    assert found[0] == found[1]
