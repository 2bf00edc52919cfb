"""Checks of new rows against a stored baseline."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, quoted
from millrace.operators.custom import PartialStatistic, custom_statistic, named_check, named_statistic
from millrace.operators.incremental import rows_above_key, rows_after, size_probe, stored_mark
from millrace.operators.profile import category_counts, profile_of
from millrace.operators.states import category_counts_of, custom_of, deciles, number_profiles, scan, size_of
from millrace.plans.quality import QualitySpec

NEAR, FAR = 3, 5  # fixed values: deviations of the two standard bounds
NEAR_SHARE = 9  # fixed value: more than 1/9 of the rows beyond the near bound fails
NO_BASELINE, NO_NUMBERS = "no baseline", "no numbers"
NO_NEW_ROWS = "No new data between two detection periods."  # fixed text


def baseline_bounds(baseline: DataFrame) -> Column:
    """The numeric baseline (one row per checked column) as a map, through a scalar subquery."""
    entry = F.struct("column", F.struct("mean", "deviation", "bound", "multiplier"))
    return baseline.agg(F.map_from_entries(F.collect_list(entry)).alias("bounds")).scalar()


def beyond(value: Column, mean: Column, deviation: Column, multiplier: Column | float) -> Column:
    """Strictly outside mean +/- multiplier * deviation."""
    width = deviation * multiplier
    return (value > mean + width) | (value < mean - width)


def _multiplier(bounds: Column, k: float | str) -> Column:
    return bounds["multiplier"] if k == "custom" else F.lit(k)


def outliers(df: DataFrame, column: str, baseline: DataFrame, k: float | str = NEAR) -> DataFrame:
    """The rows whose value lies beyond k deviations; `k="custom"` takes the stored multiplier."""
    b = baseline_bounds(baseline)[column]
    return df.where(beyond(as_double(quoted(column)), b["mean"], b["deviation"], _multiplier(b, k)))


def numeric_passes(rows: Column, near: Column, custom: Column, bound: Column) -> Column:
    """With a bound, at most that share may lie beyond the custom multiplier, else 1/9 beyond 3."""
    return F.when(bound.isNotNull(), custom <= rows * bound).otherwise(near <= rows / NEAR_SHARE)


def check_numbers(df: DataFrame, columns: Sequence[str], baseline: DataFrame) -> DataFrame:
    """One row per column with outlier counts and verdict; all columns in one scan.

    A column without a baseline, or without a number among the rows, fails and has a `reason`.
    """
    bounds = baseline_bounds(baseline)
    measures = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v, b = as_double(quoted(c)), bounds[c]
        measures += [
            F.count_if(beyond(v, b["mean"], b["deviation"], F.lit(NEAR))).alias(f"near{i}"),
            F.count_if(beyond(v, b["mean"], b["deviation"], F.lit(FAR))).alias(f"far{i}"),
            F.count_if(beyond(v, b["mean"], b["deviation"], b["multiplier"])).alias(f"custom{i}"),
            F.bround(F.avg(v)).cast("bigint").alias(f"mean{i}"),
            F.bround(F.coalesce(F.stddev_samp(v), F.lit(0.0))).cast("bigint").alias(f"dev{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.count(v).alias(f"numbers{i}"),
        ]
    counted = df.agg(*measures)
    reasons = [
        F.when(bounds[c]["mean"].isNull(), NO_BASELINE).when(F.col(f"numbers{i}") == 0, NO_NUMBERS)
        for i, c in enumerate(columns)
    ]
    per_column = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"dev{i}").alias("deviation"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            F.col(f"near{i}").alias("beyond_3"),
            F.col(f"far{i}").alias("beyond_5"),
            F.when(bounds[c]["bound"].isNotNull(), F.col(f"custom{i}")).alias("beyond_custom"),
            (
                reasons[i].isNull()
                & numeric_passes(F.col("rows"), F.col(f"near{i}"), F.col(f"custom{i}"), bounds[c]["bound"])
            ).alias("is_pass"),
            reasons[i].alias("reason"),
        )
        for i, c in enumerate(columns)
    ]
    return counted.select(F.explode(F.array(*per_column)).alias("c")).select("c.*")


def unseen_values(df: DataFrame, columns: Sequence[str], known: DataFrame) -> DataFrame:
    """Rows (column, value, rows) for values missing from the baseline; null is never known.

    Values are counted before the anti-join, so a value that fills a third of the table costs
    one row, and known sets of any size are joined, not broadcast by force.
    """
    counts = category_counts(df, columns)
    return counts.join(known.select("column", "value"), ["column", "value"], "left_anti")


def drifting_rows(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """The rows of the table whose category is not in the baseline."""
    values = known.where(F.col("column") == column).select(F.col("value").alias("__known"))
    return df.join(values, quoted(column).cast("string") == F.col("__known"), "left_anti")


def check_categories(df: DataFrame, columns: Sequence[str], known: DataFrame) -> DataFrame:
    """One row per column: how many rows and values are new; any new value fails the column."""
    return category_verdicts(category_counts(df, columns), known)


def category_verdicts(counts: DataFrame, known: DataFrame) -> DataFrame:
    """The same from counts (column, value, rows)."""
    seen = known.select("column", "value", F.lit(True).alias("seen"))
    joined = counts.join(seen, ["column", "value"], "left")
    unseen = F.col("seen").isNull()
    return joined.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(unseen, F.col("rows"))), F.lit(0)).alias("unseen_rows"),
        F.count_if(unseen).alias("unseen_values"),
        (F.count_if(unseen) == 0).alias("is_pass"),
    )


def number_verdicts(states: DataFrame, baseline: DataFrame, moments: int = 0) -> DataFrame:
    """`check_numbers` and the shape of the rows, from scanned states."""
    entry = F.struct(F.col("mean").isNotNull().alias("known"), "mean", "deviation", "bound", "multiplier")
    bounds = baseline.agg(F.map_from_entries(F.collect_list(F.struct("column", entry)))).scalar()
    b, v = bounds[F.col("column")], F.col("value")
    found = number_profiles(states, moments, {
        "beyond_3": beyond(v, b["mean"], b["deviation"], F.lit(NEAR)),
        "beyond_5": beyond(v, b["mean"], b["deviation"], F.lit(FAR)),
        "beyond_custom": beyond(v, b["mean"], b["deviation"], b["multiplier"]),
    })
    reason = F.when(~F.coalesce(b["known"], F.lit(False)), NO_BASELINE).when(F.col("numbers") == 0, NO_NUMBERS)
    verdict = numeric_passes(F.col("rows"), F.col("beyond_3"), F.col("beyond_custom"), b["bound"])
    return found.join(deciles(states), "column", "left").select(
        "column",
        "rows",
        F.bround("mean").cast("bigint").alias("mean"),
        F.bround(F.coalesce("deviation", F.lit(0.0))).cast("bigint").alias("deviation"),
        "min",
        "max",
        "beyond_3",
        "beyond_5",
        F.when(b["bound"].isNotNull(), F.col("beyond_custom")).alias("beyond_custom"),
        (reason.isNull() & verdict).alias("is_pass"),
        reason.alias("reason"),
        "percentiles",
        "moments",
    )


def take_baseline(df: DataFrame, spec: QualitySpec) -> dict[str, DataFrame]:
    """The three baseline tables of a task: numbers, categories and custom statistics.

    The rows are scanned once, and once more for each statistic that is written in Python.
    """
    spec = spec.resolved(df.columns)
    statistics = {c: named_statistic(names.statistic) for c, names in spec.custom.items()}
    inline = {c: _as_text(s) for c, s in statistics.items() if not isinstance(s, PartialStatistic)}
    states = scan(df, spec.numeric, spec.category, inline)
    tables: dict[str, DataFrame] = {}
    if spec.numeric:
        tables["numbers"] = profile_of(states, spec.chebyshev, spec.moments)
    if spec.category:
        known = category_counts_of(states).where(F.col("value").isNotNull())
        tables["categories"] = known.select("column", "value")
    if spec.custom:
        parts = [found.withColumnRenamed("found", "data") for found in custom_of(states, list(inline))]
        parts += [custom_statistic(df, c, spec.custom[c].statistic) for c in statistics if c not in inline]
        custom = parts[0]
        for part in parts[1:]:
            custom = custom.unionByName(part)
        tables["custom"] = custom
    return tables


def _as_text(statistic):
    return lambda column: statistic(column).cast("string")


def _checks(spec: QualitySpec, baseline: dict[str, DataFrame]) -> dict[str, Callable[[Column], Column]]:
    """The custom checks as aggregates, with their stored statistics as literals (one for each column)."""
    if not spec.custom:
        return {}
    data = {r.column: r.data for r in baseline["custom"].where(F.col("column").isin(list(spec.custom))).collect()}

    def check(column: str) -> Callable[[Column], Column]:
        return lambda c: named_check(spec.custom[column].check)(c, F.lit(data.get(column)).cast("string"))

    return {c: check(c) for c in spec.custom}


def _details(states: DataFrame, spec: QualitySpec, baseline: dict[str, DataFrame]) -> DataFrame:
    parts = []
    if spec.numeric:
        parts.append(_detail(number_verdicts(states, baseline["numbers"], spec.moments), "num"))
    if spec.category:
        parts.append(_detail(category_verdicts(category_counts_of(states), baseline["categories"]), "category"))
    for found in custom_of(states, list(spec.custom)):
        verdict = found.select("column", F.col("found.pass").alias("is_pass"), F.col("found.log").alias("log"))
        parts.append(_detail(verdict, "custom"))
    if not parts:
        raise ValueError(f"task {spec.task_id} checks no column")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _detail(found: DataFrame, data_type: str) -> DataFrame:
    shown = F.to_json(F.struct(*[c for c in found.columns if c != "column"]))
    return found.select("column", F.lit(data_type).alias("data_type"), "is_pass", shown.alias("detail"))


def new_rows(df: DataFrame, spec: QualitySpec) -> DataFrame:
    """Rows above the mark of the task, by key if it has one, else by time."""
    spec = spec.resolved(df.columns)
    if spec.key:
        return rows_above_key(df, spec.key, spec.key_mark)
    if spec.ts:
        return rows_after(df, spec.ts, spec.ts_mark)
    return df


def quality_report(
    df: DataFrame, spec: QualitySpec, baseline: dict[str, DataFrame], manual: bool = False
) -> DataFrame:
    """One row for a run over the new rows: verdict, size, key range and details per column.

    The new rows are scanned once, here; the report is made from the stored counts of their values.
    Without new rows the run is not valid and says so.
    """
    spec = spec.resolved(df.columns)
    key = spec.key or spec.ts
    states = scan(new_rows(df, spec), spec.numeric, spec.category, _checks(spec, baseline), key)
    details = _details(states, spec, baseline)
    entry = F.struct("column", F.struct("data_type", "is_pass", "detail"))
    summary = details.agg(
        F.struct(
            F.bool_and("is_pass").alias("is_pass"),
            # one entry per checked column
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("detail"),
        ).alias("s")
    ).scalar()
    filled = F.col("row_count") > 0
    key_range = [F.col(c).cast("string").alias(c) for c in ("key_min", "key_max")]
    return size_of(states).select(
        F.lit(spec.task_id).alias("task_id"),
        F.lit(spec.name).alias("task_name"),
        F.lit(True).alias("task_status"),
        (filled & F.coalesce(summary.getField("is_pass"), F.lit(True))).alias("validation_result"),
        F.col("row_count").alias("sample_num"),
        *key_range,
        F.when(filled, summary.getField("detail")).alias("detail"),
        F.when(~filled, F.lit(NO_NEW_ROWS)).alias("error_msg"),
        F.lit("Manual" if manual else "Auto").alias("execution_type"),
    )


def failed_report(spark: SparkSession, spec: QualitySpec, error: Exception, manual: bool = False) -> DataFrame:
    """The result row of a run that raised."""
    row = (spec.task_id, spec.name, False, False, None, None, None, None, str(error), "Manual" if manual else "Auto")
    schema = (
        "task_id string, task_name string, task_status boolean, validation_result boolean, "
        "sample_num bigint, key_min string, key_max string, detail string, error_msg string, "
        "execution_type string"
    )
    return spark.createDataFrame([row], schema)


def run_quality(
    spark: SparkSession,
    df: DataFrame,
    spec: QualitySpec,
    baseline_path: str,
    results_path: str,
    manual: bool = False,
) -> str:
    """Profile on the first run, check on every later one; returns what was done.

    The baseline is written once and read back, so later runs compare with stored values. Each
    run appends one result row, also when it fails. A run covers the rows above the mark: the one
    of the task document, or else the greatest key (time) of the profile and of all automatic runs.
    The result row holds the key range that was checked, so result and mark advance together.
    Automatic runs are numbered, manual ones have -1; after `expect_count` automatic runs nothing
    is done any more.
    """
    results = results_of(spark, spec, results_path)
    executions = results.where("execution_type = 'Auto'").count() if results else 0
    if not manual and spec.expect_count and executions >= spec.expect_count:
        return "disabled"
    iteration = -1 if manual else executions + 1
    try:
        report = _profile_or_check(spark, df, spec, baseline_path, results, manual)
        if report is None:
            return "profiled"
        _append(report, iteration, results_path)
        return "checked"
    except Exception as error:  # noqa: BLE001 - any failure becomes a result row
        _append(failed_report(spark, spec, error, manual), iteration, results_path)
        return "failed"


def results_of(spark: SparkSession, spec: QualitySpec, path: str) -> DataFrame | None:
    """The result rows of the task, or None before the first."""
    return spark.read.parquet(path).where(F.col("task_id") == spec.task_id) if _is_stored(spark, path) else None


def _append(report: DataFrame, iteration: int, path: str) -> None:
    stamped = report.withColumn("iteration", F.lit(iteration).cast("bigint"))
    stamped.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def _is_stored(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _profile_or_check(spark, df, spec, baseline_path, results, manual) -> DataFrame | None:
    spec = spec.resolved(df.columns)
    names = {"numbers": spec.numeric, "categories": spec.category, "custom": spec.custom}
    wanted = [name for name, columns in names.items() if columns]
    if not _is_stored(spark, f"{baseline_path}/profiled"):
        for name, table in take_baseline(new_rows(df, spec), spec).items():
            table.write.mode("overwrite").parquet(f"{baseline_path}/{name}")
        # written last: a profile that was cut short starts over
        probe = size_probe(new_rows(df, spec), spec.key, spec.ts)
        probe.write.mode("overwrite").parquet(f"{baseline_path}/profiled")
        return None
    marked = spec.key or spec.ts
    if marked and (spec.key_mark if spec.key else spec.ts_mark) is None:
        profiled = spark.read.parquet(f"{baseline_path}/profiled")
        mark = stored_mark(profiled, results, df.schema[marked].dataType)
        spec = replace(spec, **{"key_mark" if spec.key else "ts_mark": mark})
    baseline = {name: spark.read.parquet(f"{baseline_path}/{name}") for name in wanted}
    return quality_report(df, spec, baseline, manual)
