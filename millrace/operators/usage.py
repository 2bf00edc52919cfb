"""Column usage from a corpus of task documents.

A corpus is a DataFrame with one document per row: `submission` (unique id), `submitted_at`
(timestamp) and `task` (a struct of TASK_TYPE, usually `from_json` of the text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import joined_id, quoted
from millrace.operators.joins import left_join

_GROUP = "GroupBy: struct<IsEnable: string, TargetColumnList: array<string>>"
_TOTAL = f"array<struct<IsEnable: string, Step: int, TargetColumn: string, Naming: string, {_GROUP}>>"
TASK_TYPE = f"""struct<
  TaskAction: struct<TaskId: string, Spark: string, TableName: string, Phoenix: string,
    AppendPhoenix: string, SubmittedUser: string>,
  Base: struct<Databases: array<struct<
    ConnectionInfo: struct<DbType: string, Ip: string, Port: string, UserName: string>,
    DbInfo: struct<DbName: string, TableName: string, ColumnsName: array<string>>,
    SqlStatement: string,
    Condition: struct<FunctionCondition: struct<
      ToSum: {_TOTAL},
      ToAvg: {_TOTAL},
      ToMode: array<struct<IsEnable: string, Step: int, TargetColumn: string, Naming: string>>,
      ToColumnCombine: array<struct<IsEnable: string, Step: int, Naming: string, Separator: string,
        TargetColumnList: array<struct<TargetColumn: string, Order: int>>>>,
      ToPivot: array<struct<IsEnable: string, Step: int, TargetColumn: string,
        TargetValues: array<string>, AggregateColumn: array<struct<Column: string>>,
        AggregateFunction: string, {_GROUP}>>,
      ToArithmetic: array<struct<IsEnable: string, Step: int, Naming: string, Operator: string,
        TargetColumnList: array<struct<Column: string, Order: int>>>>>>>>>,
  Merge: struct<Tables: array<array<struct<MergeColumnName: array<string>>>>>
>""".replace("\n", " ")

USAGE_KEY = ["ip", "port", "db", "table", "column"]
FUNCTION_COUNTS = {
    "ToSum": "sum_count",
    "ToAvg": "avg_count",
    "ToMode": "mode_count",
    "ToColumnCombine": "combine_count",
    "ToPivot": "pivot_count",
    "ToArithmetic": "arithmetic_count",
}


def read_corpus(texts: DataFrame, submission: str, submitted_at: str, document: str) -> DataFrame:
    return texts.select(
        quoted(submission).alias("submission"),
        quoted(submitted_at).cast("timestamp_ntz").alias("submitted_at"),
        F.from_json(quoted(document), TASK_TYPE).alias("task"),
    )


def _sources_used(corpus: DataFrame) -> DataFrame:
    sources = corpus.select(
        "submission",
        "submitted_at",
        F.col("task.TaskAction.SubmittedUser").alias("user"),
        _merge_entries(F.col("task")).alias("entries"),
        F.posexplode("task.Base.Databases").alias("pos", "source"),
    )
    return sources.where(~F.col("source.ConnectionInfo.DbType").eqNullSafe("None"))


def columns_used(corpus: DataFrame) -> DataFrame:
    """One row per column listed by a source of a task."""
    c, i = "source.ConnectionInfo", "source.DbInfo"
    return _sources_used(corpus).select(
        "submission",
        "submitted_at",
        "user",
        "pos",
        F.col(f"{c}.DbType").alias("db_type"),
        F.col(f"{c}.Ip").alias("ip"),
        F.col(f"{c}.Port").alias("port"),
        F.col(f"{c}.UserName").alias("user_name"),
        F.col(f"{i}.DbName").alias("db"),
        F.col(f"{i}.TableName").alias("table"),
        F.explode(f"{i}.ColumnsName").alias("column"),
        F.col("source.Condition.FunctionCondition").alias("functions"),
        "entries",
    )


def _merge_entries(task: Column) -> Column:
    """All join keys of a task as (db, table, column, pos), with repeats."""

    def of_side(merge_at: Column):
        def entries(side: Column, i: Column) -> Column:
            info = F.get(task.Base.Databases, merge_at + i).DbInfo
            return F.transform(
                side.MergeColumnName,
                lambda name: F.named_struct(
                    F.lit("db"), info.DbName, F.lit("table"), info.TableName, F.lit("column"), name, F.lit("pos"), merge_at + i
                ),
            )

        return entries

    merges = F.transform(task.Merge.Tables, lambda pair, at: F.flatten(F.transform(pair, of_side(at))))
    return F.coalesce(F.flatten(merges), F.array())


def _same(a: Column, b: Column) -> Column:
    return a["db"].eqNullSafe(b["db"]) & a["table"].eqNullSafe(b["table"]) & a["column"].eqNullSafe(b["column"])


def _merge_count(entries: Column, key: Column) -> Column:
    """Uses of a join key, less one when the next source has the same key."""
    uses = F.size(F.filter(entries, lambda e: _same(e, key) & (e["pos"] == key["pos"])))
    again = F.exists(entries, lambda e: _same(e, key) & (e["pos"] == key["pos"] + 1))
    return (uses - again.cast("int")).cast("bigint")


def merge_keys(corpus: DataFrame) -> DataFrame:
    """Rows (submission, db, table, column, pos, merge_count): join keys counted inside the document."""
    keys = corpus.select("submission", _merge_entries(F.col("task")).alias("entries"))
    each = keys.select("submission", "entries", F.explode(F.array_distinct("entries")).alias("key"))
    return each.select("submission", "key.*", _merge_count(F.col("entries"), F.col("key")).alias("merge_count"))


def _function_counts(functions: Column, name: Column) -> list[Column]:
    """How often the enabled functions of a source touch a column, by kind."""

    def used(kind: str, per_item) -> Column:
        items = F.filter(functions[kind], lambda f: ~f.IsEnable.eqNullSafe("False"))
        total = F.aggregate(F.transform(items, per_item), F.lit(0), lambda a, b: a + b)
        return F.coalesce(total, F.lit(0)).cast("bigint").alias(FUNCTION_COUNTS[kind])

    def direct(f: Column) -> Column:
        return f.TargetColumn.eqNullSafe(name).cast("int")

    def listed(field: str):
        return lambda f: F.size(F.filter(f.TargetColumnList, lambda t: t[field] == name))

    def pivoted(f: Column) -> Column:
        in_values = F.coalesce(F.array_contains(f.TargetValues, name), F.lit(False))
        return (f.TargetColumn.eqNullSafe(name) | in_values).cast("int")

    return [
        used("ToSum", direct),
        used("ToAvg", direct),
        used("ToMode", direct),
        used("ToColumnCombine", listed("TargetColumn")),
        used("ToPivot", pivoted),
        used("ToArithmetic", listed("Column")),
    ]


def task_usage(corpus: DataFrame) -> DataFrame:
    """One row per listed column of a task, with its join-key and function counts; no shuffle."""
    used = columns_used(corpus)
    key = F.struct("db", "table", "column", "pos")
    merge = F.when(F.array_contains("entries", key), _merge_count(F.col("entries"), key)).otherwise(0)
    return used.select(
        "submission",
        "submitted_at",
        "user",
        "db_type",
        "user_name",
        *USAGE_KEY,
        F.lit(1).cast("bigint").alias("column_count"),
        merge.cast("bigint").alias("merge_count"),
        *_function_counts(F.col("functions"), F.col("column")),
    )


def usage_count(uses: DataFrame, keys: Sequence[str]) -> DataFrame:
    return uses.groupBy(*keys).agg(F.count("*").alias("column_count"))


def usage_gaps(uses: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows (keys, used_at, uses, gap_seconds): time since the previous use, in whole seconds.

    Uses within a second are counted together (their own gap is 0). The previous use is looked
    up per key and day, at most 86,400 rows, and across days in a summary with one row per day,
    so the busiest key is never sorted in one task. The first use has gap 0.
    """
    second = F.date_trunc("second", quoted(ts)).cast("timestamp_ntz")
    per_second = uses.groupBy(*keys, second.alias("used_at")).agg(F.count("*").alias("uses"))
    per_second = per_second.withColumn("__day", F.to_date("used_at"))

    days = per_second.groupBy(*keys, "__day").agg(F.max("used_at").alias("__last"))
    earlier = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__day"))
    days = days.select(*keys, "__day", earlier.alias("__before"))

    same_day = F.lag("used_at").over(Window.partitionBy(*keys, "__day").orderBy("used_at"))
    rows = left_join(
        per_second.withColumn("__previous", same_day), days, [*keys, "__day"], [*keys, "__day"], null_safe=True
    )
    previous = F.coalesce("__previous", "__before", "used_at")
    gap = F.timestamp_diff("SECOND", previous, F.col("used_at"))
    return rows.select(*keys, "used_at", "uses", gap.cast("bigint").alias("gap_seconds"))


def last_gaps(uses: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows (keys, gap_seconds): time between the last two uses, in whole seconds, else 0.

    The two latest seconds are kept per key and day (at most 86,400 candidates), then per key.
    """

    def latest_two(seconds: Column) -> Column:
        return F.slice(F.sort_array(seconds, asc=False), 1, 2)

    second = F.date_trunc("second", quoted(ts)).cast("timestamp_ntz")
    per_second = uses.groupBy(*keys, second.alias("at")).agg(F.count("*").alias("n"))
    days = per_second.groupBy(*keys, F.to_date("at").alias("day")).agg(
        latest_two(F.collect_list(F.struct("at", "n"))).alias("latest")
    )
    last = days.groupBy(*keys).agg(latest_two(F.flatten(F.collect_list("latest"))).alias("latest"))
    first, second_last = F.get("latest", F.lit(0)), F.get("latest", F.lit(1))
    gap = F.timestamp_diff("SECOND", second_last["at"], first["at"])
    return last.select(
        *keys, F.when(first["n"] > 1, 0).otherwise(F.coalesce(gap, F.lit(0))).cast("bigint").alias("gap_seconds")
    )


def first_uses(uses: DataFrame, keys: Sequence[str], user: str, ts: str) -> DataFrame:
    """Rows (keys, user, first_used): the distinct users of a column with their first use.

    Kept as rows: ordering them by `first_used` gives the user list, however long it is.
    """
    return uses.groupBy(*keys, user).agg(F.min(ts).alias("first_used"))


def accumulate(usage: DataFrame) -> DataFrame:
    """The usage table over all tasks: summed counters, last use, gap before it, users."""
    counters = ["column_count", "merge_count", *FUNCTION_COUNTS.values()]
    # numbers only in the first step, which sees all rows: it is hashed, not sorted, and leaves
    # one row per column and user; a hot column is spread over its users
    by_user = usage.groupBy(*USAGE_KEY, "db_type", "user_name", "user").agg(
        F.max("submitted_at").alias("submitted_at"), *[F.sum(c).alias(c) for c in counters]
    )
    totals = by_user.groupBy(*USAGE_KEY).agg(
        F.max_by("db_type", "submitted_at").alias("db_type"),
        F.max_by("user_name", "submitted_at").alias("user_name"),
        F.max("submitted_at").alias("last_used"),
        F.count_distinct("user").alias("users"),
        *[F.sum(c).alias(c) for c in counters],
    )
    gaps = last_gaps(usage, USAGE_KEY, "submitted_at")
    joined = left_join(totals, gaps, USAGE_KEY, USAGE_KEY, null_safe=True)
    return joined.withColumn("id", joined_id(*USAGE_KEY))


def merge_users(stored: DataFrame, added: DataFrame, keys: Sequence[str] = (*USAGE_KEY, "user")) -> DataFrame:
    """Fold the `first_uses` of new tasks into the stored ones: each user keeps the earliest use."""
    return stored.unionByName(added).groupBy(*keys).agg(F.min("first_used").alias("first_used"))


def merge_usage(stored: DataFrame, added: DataFrame, users: DataFrame) -> DataFrame:
    """Fold the counters of new tasks into a stored usage table, without reading old tasks.

    `users` has the merged `first_uses` rows; counts of users cannot be added, so they are counted there.
    """
    known = users.groupBy(*USAGE_KEY).agg(F.count("user").alias("users"))
    return left_join(_merged_counters(stored, added), known, USAGE_KEY, USAGE_KEY, null_safe=True)


def _merged_counters(stored: DataFrame, added: DataFrame) -> DataFrame:
    counters = ["column_count", "merge_count", *FUNCTION_COUNTS.values()]
    since = F.timestamp_diff("SECOND", F.min("last_used"), F.max("last_used"))
    newest_gap = F.max_by("gap_seconds", F.struct("last_used", "__added"))
    both = stored.withColumn("__added", F.lit(0)).unionByName(added.withColumn("__added", F.lit(1))).drop("users")
    return both.groupBy("id", *USAGE_KEY).agg(
        F.max_by("db_type", "last_used").alias("db_type"),
        F.max_by("user_name", "last_used").alias("user_name"),
        F.max("last_used").alias("last_used"),
        # a single new use is measured from the stored one, several among themselves
        F.when(
            (F.count("*") == 2) & (F.max(F.when(F.col("__added") == 1, F.col("column_count"))) == 1), since
        ).otherwise(newest_gap).cast("bigint").alias("gap_seconds"),
        *[F.sum(c).alias(c) for c in counters],
    )
