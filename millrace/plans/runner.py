"""From a task document to one lazy DataFrame, with the lineage of what was planned."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.columns import quoted, rename_columns
from millrace.functions.steps import apply_steps
from millrace.operators.joins import hot_keys, left_join
from millrace.operators.lineage import EVENT_SCHEMA
from millrace.plans.naming import plan_names
from millrace.plans.spec import ColumnSpec, MergeKeys, Source, TaskSpec
from millrace.sources.sinks import store_result

Resolver = Callable[[Source], DataFrame]

# Action codes of lineage events.
LOAD_ACTIONS = {
    "mysql": "DF10-1",
    "mssql": "DF10-2",
    "phoenix": "DF10-3",
    "oracle": "DF10-4",
    "cassandra": "DF10-5",
    "elasticsearch": "DF10-6",
    "mongodb": "DF10-7",
    "hbase": "DF10-8",
    "excel": "DF10-9",
    "csv": "DF10-10",
    "hds": "DF10-11",
}
MERGE_ACTION = ("DF30-1", "MERGE", "Join")
STEP_ACTIONS = {
    "ToSum": ("DF40-1", "CALCULATE", "Sum"),
    "ToAvg": ("DF40-2", "CALCULATE", "Avg"),
    "ToMode": ("DF40-3", "CALCULATE", "Mode"),
    "ToPivot": ("DF40-4", "CALCULATE", "Pivot"),
    "ToArithmetic": ("DF40-5", "CALCULATE", "Arithmetic"),
    "ToColumnCombine": ("DF50-1", "CONVERT", "ColumnCombine"),
    "SplitMerge": ("DF100-1", "SPECIFIC", "SplitMerge"),
}
RENAME_ACTION = ("DF50-2", "CONVERT", "Rename Column")
STORE_FILE_ACTION = ("DF60-1", "STORE", "Store file")
STORE_TABLE_ACTION = ("DF60-2", "STORE", "Store table")


class _Recorder:
    """Events of a planned task.

    A process is an action on a set of inputs, where a run that is an input counts as its own
    process, so the same task has the same processes each time it is planned.
    """

    def __init__(self, owner: str):
        self.owner = owner
        self.events: list[dict] = []
        #: Runs that the result comes from.
        self.last: list[str] = []
        self._process: dict[str, str] = {}

    def add(self, action, inputs=(), runs=(), outputs=()) -> str:
        action_id, action_type, name = action
        run_id = uuid.uuid4().hex
        data = sorted({json.dumps(i, sort_keys=True) for i in inputs})
        identity = [action_id, action_type, data, sorted({self._process[r] for r in runs})]
        self._process[run_id] = hashlib.sha256(json.dumps(identity).encode()).hexdigest()
        self.events.append(
            {
                "run_id": run_id,
                "action_id": action_id,
                "action_type": action_type,
                "action_owner": self.owner,
                "action_name": name,
                "action_desc": name,
                "input_data": list(inputs),
                "input_runs": list(runs),
                "output_data": list(outputs),
                "process_id": self._process[run_id],
            }
        )
        return run_id


@dataclass
class TaskRun:
    """The planned result and one lineage event per action that makes it up."""

    spec: TaskSpec
    result: DataFrame
    columns: tuple[ColumnSpec, ...]
    recorder: _Recorder

    @property
    def events(self) -> list[dict]:
        return self.recorder.events

    @property
    def last_run(self) -> str:
        return self.events[-1]["run_id"]

    def store(self, root: str, base: str) -> str:
        """Write the result as the document asks, and record what was written; returns the path."""
        spec = self.spec
        path = store_result(self.result, spec, self.columns, root, base)
        kind = "table" if spec.store_table else "csv"
        output = {"db_type": kind, "ip": "", "port": "", "db_name": root.rstrip("/"), "table_name": spec.table_name.upper()}
        action = STORE_TABLE_ACTION if spec.store_table else STORE_FILE_ACTION
        self.recorder.add(action, runs=self.recorder.last, outputs=[output])
        return path

    def lineage(
        self,
        spark: SparkSession,
        start: datetime,
        end: datetime,
        result: str = "Success",
        message: str | None = None,
    ) -> DataFrame:
        """The events as rows. Spark runs all actions as one job, so they share its times."""
        rows = [dict(e, start=start, end=end, result=result, message=message) for e in self.events]
        return spark.createDataFrame(rows, EVENT_SCHEMA)


def data_node(source: Source) -> dict[str, str]:
    return {
        "db_type": source.db_type,
        "ip": source.ip,
        "port": source.port,
        "db_name": source.db_name,
        "table_name": source.table_name,
    }


#: Left sides that Catalyst takes for larger are searched for hot keys before they are joined.
HOT_BYTES = 8 << 30


def _size(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hot(left: DataFrame, right: DataFrame, keys: MergeKeys, least: int) -> list[int]:
    if _size(left.select(*map(quoted, keys.left))) < least:
        return []
    return hot_keys(left, right, keys.left, keys.right)


def plan_task(spec: TaskSpec, resolver: Resolver, null_safe: bool = False, hot_bytes: int = HOT_BYTES) -> TaskRun:
    """Build the whole task as one logical plan; nothing runs until the result is written.

    Except for the search for hot keys: a left side whose keys are estimated at `hot_bytes` or more is read
    once, keys only, before its join is planned. Smaller joins are left to adaptive execution.
    """
    recorder = _Recorder(spec.user)

    def load(source: Source) -> tuple[DataFrame, str]:
        action = (LOAD_ACTIONS[source.db_type], "LOAD", f"Pull {source.db_type}")
        run = recorder.add(action, inputs=[data_node(source)])
        df = apply_steps(apply_steps(resolver(source), source.specials), source.functions)
        for step in (*source.specials, *source.functions):
            run = recorder.add(STEP_ACTIONS[step.kind], runs=[run])
        return df, run

    columns, counters = spec.columns, {}
    current, run = load(spec.sources[0])
    others = [s for s in spec.sources[1:] if not s.is_empty]
    runs = [run]
    for keys, source in zip(spec.merges, others):
        right, run = load(source)
        runs.append(run)
        names = plan_names(
            current.columns, right.columns, keys.left, keys.right, columns, counters
        )
        columns, counters = names.specs, names.counters
        left, right = current.withColumnsRenamed(names.left), right.withColumnsRenamed(names.right)
        hot = _hot(left, right, keys, hot_bytes)
        # a right side that may be an aggregate over the keys needs a shuffle of its own for a left key to be split
        spread = bool(source.functions or source.specials or "group by" in source.statement.lower())
        current = left_join(left, right, keys.left, keys.right, null_safe, spread, hot)
    if spec.merges:
        runs = [recorder.add(MERGE_ACTION, runs=runs)]
    if any(c.renames for c in columns):
        current = rename_columns(current, columns)
        runs = [recorder.add(RENAME_ACTION, runs=runs)]
    recorder.last = runs
    return TaskRun(spec, current, columns, recorder)


def run_task(spec: TaskSpec, resolver: Resolver, null_safe: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    return plan_task(spec, resolver, null_safe, hot_bytes).result
