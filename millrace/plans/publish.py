"""Publishing the metadata of runs: one call folds usage, graph, catalogue and lineage, exactly once for a run.

The tables are keyed and in hash buckets, so a run rewrites only the buckets of its own columns. Vertices,
edges, catalogue rows, users and lineage events say the same when they are written again, so a run that was
cut short simply writes them once more. Usage counters do not; they are added last, and the run's id is
committed in the same file as the counters. A run whose id is there is not added again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph, usage
from millrace.sources.bucketed import BucketedTable
from millrace.workspace import stored

_TABLE_KEY = ["ip", "port", "db", "table"]
KINDS = {"Column": usage.USAGE_KEY, "Table": _TABLE_KEY, "Database": ["ip", "port", "db"], "DBType": ["db_type"]}
LEVELS = [
    ("HAS_DATABASE", ["db_type"], ["ip", "port", "db"]),
    ("HAS_TABLE", ["ip", "port", "db"], _TABLE_KEY),
    ("HAS_COLUMN", _TABLE_KEY, usage.USAGE_KEY),
]
#: Keys of the tables.
TABLES = {
    "vertices": ["kind", "id"],
    "edges": ["src", "dst", "kind"],
    "catalogue": [*_TABLE_KEY, "column"],
    "users": [*usage.USAGE_KEY, "user"],
    "events": ["run_id"],
    "usage": ["id"],
}


class MetadataStore:
    """Metadata tables below a folder, from the task documents of runs."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.buckets = buckets
        self.tables = {name: BucketedTable(spark, f"{root.rstrip('/')}/{name}", keys) for name, keys in TABLES.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def published(self, run: str) -> bool:
        return "usage" in self._made and run in self.tables["usage"].notes()

    @property
    def _made(self) -> set[str]:
        made = set()
        for name, table in self.tables.items():
            try:
                table.current()
                made.add(name)
            except ValueError:
                pass
        return made

    def publish(self, run: str, corpus: DataFrame, events: DataFrame | None = None) -> bool:
        """Folds a run in; False if it was published before. `corpus` comes from `usage.read_corpus`,
        `events` are the lineage rows of the run."""
        if self.published(run):
            return False
        tasks = stored(usage.task_usage(corpus), "published")
        self._facts(corpus, tasks, events)
        self._counters(run, tasks)
        return True

    def _facts(self, corpus: DataFrame, tasks: DataFrame, events: DataFrame | None) -> None:
        """What may be written again."""
        members = stored(graph.task_members(usage.columns_used(corpus)), "published")
        tables = members.withColumn("table_id", graph.joined_id(*_TABLE_KEY))
        edges = [
            graph.related_edges(members, "task", "id"),
            graph.related_edges(tables, "task", "table_id", graph.TABLE_RELATED),
            graph.containment_edges(members, LEVELS),
        ]
        facts = {
            "vertices": graph.vertices(members, KINDS),
            "edges": reduce(DataFrame.unionByName, edges).distinct(),
            "catalogue": members.select("db_type", *usage.USAGE_KEY).distinct(),
        }
        if events is not None:
            facts["events"] = events
        for name, rows in facts.items():
            self._table(name, rows).upsert(rows)
        users = stored(usage.first_uses(tasks, usage.USAGE_KEY, "user", "submitted_at"), "published")
        self._table("users", users).merge(users, usage.merge_users)

    def _counters(self, run: str, tasks: DataFrame) -> None:
        added = stored(usage.accumulate(tasks), "published")
        users = self.tables["users"].read()
        self._table("usage", added).merge(added, lambda old, new: usage.merge_usage(old, new, users), note=run)

    def _table(self, name: str, rows: DataFrame) -> BucketedTable:
        self.tables[name].ensure(rows.schema, self.buckets)
        return self.tables[name]
