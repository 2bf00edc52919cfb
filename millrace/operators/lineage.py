"""Lineage graph from run events: data nodes, process nodes, runs and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import HOT_SALTS, HOT_SHARE, left_join
from millrace.operators.parts import PART_SIZE, list_parts

_NODE = "struct<db_type: string, ip: string, port: string, db_name: string, table_name: string>"
EVENT_SCHEMA = (
    "run_id string, action_id string, action_type string, action_owner string, "
    "action_name string, action_desc string, start timestamp, `end` timestamp, "
    f"result string, message string, input_data array<{_NODE}>, input_runs array<string>, "
    f"output_data array<{_NODE}>, process_id string"
)
NODE_KEYS = ["db_type", "ip", "port", "db_name", "table_name"]

_LANES = 4
_TASK_BYTES, _MOST_TASKS, _NO_ESTIMATE = 4 << 20, 10_000, 1 << 50


def data_nodes(touches: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """One row per data node with the number of runs that touched it."""
    return touches.select(*keys, run).distinct().groupBy(*keys).agg(F.count("*").alias("runs"))


def data_node_runs(
    touches: DataFrame, keys: Sequence[str], run: str, limit: int = PART_SIZE
) -> DataFrame:
    """The run ids of each data node as sorted lists, in parts of bounded size."""
    return list_parts(touches.select(*keys, run).distinct(), keys, run, "run_ids", limit)


def set_digest(sets: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Rows (keys, size, digest): sets are told apart by size and a 256-bit fingerprint.

    The fingerprint is the exclusive-or of four differently seeded hashes per member. It does
    not depend on order, so it merges like a sum, and no set is ever collected.

    Members are dealt out once, by their set, and told apart and folded where they lie. Sets that
    may hold over HOT_SHARE of the rows come from a summary of frequent items, as in `hot_keys`: they
    are dealt to HOT_SALTS tasks by member, and only their partial fingerprints move again.
    """
    own = F.xxhash64(*keys)
    hot = sorted(sets.select(own.alias("key")).stat.freqItems(["key"], HOT_SHARE).first()[0] or [])
    many, salt = own.isin(hot), F.pmod(F.xxhash64("item"), F.lit(HOT_SALTS)).cast("int")
    members = sets.select(*keys, F.col(item).cast("string").alias("item"))
    members = members.withColumn("salt", F.when(many, salt).otherwise(0))
    members = members.repartition(_tasks(members), *keys, "salt").distinct()
    names = [f"lane{i}" for i in range(_LANES)]
    lanes = [F.bit_xor(F.xxhash64(F.lit(i), F.col("item"))).alias(name) for i, name in enumerate(names)]
    found = members.groupBy(*keys, "salt").agg(F.count("*").alias("size"), *lanes).drop("salt")
    if hot:
        parts = found.where(many).groupBy(*keys).agg(F.sum("size").alias("size"), *[F.bit_xor(n).alias(n) for n in names])
        found = found.where(~many).unionByName(parts)
    digest = F.concat_ws("-", *map(F.hex, names))
    return found.select(*keys, "size", digest.alias("digest"))


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that are narrow and compress well, by Catalyst's estimate of their size.

    Adaptive execution would put 64 compressed MB of them into one task, which are gigabytes in its hash maps.
    """
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    fixed = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of unknown size are estimated at exabytes
    return fixed if estimate >= _NO_ESTIMATE else max(fixed, min(estimate // _TASK_BYTES, _MOST_TASKS))


def process_members(inputs: DataFrame, run: str, action: Sequence[str], item: str) -> DataFrame:
    """Rows (run, action, size, process_id): runs of one action on the same input set share it."""
    digests = set_digest(inputs, [run, *action], item)
    identity = F.sha2(F.to_json(F.struct(*action, "size", "digest")), 256)
    return digests.select(run, *action, "size", identity.alias("process_id"))


def process_nodes(members: DataFrame, run: str, action: Sequence[str]) -> DataFrame:
    """One row per process node with its first run and number of runs."""
    return members.groupBy("process_id", *action).agg(
        F.min(run).alias("first_run"),
        F.count("*").alias("runs"),
        F.max("size").alias("inputs"),
    )


def run_rows(events: DataFrame, members: DataFrame, run: str, start: str, end: str) -> DataFrame:
    """Run rows with the process node they belong to and their duration in seconds."""
    owner = members.select(run, "process_id")
    joined = left_join(events, owner, [run], [run])
    seconds = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    return joined.withColumn("duration_seconds", seconds.cast("bigint"))


def node_id(node: Column) -> Column:
    return F.to_json(F.struct(*[node[k].alias(k) for k in NODE_KEYS]))


def event_inputs(events: DataFrame) -> DataFrame:
    """Distinct (run_id, action, input) of an event table; an input is a data node or a run."""
    data = events.select("run_id", "action_id", "action_type", F.explode("input_data").alias("node"))
    data = data.select("run_id", "action_id", "action_type", F.concat(F.lit("data:"), node_id(F.col("node"))).alias("input"))
    runs = events.select("run_id", "action_id", "action_type", F.explode("input_runs").alias("r"))
    runs = runs.select("run_id", "action_id", "action_type", F.concat(F.lit("run:"), "r").alias("input"))
    return data.unionByName(runs).distinct()


def event_members(events: DataFrame) -> DataFrame:
    """Rows (run_id, action_id, action_type, size, process_id) of an event table.

    Task events carry the id of their process, which is known when the task is planned.
    """
    size = F.array_size(F.array_distinct("input_data")) + F.array_size(F.array_distinct("input_runs"))
    return events.select("run_id", "action_id", "action_type", size.cast("bigint").alias("size"), "process_id").distinct()


def event_edges(events: DataFrame) -> DataFrame:
    """The edges of an event table; data nodes are named by `node_id`."""
    data = events.select("run_id", F.explode("input_data").alias("node"))
    data = data.select("run_id", F.lit("data").alias("input_kind"), node_id(F.col("node")).alias("input"))
    runs = events.select("run_id", F.lit("run").alias("input_kind"), F.explode("input_runs").alias("input"))
    outputs = events.select("run_id", F.explode("output_data").alias("node"))
    outputs = outputs.select("run_id", node_id(F.col("node")).alias("output"))
    return lineage_edges(data.unionByName(runs), outputs, event_members(events), "run_id")


def event_touches(events: DataFrame) -> DataFrame:
    """Rows (node keys, run_id): the data nodes an event reads or writes."""
    both = F.concat(F.coalesce("input_data", F.array()), F.coalesce("output_data", F.array()))
    return events.select("run_id", F.inline(both))


def lineage_edges(inputs: DataFrame, outputs: DataFrame, members: DataFrame, run: str) -> DataFrame:
    """Distinct (src, dst) edges: data to process, process to process and process to data.

    `inputs` has (run, input_kind, input) with kind `data` or `run`; `outputs` has (run, output).
    A run given as an input stands for the process node it belongs to.
    """
    process = members.select(run, "process_id")
    data_in, run_in, data_out = "data", "run", "output"
    links = inputs.select(run, F.col("input_kind").alias("kind"), F.col("input").cast("string").alias("ref"))
    links = links.unionByName(outputs.select(run, F.lit(data_out).alias("kind"), F.col("output").cast("string").alias("ref")))
    # one join gives every link its process; links that repeat go together with edges that do, at the end
    ends = links.where(F.col("kind").isin(data_in, data_out)).join(process, run)
    writes = F.col("kind") == data_out
    ends = ends.select(
        F.when(writes, F.col("process_id")).otherwise(F.col("ref")).alias("src"),
        F.when(writes, F.col("ref")).otherwise(F.col("process_id")).alias("dst"),
    )
    source = process.select(F.col(run).cast("string").alias("ref"), F.col("process_id").alias("src"))
    after = links.where(F.col("kind") == run_in).join(process, run).select("ref", F.col("process_id").alias("dst"))
    after = after.join(source, "ref").select("src", "dst")
    return ends.unionByName(after).distinct()
