"""Usage, graph, lineage and catalogue on inline rows."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import catalogue, graph, lineage, usage
from millrace.workspace import fresh_dir
from test_spec import pair


def document(user, tables, merges=(), functions=None):
    bases = [
        {
            "ConnectionInfo": {"DbType": kind, "Ip": "h", "Port": "1", "UserName": "u"},
            "DbInfo": {"DbName": "d", "TableName": name, "ColumnsName": columns},
            "Condition": {"FunctionCondition": functions or {}},
        }
        for name, columns, kind in tables
    ]
    return json.dumps({"TaskAction": {"SubmittedUser": user}, "Base": {"Databases": bases}, "Merge": {"Tables": list(merges)}})


def corpus(spark, *docs):
    data = [(i, f"2024-01-0{i + 1} 00:00:0{i}", d) for i, d in enumerate(docs)]
    return usage.read_corpus(spark.createDataFrame(data, "id int, at string, doc string"), "id", "at", "doc")


def test_unused_sources_are_not_counted(spark):
    docs = corpus(spark, document("x", [("a", ["p", "q"], "mysql"), ("b", ["r"], "None")]))
    assert rows(usage.columns_used(docs), "table", "column") == [("a", "p"), ("a", "q")]


def test_repeated_join_key_is_reduced_once(spark):
    """The middle source is a join key of both merges."""
    tables = [("a", ["k"], "mysql"), ("b", ["k"], "mysql"), ("b", ["k"], "mysql")]
    docs = corpus(spark, document("x", tables, [pair(["k"], ["k"]), pair(["k"], ["k"])]))
    # positions: a@0, b@1 (right of the first, left of the second merge), b@2; b@1 loses one to b@2
    assert rows(usage.merge_keys(docs), "table", "pos", "merge_count") == [("a", 0, 1), ("b", 1, 1), ("b", 2, 1)]


def test_function_counts(spark):
    on, off = {"IsEnable": "True", "Step": 1, "Naming": "n"}, {"IsEnable": "False", "Step": 1, "Naming": "n"}
    functions = {
        "ToSum": [on | {"TargetColumn": "p"}, off | {"TargetColumn": "p"}],
        "ToColumnCombine": [on | {"TargetColumnList": [{"TargetColumn": "p", "Order": 1}, {"TargetColumn": "p", "Order": 2}]}],
        "ToPivot": [on | {"TargetColumn": "z", "TargetValues": ["p"]}],
        "ToArithmetic": [on | {"TargetColumnList": [{"Column": "q", "Order": 1}]}],
    }
    docs = corpus(spark, document("x", [("a", ["p", "q"], "mysql")], functions=functions))
    found = {r["column"]: r.asDict() for r in usage.task_usage(docs).collect()}
    pick = lambda c: tuple(found[c][n] for n in usage.FUNCTION_COUNTS.values())
    assert pick("p") == (1, 0, 0, 2, 1, 0) and pick("q") == (0, 0, 0, 0, 0, 1)


def test_accumulated_usage(spark):
    one = [("a", ["p"], "mysql")]
    docs = corpus(spark, document("x", one), document("y", one), document("x", one + [("b", ["p"], "mysql")]))
    found = {r.id: r for r in usage.accumulate(usage.task_usage(docs)).collect()}
    total = found["h:1:d:a:p"]
    assert (total.column_count, total.users, total.gap_seconds, str(total.last_used)) == (3, 2, 86401, "2024-01-03 00:00:02")
    assert found["h:1:d:b:p"].gap_seconds == 0


def test_folding_new_tasks_equals_counting_all(spark):
    one = [("a", ["p"], "mysql")]
    parts = [corpus(spark, document("x", one), document("x", one)), corpus(spark, document("x", one), document("x", one), document("x", one))]
    tasks = [usage.task_usage(d) for d in (parts[0], parts[1].where("submission = 2"), parts[1])]
    old, new, everything = map(usage.accumulate, tasks)
    firsts = [usage.first_uses(t, usage.USAGE_KEY, "user", "submitted_at") for t in tasks]
    users = usage.merge_users(firsts[0], firsts[1])
    assert rows(users) == rows(firsts[2])
    columns = ["id", "column_count", "last_used", "gap_seconds", "users"]
    assert rows(usage.merge_usage(old, new, users), *columns) == rows(everything, *columns)


def test_uses_within_a_second(spark):
    df = spark.createDataFrame([("c", t) for t in ("00:00:01.1", "00:00:01.9", "00:00:05.0")], "c string, t string")
    df = df.selectExpr("c", "cast(concat('2024-01-01 ', t) AS timestamp_ntz) AS at")
    assert rows(usage.usage_gaps(df, ["c"], "at"), "uses", "gap_seconds") == [(1, 4), (2, 0)]
    assert rows(usage.last_gaps(df, ["c"], "at")) == [("c", 4)]
    assert rows(usage.last_gaps(df.where("at < timestamp_ntz'2024-01-01 00:00:02'"), ["c"], "at")) == [("c", 0)]


@pytest.fixture(scope="module")
def members(spark):
    data = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "lonely")] + [(9, x) for x in "abcdef"]
    return spark.createDataFrame(data, "task int, item string")


def test_neighbours_are_symmetric_and_unique(members):
    found = rows(graph.neighbours(graph.related_edges(members, "task", "item")))
    assert len(found) == 30 == len(set(found)) and set(found) == {(b, a) for a, b in found}


def test_wide_tasks_lose_nothing(spark):
    """One task of 1,501 items: as many edges, and full lists and documents for an item."""
    members = spark.range(1501).selectExpr("1 AS task", "cast(id AS string) AS item").unionByName(
        spark.sql("SELECT 2 AS task, explode(array('0', 'x')) AS item"))
    edges = graph.related_edges(members, "task", "item")
    assert edges.count() == 1503
    asked = spark.createDataFrame([("0",)], "src string")
    lists = graph.related_lists(edges, of=asked)
    assert rows(lists, "size", "parts", "part")[0][:2] == (1501, 2)
    expected = {*map(str, range(1, 1501)), "x"}
    found = [x for r in lists.collect() for x in r.related]
    assert len(found) == 1501 and set(found) == expected
    documents = graph.search_documents(asked.withColumnRenamed("src", "id"), lists, ["id"])
    assert rows(documents, "part") == [(0,), (1,)]


def test_ids_of_different_members_differ(spark):
    data = [(None, "a", "b"), ("a", None, "b"), ("a:b", None, None), ("a", "b", None), ("\\N", "a", "b"), ("a\\", "b", "c"), ("a\\:b", "c", None)]
    members = spark.createDataFrame(data, "x string, y string, z string")
    assert graph.vertices(members, {"Column": ["x", "y", "z"]}).count() == len(data)
    assert graph.containment_edges(members, [("HAS", ["x"], ["x", "y", "z"])]).count() == len(data)


def test_search_documents(spark, members):
    totals = spark.createDataFrame([("a", 3), ("lonely", 1)], "id string, usagecount int")
    related = graph.related_lists(graph.related_edges(members.where("task < 3"), "task", "item"))
    found = {r.id: json.loads(r.document) for r in graph.search_documents(totals, related, ["usagecount"]).collect()}
    assert found == {"a": {"usagecount": 3, "related_columns": ["b"]}, "lonely": {"usagecount": 1, "related_columns": []}}


def test_process_nodes_need_the_same_action_and_inputs(spark):
    data = [("r1", "A", 1), ("r1", "A", 2), ("r2", "A", 2), ("r2", "A", 1), ("r2", "A", 1), ("r3", "A", 1), ("r4", "B", 1), ("r4", "B", 2)]
    inputs = spark.createDataFrame(data, "run string, action string, input int")
    nodes = lineage.process_members(inputs, "run", ["action"], "input")
    found = dict(rows(nodes, "run", "process_id"))
    assert found["r1"] == found["r2"] and len(set(found.values())) == 3
    assert rows(lineage.process_nodes(nodes, "run", ["action"]), "first_run", "runs", "inputs") == [("r1", 2, 2), ("r3", 1, 1), ("r4", 1, 2)]


def test_lineage_of_events(spark):
    node = lambda t: {"db_type": "mysql", "ip": "h", "port": "1", "db_name": "d", "table_name": t}
    event = dict(action_type="LOAD", action_owner="", action_name="", action_desc="", result="Success", message=None, input_runs=[], output_data=[])
    data = [
        dict(event, run_id="r1", action_id="L", input_data=[node("a")]),
        dict(event, run_id="r2", action_id="M", input_data=[], input_runs=["r1"], output_data=[node("z")]),
        dict(event, run_id="r3", action_id="L", input_data=[node("a")]),
    ]
    events = spark.createDataFrame([d | {"start": None, "end": None} for d in data], lineage.EVENT_SCHEMA)
    assert rows(lineage.data_nodes(lineage.event_touches(events), lineage.NODE_KEYS, "run_id"), "table_name", "runs") == [("a", 2), ("z", 1)]
    inputs = lineage.event_inputs(events)
    nodes = lineage.process_members(inputs, "run_id", ["action_id", "action_type"], "input")
    process = dict(rows(nodes, "run_id", "process_id"))
    assert process["r1"] == process["r3"] != process["r2"]
    kinds = inputs.selectExpr("run_id", "split(input, ':')[0] AS input_kind", "substring(input, instr(input, ':') + 1) AS input")
    outputs = events.selectExpr("run_id", "inline(output_data)").selectExpr("run_id", "table_name AS output")
    edges = rows(lineage.lineage_edges(kinds, outputs, nodes, "run_id"))
    assert (process["r1"], process["r2"]) in edges and (process["r2"], "z") in edges and len(edges) == 3


def test_catalogue(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 1, 'y', 2) AS o, map('f:p', 1) AS m, '{\"k\":1,\"j\":{}}' AS doc")
    found = catalogue.describe_table(df, "elasticsearch", "h", "1", "d", "t").first()
    assert found["columns"] == ["a", "o.x", "o.y", "m", "doc"] and found.row_count == 1 and found.id == "h:1:d:t"
    assert rows(catalogue.map_names(df, F.col("m"))) == [("f:p",)]
    assert rows(catalogue.document_names(df, F.col("doc"))) == [("j",), ("k",)]


def test_graph_of_a_corpus(spark):
    docs = corpus(spark, document("x", [("a", ["p", "q"], "mysql"), ("b", ["r"], "mysql")]), document("y", [("a", ["p"], "mysql")]))
    members = graph.task_members(usage.columns_used(docs))
    edges = graph.related_edges(members, "task", "id")
    assert edges.count() == 4 and rows(graph.merge_edges(edges, edges)) == rows(edges)
    assert graph.neighbours(edges).count() == 6
    kinds = {"Column": ["id"], "Table": ["ip", "port", "table"], "DBType": ["db_type", "ip", "port"]}
    assert rows(graph.vertices(members, kinds).groupBy("kind").count()) == [("Column", 3), ("DBType", 1), ("Table", 2)]
    totals = usage.accumulate(usage.task_usage(docs)).select("id", "column_count")
    assert rows(graph.column_vertices(members, ["id"], totals), "id", "column_count") == [
        ("h:1:d:a:p", 2), ("h:1:d:a:q", 1), ("h:1:d:b:r", 1)]


def test_a_run_is_published_once(spark, sf_dir, monkeypatch):
    """A repeat adds nothing; a crash before the counters leaves them untouched, and the next call ends the work."""
    from millrace.plans.publish import MetadataStore
    from millrace.workload import metadata

    documents = metadata.corpus(spark, sf_dir).where("submission < 60").cache()
    first, second = documents.where("submission < 40"), documents.where("submission >= 40")
    events = spark.createDataFrame([("e1", "load"), ("e2", "store")], "run_id string, action_name string")
    store = MetadataStore(spark, fresh_dir(spark, "metadata"), buckets=4)
    assert not store.published("a") and store.publish("a", first, events) and store.published("a")
    before = rows(store.read("usage"))
    assert not store.publish("a", first, events) and rows(store.read("usage")) == before

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(MetadataStore, "_counters", crash)
    with pytest.raises(RuntimeError):
        store.publish("b", second, events)
    assert rows(store.read("usage")) == before and not store.published("b")
    monkeypatch.undo()
    assert store.publish("b", second, events)
    whole = usage.accumulate(usage.task_usage(documents))
    names = ["id", "column_count", "merge_count", "sum_count", "mode_count", "users", "last_used"]
    assert rows(store.read("usage"), *names) == rows(whole, *names)
    assert rows(store.read("events")) == [("e1", "load"), ("e2", "store")]
