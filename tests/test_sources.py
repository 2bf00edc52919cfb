"""Filters, options, shaping, the resolver, sinks."""

import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException

from conftest import rows
from millrace.plans.runner import plan_task
from millrace.plans.spec import ColumnSpec, Source, parse_task
from millrace.sources.bucketed import BucketedTable
from millrace.sources.filters import find_filter, search_filter
from millrace.sources.options import (
    SplitBy,
    cassandra_options,
    elasticsearch_options,
    hbase_options,
    jdbc_options,
    mongodb_options,
)
from millrace.sources.readers import Resolver, read_csv
from millrace.operators.catalogue import parsed_names
from millrace.sources.shaping import flatten_json, flatten_struct, parse_documents, wide_cells
from millrace.sources.sinks import jdbc_write_options, store_result, table_ddl, upsert, with_key, write_csv, write_table
from millrace.workspace import fresh_dir, shared_root
from test_spec import pair, source, task


@pytest.mark.parametrize(
    "kind,start", [("mysql", "jdbc:mysql://h:1/d"), ("mssql", "jdbc:sqlserver://h:1;"), ("oracle", "jdbc:oracle:thin:@//h:1/d"), ("phoenix", "jdbc:phoenix:thin:url=http://h:1")]
)
def test_jdbc_options(kind, start):
    found = jdbc_options(Source(kind, "h", "1", "u", "p", "d", "t", statement="SELECT 1"))
    assert found["url"].startswith(start) and found["query"] == "SELECT 1" and found["fetchsize"] == "10000"


def test_jdbc_split_reads_ranges_in_parallel():
    found = jdbc_options(Source("mysql", "h", "1", db_name="d", table_name="t", statement="SELECT a"), SplitBy("a", 1, 100, 8))
    assert found["dbtable"] == "(SELECT a) task_source" and found["numPartitions"] == "8" and "query" not in found
    with pytest.raises(ValueError):
        jdbc_options(Source("mongodb"))


def test_document_store_options():
    search = elasticsearch_options(Source("elasticsearch", "h", "9200", table_name="i", columns=("a.b", "a.c", "d"), statement="{}"))
    assert search["es.read.field.include"] == "a,d" and search["es.query"] == "{}"
    mongo = mongodb_options(Source("mongodb", "h", "1", db_name="d", table_name="t", columns=("a",), statement='{"a": 1}'))
    assert json.loads(mongo["aggregation.pipeline"]) == [{"$match": {"a": 1}}, {"$project": {"_id": 0, "a": 1}}]
    assert cassandra_options(Source("cassandra", db_name="k", table_name="t"))["keyspace"] == "k"
    assert hbase_options(Source("hbase", columns=("a:b", "c:d")))["hbase.columns"] == "a:b c:d"
    assert jdbc_write_options("u", "d", "t")["dbtable"] == "t"


@pytest.fixture(scope="module")
def documents(spark):
    texts = [
        {"id": 1, "o": {"x": 1, "s": "u"}, "l": [1, 2], "n": 5},
        {"id": 2, "o": {"x": 2}, "t": "text", "n": 9},
    ]
    return spark.createDataFrame([(json.dumps(t),) for t in texts], "doc string")


def test_flatten_json(documents):
    out = flatten_json(documents, "doc", ["id", "o.x", "o", "l", "t", "gone"])
    assert out.columns == ["id", "o.x", "o", "l", "t", "gone"]
    assert rows(out) == [("1", "1", '{"x":1,"s":"u"}', "[1,2]", "", ""), ("2", "2", '{"x":2}', "", "text", "")]


def test_documents_are_parsed_once(spark):
    texts = ['{"id":1,"o":{"x":"u","a":{"b":[1,2]}},"l":[1, 2.50],"n":null,"f":1.50}', '{"o":{},"l":"s"}', "no json", None, "[1]", '{"a":1,"a":2}']
    df = spark.createDataFrame([(t,) for t in texts], "doc string")
    found = flatten_json(df, "doc", ["id", "o", "o.a.b", "l", "n", "f", "a"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert [tuple(r) for r in found.collect()] == [
        ("1", '{"x":"u","a":{"b":[1,2]}}', "[1,2]", "[1,2.5]", "", "1.5", ""), ("", "{}", None, "s", "", "", ""),
        ("", "", None, "", "", "", ""), ("", "", None, "", "", "", ""), ("", "", None, "", "", "", ""), ("", "", None, "", "", "", "1"),
    ]
    names = parsed_names(parse_documents(df, "doc"), "parsed")
    assert rows(names) == [("f",), ("id",), ("l",), ("n",), ("o",)]


def test_flatten_struct(documents):
    schema = "id int, o struct<x: int, s: string>, l array<int>, t string"
    typed = documents.selectExpr(f"from_json(doc, '{schema}') AS d").select("d.*")
    assert rows(flatten_struct(typed, ["o.x", "o.s", "l", "t", "gone"])) == [(1, "u", "[1,2]", "", ""), (2, None, "", "text", "")]
    typed = typed.selectExpr("id", "IF(id = 1, o, NULL) AS o", "IF(id = 1, map('k', 1), NULL) AS m")
    assert [tuple(r) for r in flatten_struct(typed.orderBy("id"), ["o", "m", "o.x"]).collect()][1] == ("", "", None)
    with pytest.raises(ValueError):
        flatten_struct(typed, ["o.gone"])


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", True), (5, "b", True), (9, None, False)], "n int, s string, on boolean")
    both = {"query": {"bool": {"must": [{"range": {"n": {"gt": 1, "lte": 9}}}, {"term": {"on": True}}]}}}
    assert rows(df.where(search_filter(both)), "n") == [(5,)]
    assert df.where(search_filter("")).count() == 3 and df.where(find_filter({})).count() == 3
    assert rows(df.where(find_filter('{"s": {"$ne": "a"}, "n": {"$lt": 9}}')), "n") == [(5,)]
    assert rows(df.where(find_filter({"s": None})), "n") == [(9,)]
    assert rows(df.where(find_filter({"$and": [{"n": {"$in": [1, 9]}}, {"on": False}]})), "n") == [(9,)]
    for bad in ({"fuzzy": {"n": 1}}, {"bool": {"should": []}}):
        with pytest.raises(ValueError):
            search_filter(bad)
    with pytest.raises(ValueError):
        find_filter({"n": {"$regex": "a"}})


def test_wide_cells(spark):
    df = spark.createDataFrame([(1, {"f:a": bytearray("é", "utf-8")}), (2, {})], "id int, cells map<string, binary>")
    assert rows(wide_cells(df, "cells", ["f:a", "f:b"], keep=["id"])) == [(1, "é", ""), (2, "", "")]


def test_resolver_kinds(spark, documents):
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    nested = documents.selectExpr("from_json(doc, 'id int, n int, o struct<x: int>') AS d").select("d.*")
    wide = spark.createDataFrame([({"f:a": "1"},)], "cells map<string, string>")
    resolve = Resolver(spark, tables={"t": table, "docs": nested, "wide": wide})
    assert rows(resolve(Source("mysql", table_name="t", statement="SELECT v FROM t WHERE id > 1"))) == [("y",)]
    assert resolve(Source("oracle", table_name="t")).columns == ["ID", "V"]
    assert rows(resolve(Source("elasticsearch", table_name="docs", columns=("o.x", "zz"), statement='{"query": {"term": {"id": 2}}}'))) == [(2, "")]
    assert rows(resolve(Source("mongodb", table_name="docs", columns=("n",), statement='{"n": {"$gte": 9}}'))) == [(9,)]
    assert rows(resolve(Source("hbase", table_name="wide", columns=("f:a", "f:b")))) == [("1", "")]
    assert rows(resolve(Source("cassandra", table_name="t", statement="SELECT id FROM t"))) == [(1,), (2,)]
    assert resolve(Source("csv", table_name="t", columns=("v",))).columns == ["v"]
    with pytest.raises(ValueError):
        resolve(Source("excel"))


def test_csv_result_feeds_the_next_task(spark):
    root = fresh_dir(spark, "csv")
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, v string")
    path = write_csv(df, root, "res")
    assert path.endswith("/RES")
    assert rows(read_csv(spark, path, df.schema)) == [(1, "a,b"), (2, None)]
    again = Resolver(spark, result_root=root)(Source("hds", table_name="RES", columns=("id",)))
    assert rows(again) == [("1",), ("2",)]


def test_whole_task_with_lineage(spark):
    functions = {"ToSum": [{"IsEnable": "True", "Step": 1, "TargetColumn": "v", "Naming": "s"}]}
    doc = task([source(table="a", functions=functions), source(table="b")], [pair(["k"], ["id"])])
    doc["ResultParameterSetting"] = {"ColumnTypeList": [
        {"Column": "w", "Type": "DOUBLE", "IsPrimaryKey": "False", "Rename": {"IsEnable": "True", "NewName": "weight"}}]}
    tables = {
        "a": spark.createDataFrame([(1, 2.0), (3, 5.0)], "k int, v double"),
        "b": spark.createDataFrame([("1", "9.5")], "id string, w string"),
    }
    run = plan_task(parse_task(doc), Resolver(spark, tables=tables))
    assert rows(run.result) == [(1, 2.0, 7.0, "9.5"), (3, 5.0, 7.0, None)] and run.result.columns == ["k", "v", "s", "weight"]
    events = run.lineage(spark, datetime(2024, 1, 1), datetime(2024, 1, 2)).collect()
    assert [e.action_id for e in events] == ["DF10-1", "DF40-1", "DF10-1", "DF30-1", "DF50-2"]
    assert events[1].input_runs == [events[0].run_id] and events[3].input_runs == [events[1].run_id, events[2].run_id]
    assert events[0].input_data[0].table_name == "a"


def test_conflicting_names_get_their_declared_rename(spark):
    rename = lambda c, n: {"Column": c, "Type": "", "IsPrimaryKey": "False", "Rename": {"IsEnable": "True" if n else "False", "NewName": n}}
    doc = task([source(table="a"), source(table="b")], [pair(["k"], ["k"])])
    doc["ResultParameterSetting"] = {"ColumnTypeList": [rename("v", ""), rename("v", "right_v")]}
    tables = {t: spark.createDataFrame([(1, x)], "k int, v int") for t, x in (("a", 10), ("b", 20))}
    out = plan_task(parse_task(doc), Resolver(spark, tables=tables)).result
    assert out.columns == ["k", "v", "right_v"] and rows(out) == [(1, 10, 20)]


SPECS = [ColumnSpec("a", "INTEGER"), ColumnSpec("AUTOTIMESTAMP_", "VARCHAR", is_key=True, renames=True, new_name="made")]


def test_ddl_puts_the_key_last():
    assert table_ddl("t", SPECS) == 'CREATE TABLE T ("a" INTEGER, "made" VARCHAR not null, CONSTRAINT pk PRIMARY KEY ("made"));'
    with pytest.raises(ValueError):
        table_ddl("t", SPECS[:1])


def test_generated_key_takes_its_declared_name(spark):
    out = with_key(spark.createDataFrame([("1",), ("2",)], "a string"), SPECS, "2024-01-01 00:00:00")
    assert rows(out, "made") == [("2024-01-01 00:00:00.000000",), ("2024-01-01 00:00:00.000001",)]


def test_store_result_types_and_append(spark):
    doc = task([source()])
    doc["TaskAction"] |= {"Phoenix": "True", "AppendPhoenix": "True"}
    root = fresh_dir(spark, "store")
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    for _ in range(2):
        path = store_result(df, parse_task(doc), [ColumnSpec("a", "INTEGER", is_key=True)], root, "2024-01-01 00:00:00")
    assert rows(spark.read.parquet(path)) == [(None,), (None,), (1,), (1,)]
    with pytest.raises(Exception):
        write_table(df, path, [])


def test_upsert_twice_equals_once(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, "e", 0), (None, "n", 0)], "k int, v string, ver int")
    once = upsert(stored, new, ["k"], ["ver"])
    assert rows(once) == [(None, "n", 0), (1, "a", 1), (2, "c", 5), (3, "e", 0)]
    assert rows(upsert(once, new, ["k"], ["ver"])) == rows(once)


def test_shared_root_comes_from_the_session(spark, tmp_path):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://x/dir/", "spark.master": "yarn"})

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    assert shared_root(Session()) == "hdfs://x/dir"
    del Session.conf["spark.checkpoint.dir"]
    with pytest.raises(ValueError):
        shared_root(Session())


def test_upsert_reads_and_writes_changed_buckets_only(spark):
    table = BucketedTable(spark, fresh_dir(spark, "buckets"), ["k", "s"], ["at"])
    table.create(spark.range(200).selectExpr("id AS k", "IF(id % 9 = 0, NULL, 'x') AS s", "id * 1.0D AS v", "0 AS at"), buckets=16)
    first = table.current()
    changes = spark.createDataFrame([(9, None, 1.5, 1), (9, None, 2.5, 2), (1000, "new", 3.0, 1)], "k int, s string, v double, at long")
    touched = table.upsert(changes)
    second = table.current()
    assert 1 <= len(touched) <= 2 and second.number == first.number + 1
    assert {b for b in first.folders if second.folders[b] != first.folders[b]} == {b for b in touched if b in first.folders}
    old = table._rows(first, [b for b in touched if b in first.folders])
    assert all(any(f"__bucket={b}/" in f for b in touched) for f in old.inputFiles())
    got = {(r.k, r.s): (r.v, r["at"]) for r in table.read().collect()}
    assert len(got) == table.read().count() == 201
    assert got[9, None] == (2.5, 2) and got[1000, "new"] == (3.0, 1) and got[10, "x"] == (10.0, 0)
    assert table.upsert(changes.limit(0)) == [] and table.current() == second


def test_a_version_is_seen_only_when_it_is_committed(spark):
    root = fresh_dir(spark, "buckets")
    table = BucketedTable(spark, root, ["k"])
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.createDataFrame([], "k int, v string"), buckets=4)
    assert table.read().columns == ["k", "v"] and table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"))
    version = table.current()
    changed = spark.createDataFrame([(1, "b")], "k int, v string")
    changed.write.parquet(f"{root}/data/cut-short")  # a run that ended before its manifest
    assert rows(table.read()) == [(None, "n"), (1, "a")]
    table._write(version, changed)
    with pytest.raises(AnalysisException):  # a second writer of the same version
        table._write(version, changed)
    assert rows(table.read()) == [(None, "n"), (1, "b")]
