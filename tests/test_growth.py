"""What moves in a shuffle, and what is joined: plans whose cost must not grow faster than the input."""

import re

from conftest import rows
from millrace.llm import lines
from millrace.operators import graph, lineage


def _shuffled_by(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan)


def _sets(spark):
    """A hot set twice, once in another order and with repeats, one with a member less, small and null ones."""
    hot = [("a", i) for i in range(3000)] + [("b", i) for i in reversed(range(3000))] + [("b", 5)] * 10
    other = [("c", i) for i in range(2999)] + [(f"s{i}", i % 3) for i in range(300)] + [(None, 1), (None, 1), ("n", None)]
    sets = [(run, "x", item) for run, item in hot + other]
    return spark.createDataFrame(sets, "run string, action string, item int").repartition(5)


def test_sets_move_once_and_keep_their_fingerprint(spark):
    found = lineage.set_digest(_sets(spark), ["run", "action"], "item")
    assert not [by for by in _shuffled_by(found) if "item#" in by]
    by_run = {r["run"]: (r["size"], r["digest"]) for r in found.collect()}
    assert len(by_run) == 305 and found.count() == 305
    assert by_run["a"] == by_run["b"] and by_run["a"][0] == 3000 and by_run["c"][0] == 2999
    assert by_run["c"] != by_run["a"] and by_run["s0"] == by_run["s3"] and by_run[None] == by_run["s1"]
    assert by_run["n"][0] == 1


def test_links_of_runs_are_not_shuffled_before_they_have_a_process(spark):
    inputs = spark.createDataFrame([("r1", "data", "t"), ("r1", "data", "t"), ("r2", "run", "r1"), ("r2", "other", "z")],
                                   "run string, input_kind string, input string")
    outputs = spark.createDataFrame([("r1", "u"), ("r2", "v"), ("r2", "v")], "run string, output string")
    members = spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "run string, process_id string")
    found = lineage.lineage_edges(inputs, outputs, members, "run")
    assert not [by for by in _shuffled_by(found) if "kind#" in by]
    assert rows(found) == [("p1", "p2"), ("p1", "u"), ("p2", "v"), ("t", "p1")]


def test_pairs_are_joined_in_one_direction_and_lists_move_once(spark):
    edges = spark.createDataFrame([(s, t, "RELATED") for t, group in (("1", "abc"), ("2", "cb"), ("3", "d"), ("4", "ea")) for s in group],
                                  "src string, dst string, kind string")
    pairs = graph.neighbours(edges)
    assert re.search(r"src#\d+ < src#\d+", pairs._jdf.queryExecution().executedPlan().toString())
    assert rows(pairs) == [("a", "b"), ("a", "c"), ("a", "e"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("e", "a")]
    lists = graph.related_lists(edges, limit=2)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan and "ShuffledHashJoin" in plan
    assert sum(len(r["related"]) for r in lists.collect()) == 8


def test_texts_are_cleaned_and_measured_by_one_python_worker(spark):
    docs = spark.createDataFrame([(i, "h", f"common line here\nown words {i}") for i in range(12)], "doc_id long, source string, text string")
    judged = lines.judge(docs)
    assert "ArrowEvalPython" not in judged._jdf.queryExecution().executedPlan().toString()
    assert all("common" not in r.clean for r in judged.collect())
