"""The Merkle manifest against a plain version by definition."""

import hashlib

import pytest

from millrace.llm import merkle
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, grp string, pos string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def tree(leaves):
    """Root, and the siblings before and after each leaf, level by level."""
    paths = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 3, len(nodes)))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                step = ("".join(nodes[i] for i in run if i < k), "".join(nodes[i] for i in run if i > k))
                for x in under[k]:
                    paths[x].append(step)
        nodes = [h("".join(nodes[i] for i in run)) for run in runs]
        under = [[x for i in run for x in under[i]] for run in runs]
    return nodes[0], paths


def brute(rows):
    """Sorted (doc_id, leaf, path, subroot, root) by definition."""
    first = lambda v: (v is not None, v)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r[0], leaf_of(r, r[1])) for r in rows if r[3] == s), key=lambda x: (first(x[0]), x[1])) for s in sources}
    trees = {s: tree([x[1] for x in own[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    found = []
    for s, top in zip(sources, tops):
        for (doc, leaf), path in zip(own[s], trees[s][1]):
            found.append((doc, leaf, path + top, trees[s][0], root))
    return sorted(found, key=str)


def got(frame):
    return sorted(
        ((r.doc_id, r.leaf, [tuple(x) for x in r.path], r.subroot, r.root) for r in frame.collect()), key=str
    )


def texts(n, source):
    return [(i * 7 % n, f"text {i}\nof é {source}", "en", source, i, "clash", "clash", "clash") for i in range(n)]


ODD = [
    (None, None, None, None, None, None, None, None),
    (3, None, "en", None, 1, "x", None, "x"),
    (3, "", "en", "one", 0, "x", "x", "x"),
    (5, "y\n" * 50_000, None, "é", 100_000, "x", "x", "x"),
    (7, "same", "en", "twice", 4, "x", "x", "x"),
    (7, "same", "en", "twice", 4, "x", "x", "x"),
    (7, "other", "en", "twice", 5, "x", "x", "x"),
]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_the_definition(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # blocks of 3, 9 and 729 leaves
    rows = ODD + texts(100, "hot") + texts(28, "b") + texts(27, "a") + texts(2, "Z")
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(merkle.manifest(docs)) == brute(rows)


def test_one_source_and_one_row(spark):
    for rows in (texts(1, "a"), texts(4, "a"), ODD[:1]):
        assert got(merkle.manifest(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS), F.col("text")).count() == 0


@pytest.mark.parametrize("sent", [100_000, 0])
def test_tampering_is_seen(spark, monkeypatch, sent):
    monkeypatch.setattr(merkle, "MOST_SENT", sent)
    rows = ODD + texts(40, "hot") + texts(5, "b")
    docs = spark.createDataFrame(rows, DOCS)
    tampered = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.audit(docs, tampered).collect()
    by_leaf = {r.leaf: r for r in found}
    assert len(found) == len(rows)
    for row in rows:
        r = by_leaf[leaf_of(row, row[1])]
        text = row[1].replace("\n", "") if row[0] is not None and row[0] % 2 and row[1] else row[1]
        value = leaf_of(row, text)
        for before, after in r.path:
            value = h(before + value + after)
        assert (r.folded_root, r.verified) == (value, value == r.root)
        assert r.verified == (text == row[1])
        assert r.proof_sha256 == h("".join(a + b for a, b in r.path))


def test_blocks_are_bounded_and_levels_share_a_shuffle(spark):
    """One exchange by source and block serves all levels; no window is over a source alone."""
    nodes = spark.range(2_000).select(
        (F.col("id") % 2).cast("string").alias("grp"), F.expr("id div 2").alias("pos"), F.lit(1_000).cast("long").alias("n"),
        F.sha2(F.col("id").cast("string"), 256).alias("h"),
    )
    plan = merkle._levels(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(grp") == 1 and plan.count("Sort [grp") == 1
    assert "block" in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
