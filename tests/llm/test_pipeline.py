"""The pipeline as a whole, and each stage on odd rows."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import kneser, mixing, pieces, queries, secrets
from test_llm import frame, sentence, weighted

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "password = hunter2hunter2"


def corpus():
    """Trusted prose, copies, near copies, secrets, junk, and rows with nulls."""
    texts = [sentence(60, 2_000 + i) for i in range(40)]
    texts += [texts[3]] * 4 + [texts[5] + " end", texts[7] + f" {SECRET}"]
    texts += [f"{SECRET}\n{sentence(40, 2_100)}", "zzz " * 50, "", None, "\n", sentence(3_000, 2_200)]
    rows = [(i, t, "en" if i % 5 else None, f"s{i % 2}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, sentence(50, 2_300), "en", "s1", 1), rows[9], (None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    marks = [(i, int(i < 40), 0) for i in range(0, 50, 2)] + [(None, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_whole_pipeline_equals_its_steps_by_hand(spark, tables):
    docs, marks = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    judged = {(r.doc_id, r.lang) for r in kneser.scores(docs, marks).where("kept").collect()}
    rows = [r for r in docs.collect() if (r.doc_id, r.lang or "") in judged and (r.text or "").split()]
    assert len(rows) > 5 and any(SECRET in r.text for r in rows)
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if weighted(rows[i].text, rows[j].text) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    first = lambda g: min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    kept = [(r.doc_id, secrets.redacted(r.text), r.lang, r.source, r.n_chars) for r in map(first, groups.values())]
    taken = mixing.copies(spark.createDataFrame(kept, DOCS)).collect()
    processor = pieces.load(queries.PIECE_MODEL)
    expected = Counter()
    text_of = {k[0]: k[1] for k in kept}
    for r in taken:
        ids = processor.encode(text_of[r.doc_id], add_bos=True, add_eos=True)
        own = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()
        if r.copies:
            expected[r.doc_id, len(ids), *own] += r.copies
    found = corpus_pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, found.collect())) == expected
    assert not any(SECRET in t for t in text_of.values())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_and_empty_tables(spark, tables, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.selectExpr("*", "'x' AS row", "'y' AS size", "'z' AS node")  # names that the operators use inside
    for given in (docs, more):
        found = stage[1](spark, given, tables)
        if stage is not corpus_pipeline.STAGES[-1]:
            assert found.dtypes == given.dtypes
        assert 0 < found.count() <= 2 * given.count()
        assert stage[1](spark, given.limit(0), tables).count() == 0
