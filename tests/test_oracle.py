"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_model_choice_is_ranked(spark, sf_dir):
    found = entry.queries()["model_select"](spark, sf_dir).collect()
    scores = [r.area_under_roc for r in found]
    assert len(found) == 3 and scores == sorted(scores, reverse=True)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1500
