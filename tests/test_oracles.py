"""Every query with an SQL answer, row by row."""

import compare
import pytest

import __spark_entry__ as entry_module

QUERIES, ANSWERS = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return compare.connect(small_dir)


def test_answers_belong_to_queries():
    assert set(ANSWERS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_matches_its_sql(spark, con, small_dir, name):
    assert compare.differences(QUERIES[name](spark, small_dir), con, ANSWERS[name]) == []


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
