"""Every registered query against its SQL at the smallest scale, and the contract of the entry file."""

import pytest

import __spark_entry__ as entry
import check_results
from conftest import SMALL

# At this scale these have no rows to compare: all documents have a vector, and the event of the
# leaderboard or the excluded word may be absent.
MAY_BE_EMPTY = {"embed_queue", "embed_batches", "leaderboard", "lexical_search_excluding", "index_search_excluding"}


@pytest.fixture(scope="module")
def con():
    return check_results.connect(SMALL)


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    problem = check_results.compare(spark, con, SMALL, name)
    assert problem is None or (problem == "both are empty" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
