"""Every registered query against its check SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from harness import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"resource_id", "safety_score", "quality_score", "nearest_transit_id"} <= set(df.columns)
