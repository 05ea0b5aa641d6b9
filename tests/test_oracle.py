"""Every registered query against its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# A study on 150 persons has too few cases for a finite odds ratio.
TOO_SMALL = {"c09_unadjusted_estimates", "c10_adjusted_estimates", "c11_compare_studies"}


# Queries on texts and vectors have their own tests.
TEXT = {n for n in QUERIES if n.startswith("op") or n == "pipeline"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - TOO_SMALL - TEXT))
def test_matches_sql(spark, con, name):
    ok, why, _ = compare(QUERIES[name](spark, SF), con.sql(ORACLES[name]))
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - TOO_SMALL - TEXT))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
