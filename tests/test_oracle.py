"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from lumenfold.catalog.oracle import ORACLE as SQL
from lumenfold.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


#: Queries whose fits no SQL repeats; test_learned.py compares them with exact solutions.
FITTED = {"enc_semantic", "swot_semantic", "em_trained"}


def test_every_query_is_checked():
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())
    assert set(SQL) == set(QUERIES) - FITTED


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, con, folder, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], folder) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["article_id", "pos", "text", "facet", "sim", "rk"]
    assert df.count() == 60
