"""Every query against its SQL on the supplied tables, and a look at its plan."""

import os
import re

import pytest

from rosterline.catalog import PYTHON, QUERIES, SQL
from tests.compare import database, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in PYTHON:
        assert not re.search("ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)
    assert difference(df, db, SQL[name]) is None
