"""Every query against its SQL in DuckDB, on whole tables."""

import os
import re

import pytest

import __spark_entry__ as driver
from workload.check import compare, connect
from workload.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = driver.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython", plan)
    assert "MapInPandas" not in plan or name == "file_manifest"
    assert compare(df, db, driver.oracle_sql()[name]) == ""


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == [
        "record", "acctbal", "first_order", "mktsegment", "nation", "priority", "segment_code", "segment_code_raw", "status",
    ]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())
