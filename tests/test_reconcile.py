"""Comparing tables by buckets."""

import random
import re

from studylake.operators.reconcile import differing_buckets, row_differences, row_differences_by_bucket

SCHEMA = "k bigint, v string, w string"


def rows_of(rng, n):
    return [(rng.randrange(50), rng.choice([None, "", "a", "b"]), rng.choice([None, "", "a"])) for _ in range(n)]


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_comparing_all_rows(frame):
    rng = random.Random(1)
    for n in (0, 5, 300):
        left = rows_of(rng, n)
        for right in (list(reversed(left)), left + left[:2], left[1:], [(None, None, None), *left], rows_of(rng, n)):
            one, two = frame(left, SCHEMA), frame(right, SCHEMA)
            assert as_set(row_differences_by_bucket(one, two)) == as_set(row_differences(one, two))
            assert as_set(row_differences_by_bucket(one, two, buckets=3)) == as_set(row_differences(one, two))


def test_whole_numbers(frame):
    one, two = frame([(1, 2.0), (2, 3.0)], "k int, x double"), frame([(1, 2), (2, 4)], "k int, x bigint")
    assert as_set(row_differences_by_bucket(one, two, ["x"])) == [(2, 3, 1, 0), (2, 4, 0, 1)]


def test_equal_sides_compare_no_rows(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS x")
    assert differing_buckets(rows, rows.orderBy("x")).count() == 0
    plan = row_differences_by_bucket(rows, rows.orderBy("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "LocalRelation <empty>" in plan
    changed = rows.selectExpr("id", "IF(id = 77, 100, x) AS x")
    assert differing_buckets(rows, changed).count() in (1, 2)
    assert as_set(row_differences_by_bucket(rows, changed)) == [(77, 0, 1, 0), (77, 100, 0, 1)]


def test_values_do_not_run_together(frame):
    one = frame([(1, "a", None), (2, None, "a"), (3, "", None)], SCHEMA)
    two = frame([(1, None, "a"), (2, "a", None), (3, None, "")], SCHEMA)
    assert len(as_set(row_differences_by_bucket(one, two))) == 6


def test_rows_are_exchanged_only_in_buckets_that_differ(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS x")
    found = row_differences_by_bucket(rows, rows.where("id <> 3"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search("BroadcastHashJoin.*LeftSemi", plan)
