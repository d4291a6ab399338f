"""Many fields and rules, and the shared scratch folder."""

import os

import pytest
from pyspark.sql import functions as F

from studylake import session
from studylake.operators import eav, harmonize


def test_many_multi_valued_fields(spark):
    n = 10_050
    rows = spark.range(2 * n).select(
        F.lit("r").alias("record"), F.concat(F.lit("f"), (F.col("id") % n).cast("string")).alias("field_name"), F.lit("v").alias("value")
    ).unionByName(spark.range(5).select(F.lit("r").alias("record"), F.concat(F.lit("s"), "id").alias("field_name"), F.lit("w").alias("value")))
    assert sorted(r.field_name for r in eav.single_rows(rows).collect()) == ["s0", "s1", "s2", "s3", "s4"]
    assert eav.multi_agg(rows).where("value = 'v, v'").count() == n
    wide = eav.wide_raw(rows)
    assert len(wide.columns) == n + 6
    first = wide.select("f7", f"f{n - 1}", "s1").first()
    assert tuple(first) == ("v, v", "v, v", "w")
    assert tuple(eav.wide_raw(rows, ["f7", "s1", "none"]).first()) == ("r", "v, v", "w", None)


def test_many_mapping_rules(spark):
    n = 10_001
    mapping = spark.range(n).selectExpr(
        "cast(id as int) mapping_id", "1L from_variable_id", "id + 2 to_variable_id", "'ge' operator",
        "cast(id as string) operants", "cast(null as bigint) prerequisite_id",
    )
    variables = spark.range(n).selectExpr("id + 2 variable_id", "concat('v', id) name").union(spark.sql("SELECT 1L, 'a.ge'"))
    rules = harmonize.mapping_rules(mapping, variables)
    assert len(rules) == n and rules[-1].destination == f"v{n - 1}"
    data = spark.sql("SELECT 7 AS id, 5000 AS `a.ge`")
    found = harmonize.apply_variable_mapping(data, rules[4990:5010], ["id"]).first()
    assert len(found) == 21 and (found["v4990"], found["v5000"], found["v5001"]) == ("1", "1", "0")


def test_scratch_folder_comes_from_the_session(spark):
    path = session.scratch_path(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert path.startswith(root.rstrip("/") if root else session.scratch_root(spark))
    assert path != session.scratch_path(spark, "x")
    kept = session.materialize(spark.range(3), "kept")
    assert kept.count() == 3


def test_scratch_folder_without_a_setting():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId = "app-1"
        master = "local[2]"

    class Session:
        conf = Conf()
        sparkContext = Context()

    first = session.scratch_root(Session())
    assert os.path.isdir(first) and session.scratch_root(Session()) == first
    Context.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
