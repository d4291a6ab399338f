"""Catalog operators on small states."""

import random

import pytest
from pyspark.sql import functions as F

from studylake.operators import catalog as cat
from studylake.operators.ids import assign_ids
from studylake.operators.reconcile import assert_same_rows, row_differences, void_to_string

KEYS, ATTRIBUTES = ["domain_id", "name"], ["value_type_id", "description"]
VARIABLES = "variable_id bigint, domain_id bigint, name string, value_type_id int, description string"
INCOMING = "domain_id bigint, name string, value_type_id int, description string, ord int"
VERSIONS = "version_id bigint, asset_id bigint, major int, minor int, patch int, created_at timestamp, is_latest boolean"


def as_set(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.fixture
def variables(frame):
    return frame([(1, 0, "age", 1, "Age"), (5, 0, "sex", 7, "Sex")], VARIABLES)


def test_upsert(frame, variables):
    incoming = frame([(0, "age", 2, "first", 1), (0, "age", 3, None, 2), (1, "age", 1, "new", 3)], INCOMING)
    after = cat.upsert_by_key(variables, incoming, KEYS, "variable_id", ATTRIBUTES, "ord")
    assert as_set(after) == [(1, 0, "age", 3, None), (5, 0, "sex", 7, "Sex"), (6, 1, "age", 1, "new")]
    again = cat.upsert_by_key(after, incoming, KEYS, "variable_id", ATTRIBUTES, "ord")
    assert as_set(again) == as_set(after)


def test_insert_if_absent(frame, variables):
    incoming = frame([(0, "age", 2, "other", 1), (2, None, 1, "unnamed", 2)], INCOMING)
    after = cat.insert_if_absent(variables, incoming, KEYS, "variable_id", ATTRIBUTES, "ord")
    assert as_set(after) == [(1, 0, "age", 1, "Age"), (5, 0, "sex", 7, "Sex"), (6, 2, None, 1, "unnamed")]


def test_ids_are_dense_and_repeatable(spark, frame):
    rows = spark.range(5000).select((F.col("id") * 7).alias("k"))
    existing = frame([(10,), (40,)], "id bigint")
    first = assign_ids(rows, ["k"], "id", existing)
    ids = {r.k: r.id for r in first.collect()}
    assert sorted(ids.values()) == list(range(41, 5041))
    assert {r.k: r.id for r in assign_ids(rows.repartition(13), ["k"], "id", existing).collect()} == ids


def test_replace_children_reloads_and_empties(frame):
    items = "vocabulary_id bigint, value bigint, code string"
    existing = frame([(1, 1, "A"), (1, 2, "B"), (2, 1, "C"), (3, 1, "D")], items)
    incoming = frame([(1, 1, "X"), (1, 2, "Y"), (1, 3, "Z"), (3, None, None)], items)
    assert as_set(cat.replace_children(existing, incoming, "vocabulary_id")) == [(1, 1, "X"), (1, 2, "Y"), (1, 3, "Z"), (2, 1, "C")]


def test_link_update_lookup(frame, variables):
    links = frame([(1, 1)], "study_id bigint, domain_id bigint")
    more = frame([(1, 1), (1, 2), (1, 2)], "study_id bigint, domain_id bigint")
    assert as_set(cat.link_if_absent(links, more, ["study_id", "domain_id"])) == [(1, 1), (1, 2)]
    changes = frame([(5, None), (9, 3)], "variable_id bigint, value_type_id int")
    assert as_set(cat.update_by_key(variables, changes, ["variable_id"], ["value_type_id"])) == [(1, 0, "age", 1, "Age"), (5, 0, "sex", None, "Sex")]
    wanted = frame([(0, "age"), (3, "age")], "domain_id bigint, name string")
    found = {r.domain_id: (r.variable_id, r.found) for r in cat.lookup_by_key(variables, wanted, KEYS).collect()}
    assert found == {0: (1, True), 3: (None, False)}


def test_names_used_in_several_domains(frame):
    vocabularies = frame([(1, 0, "status"), (2, 1, "status"), (3, 1, "sex")], "vocabulary_id bigint, domain_id bigint, name string")
    assert cat.unique_id(vocabularies, "sex") == 3
    assert cat.unique_id(vocabularies, "height") is None
    with pytest.raises(ValueError, match="2 domains"):
        cat.unique_id(vocabularies, "status")


@pytest.fixture
def versions(frame):
    rows = [(1, 1, 1, 0, 0, None, True), (2, 1, 1, 10, 0, None, False), (3, 2, 1, 9, 0, None, None), (4, 2, 1, 10, 0, None, None)]
    return frame(rows, VERSIONS)


def test_versions(frame, versions):
    assert {r.asset_id: r.version_id for r in cat.latest_versions(versions).collect()} == {1: 1, 2: 4}
    requests = frame([(1, "major"), (2, "minor"), (3, "patch"), (2, None)], "asset_id bigint, bump string")
    assert as_set(cat.next_versions(requests, versions)) == [(1, 2, 0, 0), (2, 1, 10, 1), (2, 1, 11, 0), (3, 1, 0, 0)]
    flagged = cat.set_latest(versions)
    assert flagged.columns == versions.columns
    assert {r.version_id for r in flagged.where("is_latest").collect()} == {2, 4}
    assert [r.version_label for r in cat.version_history(versions.where("asset_id = 2")).collect()] == ["v1.9.0", "v1.10.0"]


def test_constraints(frame):
    domains = frame([(1, "a", None), (2, "a", None), (3, "a", "u"), (4, "b", None)], "domain_id bigint, name string, uri string")
    links = frame([(7, 1), (7, 9)], "study_id bigint, domain_id bigint")
    found = cat.constraint_violations({"domains": domains, "study_domains": links})
    assert as_set(found) == [("duplicate domains", "a|NULL", 2), ("orphan study_domains.domain_id", "9", 1)]
    whole = cat.constraint_violations({"domains": domains, "study_domains": links}, changed=["study_domains"])
    assert as_set(whole) == [("orphan study_domains.domain_id", "9", 1), ("orphan study_domains.study_id", "7", 2)]
    assert as_set(cat.constraint_violations({"transformations": frame([], "transformation_id bigint")}, changed=["transformations"])) == []


def test_unknown_transformation_type_fails(frame):
    bad = frame([(1, "guess")], "transformation_id bigint, transformation_type string")
    with pytest.raises(Exception, match="unknown transformation type guess"):
        cat.checked_transformations(bad).collect()


def test_lineage_of_a_diamond_and_a_cycle(frame):
    edge = "transformation_id bigint, version_id bigint"
    # 4 <- t1 <- 2, 3 <- t2 <- 1 <- t3 <- 4 (a cycle back).
    outputs = frame([(1, 4), (2, 2), (2, 3), (3, 1)], edge)
    inputs = frame([(1, 2), (1, 3), (2, 1), (3, 4)], edge)
    found = cat.lineage(frame([(4,)], "version_id bigint"), inputs, outputs)
    assert as_set(found.select("seed_id", "version_id", "depth")) == [(4, 1, 2), (4, 2, 1), (4, 3, 1)]


def test_lineage_rounds_grow_with_the_logarithm_of_the_depth(frame):
    edge = "transformation_id bigint, version_id bigint"
    n = 1000
    outputs, inputs = frame([(i, i + 1) for i in range(n)], edge), frame([(i, i) for i in range(n)], edge)
    found, rounds = cat.lineage_rounds(frame([(n,), (400,)], "version_id bigint"), inputs, outputs)
    assert rounds == 11  # 2^10 steps, and one round that finds nothing
    assert sorted((r.seed_id, r.version_id, r.depth) for r in found.collect()) == [(400, v, 400 - v) for v in range(400)] + [(n, v, n - v) for v in range(n)]


def test_lineage_equals_a_walk(frame):
    """Random graphs with cycles, versions made twice, and transformations of many versions."""
    edge = "transformation_id bigint, version_id bigint"
    rng = random.Random(6)
    for versions, transformations in ((12, 6), (40, 30), (60, 90)):
        outputs = [(rng.randrange(transformations), rng.randrange(versions)) for _ in range(transformations)]
        inputs = [(rng.randrange(transformations), rng.randrange(versions)) for _ in range(transformations + 5)]
        seeds = rng.sample(range(versions), 5)
        expected = set()
        for seed in seeds:
            seen, frontier, depth = {seed}, {seed}, 0
            while frontier:
                depth += 1
                made = {t for t, v in outputs if v in frontier}
                frontier = {v for t, v in inputs if t in made} - seen
                seen |= frontier
                expected |= {(seed, v, depth) for v in frontier}
        found = cat.lineage(frame([(s,) for s in seeds * 2], "version_id bigint"), frame(inputs * 2, edge), frame(outputs, edge))
        assert {tuple(r) for r in found.collect()} == expected
        assert found.count() == len(expected)
    assert cat.lineage(frame([(1,)], "version_id bigint"), frame([], edge), frame([], edge)).collect() == []


def test_keys_that_look_alike(frame):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, "x", None), (4, "x", "NULL"), (5, "y\\", "|"), (6, "y", "\\||"), (7, "z", ""), (8, "z", None), (9, "q", "=")]
    domains = frame(rows, "domain_id bigint, name string, uri string")
    assert cat.constraint_violations({"domains": domains}).collect() == []
    twice = frame(rows + [(10, "a|b", "c"), (11, "x", None)], "domain_id bigint, name string, uri string")
    assert as_set(cat.constraint_violations({"domains": twice})) == [("duplicate domains", "a|b|c", 2), ("duplicate domains", "x|NULL", 2)]


def test_values_that_columns_may_not_hold(frame):
    state = {
        "assets": frame([(1, 1, "a", "dataset"), (2, 1, "b", "table"), (3, 1, "c", None)], "asset_id bigint, study_id bigint, name string, asset_type string"),
        "studies": frame([(1, "s", 9), (2, "t", 2)], "study_id bigint, name string, study_type_id int"),
        "variable_mapping": frame([(1, 1, 1, "like", "x", None)], "mapping_id int, from_variable_id bigint, to_variable_id bigint, operator string, operants string, prerequisite_id bigint"),
    }
    assert as_set(cat.constraint_violations(state)) == [
        ("unknown assets.asset_type", "table", 1), ("unknown studies.study_type_id", "9", 1), ("unknown variable_mapping.operator", "like", 1),
    ]


def test_checks_of_touched_rows_refuse_the_same(frame):
    """Random changes to a sound state: both checks tell the same, whatever was added, altered or removed."""
    rng = random.Random(8)
    schema = {
        "domains": "domain_id bigint, name string, uri string", "vocabularies": "vocabulary_id bigint, domain_id bigint, name string, description string",
        "vocabulary_items": "vocabulary_item_id bigint, vocabulary_id bigint, value bigint",
    }
    before = {
        "domains": [(i, f"d{i}", None) for i in range(12)], "vocabularies": [(i, i % 12, f"v{i}", "") for i in range(30)],
        "vocabulary_items": [(i, i % 25, i) for i in range(60)],
    }
    for _ in range(6):
        after = {name: list(rows) for name, rows in before.items()}
        for _ in range(rng.randint(0, 2)):
            after["domains"].remove(rng.choice(after["domains"]))
            after["domains"].append((rng.randint(0, 14), f"d{rng.randint(0, 14)}", rng.choice([None, "u"])))
            after["vocabularies"][rng.randrange(20)] = (rng.randint(0, 31), rng.randint(0, 13), f"v{rng.randint(0, 31)}", "new")
            after["vocabulary_items"].append((rng.randint(50, 70), rng.randint(20, 32), 1))
        changed = [name for name in after if after[name] != before[name]]
        state = {name: frame(rows, schema[name]) for name, rows in after.items()}
        moved = {name: frame(sorted(set(before[name]) ^ set(after[name]), key=repr) + [r for r in after[name] if after[name].count(r) > 1], schema[name]) for name in changed}
        full = as_set(cat.constraint_violations(state, changed=changed))
        assert as_set(cat.constraint_violations(state, changed=changed, touched=moved)) == full
        partly = {name: rows for name, rows in moved.items() if name != "domains"}
        assert as_set(cat.constraint_violations(state, changed=changed, touched=partly)) == full


def test_untouched_keys_are_not_grouped(frame):
    versions = frame([(i, i // 3, i % 3, 0, 0, i % 3 == 2) for i in range(3000)], "version_id bigint, asset_id bigint, major int, minor int, patch int, is_latest boolean")
    touched = {"asset_versions": versions.where("asset_id = 5")}
    found = cat.constraint_violations({"asset_versions": versions}, changed=["asset_versions"], touched=touched)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")
    # One asset in the state is wrong; the check of other assets does not see it.
    wrong = versions.union(versions.where("version_id = 2990"))
    assert cat.constraint_violations({"asset_versions": wrong}, changed=["asset_versions"], touched=touched).where("violation LIKE 'dup%'").collect() == []


def test_row_differences(frame):
    left = frame([(1, "a"), (1, "a"), (2, None)], "k bigint, v string")
    right = frame([(1, "a"), (2, None), (3, "c")], "k bigint, v string")
    assert as_set(row_differences(left, right)) == [(1, "a", 2, 1), (3, "c", 0, 1)]
    assert_same_rows(left, left.orderBy("v"))
    with pytest.raises(AssertionError):
        assert_same_rows(left, right)


def test_void_columns_become_text(frame):
    df = void_to_string(frame([(1,)], "k bigint").withColumn("x", F.lit(None)))
    assert dict(df.dtypes) == {"k": "bigint", "x": "string"}


def test_vocabularies_keep_empty_lists(frame):
    vocabularies = frame([(1, "sex"), (2, "none")], "vocabulary_id bigint, name string")
    items = frame([(1, 2, "f", "Female"), (1, 1, "m", "Male")], "vocabulary_id bigint, value bigint, code string, description string")
    nested = {r.name: [tuple(i) for i in r["items"]] for r in cat.vocabulary_items_nested(vocabularies, items).collect()}
    assert nested == {"sex": [(1, "m", "Male"), (2, "f", "Female")], "none": []}


def test_hot_asset(spark):
    """One asset with a third of all versions: one row out, and no window over the group."""
    versions = spark.range(60000).select(
        F.col("id").alias("version_id"), F.when(F.col("id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("id")).alias("asset_id"),
        F.lit(1).alias("major"), F.lit(0).alias("minor"), F.col("id").cast("int").alias("patch"), F.lit(False).alias("is_latest"),
    )
    latest = cat.latest_versions(versions)
    assert latest.where("asset_id = 0").first().patch == 59997
    assert "Window" not in latest._jdf.queryExecution().executedPlan().toString()


def test_datasets_described(frame):
    assets = frame([(1, 7, "a", "dataset"), (2, 7, "f", "file"), (3, 8, "b", "dataset")], "asset_id bigint, study_id bigint, name string, asset_type string")
    versions = frame(
        [(10, 1, 1, 0, 0, False), (11, 1, 1, 1, 0, True), (20, 2, 1, 0, 0, True), (30, 3, 1, 0, 0, True)],
        "version_id bigint, asset_id bigint, major int, minor int, patch int, is_latest boolean",
    )
    links = frame([(11, 1, 2, None), (11, 2, 1, "record"), (11, 3, None, None), (10, 1, 1, "none")], "version_id bigint, variable_id bigint, ordinal int, keyrole string")
    variables = frame(
        [(1, 5, "x", 7, "none", 100), (2, 5, "y", 1, "none", None), (3, 5, "w", 1, "external", None)],
        "variable_id bigint, domain_id bigint, name string, value_type_id int, keyrole string, vocabulary_id bigint",
    )
    nested = cat.vocabulary_items_nested(frame([(100, "v")], "vocabulary_id bigint, name string"), frame([(100, 1, "N", None)], "vocabulary_id bigint, value bigint, code string, description string"))
    found = {r.version_id: r for r in cat.datasets_described(assets, versions, links, variables, nested).collect()}
    assert [(v.name, v.ordinal, v.keyrole, [i.code for i in v["items"]]) for v in found[11].variables] == [
        ("y", 1, "record", []), ("x", 2, "none", ["N"]), ("w", None, "external", []),
    ]
    assert found[30].variables == [] and set(found) == {11, 30}
    assert set(r.version_id for r in cat.datasets_described(assets, versions, links, variables, include_versions=True).collect()) == {10, 11, 30}


def test_provenance_is_counted_without_copies_of_each_row(spark, tmp_path):
    import __spark_entry__

    spark.sql("SELECT s_suppkey, concat('s', s_suppkey) AS s_name FROM VALUES (0L), (1L), (5L), (null) AS t(s_suppkey)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql(
        "SELECT * FROM VALUES (0L, 1L, 'R'), (0L, 1L, 'R'), (0L, 2L, 'N'), (5L, 2L, 'N'), (5L, 3L, 'A'), (1L, null, 'R'), (1L, 9L, 'N'), (8L, 4L, 'R')"
        " AS t(l_suppkey, l_orderkey, l_returnflag)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    counted = __spark_entry__.queries()["record_provenance"](spark, str(tmp_path))
    found = {r.transformation_type: (r.n, r.n_inputs, r.n_outputs) for r in counted.collect()}
    assert found == {"ingest": (4, 3, 2), "transform": (2, 1, 1), "repository": (0, 0, 0)}
    assert "Expand" not in counted._jdf.queryExecution().optimizedPlan().toString()
