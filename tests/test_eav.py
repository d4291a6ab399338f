"""EAV pipeline on inputs with known answers and on skewed ones."""

import random

import pytest
from pyspark.sql import functions as F

from studylake.operators import eav
from studylake.types import CATEGORY, EAV_SCHEMA, INTEGER, MULTIRESPONSE, STRING, TIME, Variable

ROWS = [
    ("1", "age", "30"), ("1", "visit", "b"), ("1", "visit", "a"), ("1", "visit", "a"), ("1", "sex", "1"),
    ("2", "age", None), ("2", "visit", None), ("2", "sex", "none"), ("3", "visit", None), ("3", "visit", "c"), (None, "age", "5"),
]


@pytest.fixture
def rows(frame):
    return frame(ROWS, EAV_SCHEMA)


def as_set(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_fields_and_counts(rows):
    assert [r[0] for r in eav.field_names(rows).collect()] == ["age", "sex", "visit"]
    assert as_set(eav.multi_fields(rows)) == [("visit",)]
    counted = {(r.record, r.field_name): r.n for r in eav.counts(rows).collect()}
    assert counted[("1", "visit")] == 3 and counted[("2", "age")] == 1 and counted[("3", "visit")] == 2


def test_wide_raw(rows):
    expected = [("1", "30", "1", "a, a, b"), ("2", None, "none", None), ("3", None, None, "c"), (None, "5", None, None)]
    assert as_set(eav.wide_raw(rows)) == sorted(expected, key=str)
    assert as_set(eav.pivot(eav.prepped(rows), ["age", "sex", "visit"])) == sorted(expected, key=str)


def test_wide_raw_of_chosen_fields_keeps_all_records(rows):
    wide = eav.wide_raw(rows, ["sex"])
    assert wide.columns == ["record", "sex"]
    assert as_set(wide) == sorted([("1", "1"), ("2", "none"), ("3", None), (None, None)], key=str)


def test_pivot_of_chosen_fields(rows):
    prepped = eav.prepped(rows)
    assert as_set(eav.pivot(prepped, ["visit"])) == sorted([("1", "a, a, b"), ("2", None), ("3", "c"), (None, None)], key=str)
    assert as_set(eav.pivot(prepped, ["visit", "nowhere", "age"])) == sorted(
        [("1", "a, a, b", None, "30"), ("2", None, None, None), ("3", "c", None, None), (None, None, None, "5")], key=str
    )
    assert as_set(eav.pivot(prepped, [])) == [("1",), ("2",), ("3",), (None,)]


def test_names_beyond_ascii_keep_their_columns(frame):
    names = ["a", "B", "z", "é", "É", "ß", "日", "\U0001F600", "\uffee", "_", "10", "9"]
    rows = frame([("1", n, f"v{n}") for n in names[::2]] + [("2", n, f"w{n}") for n in names[1::2]], EAV_SCHEMA)
    wide = eav.wide_raw(rows, names).orderBy("record").collect()
    assert list(wide[0].asDict().items())[1:] == [(n, f"v{n}" if i % 2 == 0 else None) for i, n in enumerate(names)]
    assert list(wide[1].asDict().items())[1:] == [(n, f"w{n}" if i % 2 else None) for i, n in enumerate(names)]


def test_wide_typed(rows):
    variables = [Variable("age", INTEGER), Variable("sex", CATEGORY), Variable("visit", MULTIRESPONSE)]
    wide = eav.wide_typed(rows, variables, ordered=True)
    assert wide.columns == ["record", "age", "sex", "sex_raw", "visit"]
    assert [tuple(r) for r in wide.collect()] == [
        (None, 5, None, None, None), (1, 30, 1, "1", "a, a, b"), (2, None, None, "none", None), (3, None, None, None, "c"),
    ]
    text = eav.wide_typed(rows.withColumn("record", F.concat(F.lit("r"), "record")), variables, integer_record=False)
    assert {r.record for r in text.collect()} == {"r1", "r2", "r3", None}


@pytest.mark.parametrize("seed", range(3))
def test_random_rows_follow_a_plain_reading(frame, seed):
    random.seed(seed)
    pick = random.choice
    rows = [
        (pick(["1", "2", "3", "", None]), pick(["a", "b", "c", "a b", "", None]), pick(["x", "y", "é", "", ", ", None]))
        for _ in range(random.randint(1, 120))
    ]
    fields = ["a b", "c", "", "a", "absent"]
    cells = {record: {field: [] for field in fields} for record, _, _ in rows}
    for record, field, value in rows:
        if field in fields and value is not None:
            cells[record][field].append(value)
    expected = [
        (record, *[", ".join(sorted(by[f], key=lambda v: v.encode())) if by[f] else None for f in fields])
        for record, by in cells.items()
    ]
    got = as_set(eav.wide_raw(frame(rows, EAV_SCHEMA), fields))
    assert got == sorted(expected, key=str)
    named = eav.flat_named_multi(frame(rows, EAV_SCHEMA), ["a"], ["c", "a b"])
    kept = {r for r, f, _ in rows if f is not None and f != "a"}
    flat = [
        (min(by["c"], default=None, key=lambda v: v.encode()), min(by["a b"], default=None, key=lambda v: v.encode()),
         ", ".join(sorted(by["a"], key=lambda v: v.encode())) if by["a"] else None)
        for r, by in cells.items() if r in kept
    ]
    assert as_set(named) == sorted(flat, key=str)


def test_extra_key_columns(frame):
    rows = frame(
        [("1", "base", "w", "70"), ("1", "year1", "w", "72"), ("1", "year1", "h", "180")],
        "record string, event string, field_name string, value string",
    )
    assert as_set(eav.wide_raw(rows, keys=("record", "event"))) == [("1", "base", None, "70"), ("1", "year1", "180", "72")]


def test_unpivot_gives_single_valued_rows_back(frame):
    random.seed(3)
    cells = {(str(r), f"f{f}"): str(random.randint(0, 9)) for r in range(20) for f in range(6) if random.random() < 0.6}
    rows = frame([(r, f, v) for (r, f), v in cells.items()], EAV_SCHEMA)
    wide = eav.wide_raw(rows)
    long = wide.unpivot("record", wide.columns[1:], "field_name", "value").where("value IS NOT NULL")
    assert {(r.record, r.field_name): r.value for r in long.collect()} == cells


def test_many_columns(frame):
    names = [f"f{i:03d}" for i in range(300)]
    rows = frame([(str(r), n, f"{r}{n}") for r in range(4) for n in names if (r + int(n[1:])) % 3], EAV_SCHEMA)
    wide = eav.wide_raw(rows)
    assert wide.columns == ["record", *names]
    for row in wide.collect():
        assert all(row[n] == (f"{row.record}{n}" if (int(row.record) + int(n[1:])) % 3 else None) for n in names)


def test_hot_record_and_field(spark):
    """One record holds a third of all rows, nearly all of them in one field with few values."""
    hot = spark.range(30000).select(F.lit("hot").alias("record"), F.lit("code").alias("field_name"), (F.col("id") % 3).cast("string").alias("value"))
    cold = spark.range(60000).select((F.col("id") % 20000).cast("string").alias("record"), F.concat(F.lit("f"), (F.col("id") / 20000).cast("int")).alias("field_name"), F.lit("v").alias("value"))
    wide = eav.wide_raw(hot.unionByName(cold))
    assert wide.count() == 20001
    cell = wide.where("record = 'hot'").first().code
    assert cell == ", ".join(["0"] * 10000 + ["1"] * 10000 + ["2"] * 10000)


def test_plan_has_two_shuffles(rows):
    plan = eav.wide_typed(rows, [Variable("age", INTEGER), Variable("visit", STRING)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan


def test_variables(frame, rows):
    variables = frame(
        [(1, 0, "age", INTEGER, None), (2, 0, "sex", CATEGORY, None), (3, 1, "height", INTEGER, None)],
        "variable_id bigint, domain_id bigint, name string, value_type_id int, value_format string",
    )
    fields = eav.field_names(rows)
    assert as_set(eav.unmatched_fields(fields, variables)) == [("visit",)]
    matched = eav.variable_match(fields, variables)
    assert eav.variable_list(matched) == [Variable("age", INTEGER), Variable("sex", CATEGORY)]
    twice = variables.unionByName(variables.where("name = 'age'").withColumn("domain_id", F.lit(5).cast("bigint")))
    assert as_set(eav.duplicate_matches(fields, twice)) == [("age", 2)]
    with pytest.raises(ValueError, match="several domains.*age"):
        eav.variable_list(eav.variable_match(fields, twice))


def test_flat_named_multi(rows):
    flat = eav.flat_named_multi(rows, ["visit"])
    assert flat.columns == ["age", "sex", "visit"]
    # Record 3 has only the named field and is left out.
    assert as_set(flat) == sorted([("30", "1", "a, a, b"), (None, "none", None), ("5", None, None)], key=str)


def test_partial_typed(rows):
    wide = eav.wide_raw(rows)
    typed = eav.partial_typed(wide, [Variable("sex", CATEGORY), Variable("age", INTEGER)])
    assert typed.columns == ["sex", "sex_raw", "age", "record", "visit"]


def test_arrays_and_times(spark, frame):
    rows = frame([("1", "signs", "2"), ("1", "signs", "1"), ("1", "at", "5:30")], EAV_SCHEMA)
    variables = [Variable("signs", MULTIRESPONSE), Variable("at", TIME, "%H:%M")]
    assert tuple(eav.wide_typed(rows, variables, multiresponse_as_array=True).first()) == (1, [1, 2], "05:30:00")
    before = spark.conf.get("spark.sql.timeType.enabled")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        assert str(eav.wide_typed(rows, variables, as_time=True).first().at) == "05:30:00"
    finally:
        spark.conf.set("spark.sql.timeType.enabled", before)


def test_odd_field_names(frame):
    rows = frame([("1", "a.b", "x"), ("1", "c`d", "y"), ("1", "e f", "2")], EAV_SCHEMA)
    wide = eav.wide_typed(rows, [Variable("a.b", STRING), Variable("c`d", STRING), Variable("e f", INTEGER)])
    assert [tuple(r) for r in wide.collect()] == [(1, "x", "y", 2)]


def test_rows_are_not_shuffled_by_field_name(spark, frame):
    """A few fields would leave a large export to as many tasks; listed values go to more partitions than there are fields."""
    rows = frame([("1", "a", "x"), ("1", "a", "y"), ("2", "a", None), ("2", "b", "z"), ("3", None, "w"), ("3", None, "v")], "record string, field_name string, value string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = eav.multi_agg(rows)
        assert found.rdd.getNumPartitions() >= 32
        assert {tuple(r) for r in found.collect()} == {("1", "a", "x, y"), ("2", "a", None)}
        for df in (found, eav.single_rows(rows)):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
