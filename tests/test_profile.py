"""Profiling the mortality schema: five tables whose result is known."""

import pytest
from pyspark.sql import functions as F

from studylake import types as VT
from studylake.operators import profile as prof

FLAVOURS = ["duckdb", "postgresql", "mysql", "mssql", "sqlite"]
COLUMNS = "flavour string, schema_name string, table_name string, ordinal int, column_name string, data_type string, is_nullable boolean, comment string"
CONSTRAINTS = (
    "flavour string, schema_name string, table_name string, kind string, columns array<string>, ref_table string, "
    "ref_columns array<string>, definition string"
)
TABLES = {
    "causes": [("code", "INTEGER", False, "Unique code for each cause"), ("label", "VARCHAR", False, None), ("description", "VARCHAR", True, None)],
    "cause_categories": [("cause_category", "INTEGER", False, None), ("label", "VARCHAR", False, None)],
    "sources": [("id", "INTEGER", False, "Unique identifier for each source"), ("name", "VARCHAR", False, None)],
    "sites": [("site_id", "INTEGER", False, None), ("source_id", "INTEGER", True, None)],
    "deaths": [("death_id", "INTEGER", False, None), ("site_id", "INTEGER", False, None), ("cause", "INTEGER", True, "The cause of the death"), ("cause_category", "INTEGER", True, None)],
}
KEYS = {"causes": "code", "cause_categories": "cause_category", "sources": "id", "sites": "site_id", "deaths": "death_id"}
LINKS = [("sites", "source_id", "sources", "id"), ("deaths", "site_id", "sites", "site_id"), ("deaths", "cause", "causes", "code")]
COUNTS = {"causes": 2, "cause_categories": 2, "sources": 2, "sites": 2, "deaths": 19}
ITEMS = [
    ("causes", 1, "Natural", "Died from natural causes"), ("causes", 2, "Unnatural", "Did not die from natural causes"),
    ("cause_categories", 1, "Medical", None), ("cause_categories", 2, "External", None), ("sources", 1, "Alpha", None), ("sources", 2, "Beta", None),
]


@pytest.fixture(scope="module")
def snapshots(spark):
    from studylake.session import local_rows

    columns = [
        (f, "main", t, i + 1, name, kind, nullable, comment)
        for f in FLAVOURS for t, cols in TABLES.items() for i, (name, kind, nullable, comment) in enumerate(cols)
    ]
    constraints = [(f, "main", t, "PRIMARY KEY", [k], None, None, None) for f in FLAVOURS for t, k in KEYS.items()]
    constraints += [(f, "main", t, "FOREIGN KEY", [c], r, [k], None) for f in FLAVOURS for t, c, r, k in LINKS]
    return {
        "columns": local_rows(spark, columns, COLUMNS),
        "constraints": local_rows(spark, constraints, CONSTRAINTS),
        "enums": local_rows(spark, [], "flavour string, type_name string, ord double, label string"),
        "row_counts": local_rows(spark, [(f, "main", t, n) for f in FLAVOURS for t, n in COUNTS.items()], "flavour string, schema_name string, table_name string, n bigint"),
        "code_items": local_rows(
            spark, [(f, "main", *item) for f in FLAVOURS for item in ITEMS],
            "flavour string, schema_name string, table_name string, value bigint, code string, description string",
        ),
    }


@pytest.fixture(scope="module")
def profiled(snapshots):
    rows = prof.profile_catalog(**snapshots).collect()
    assert len(rows) == len(FLAVOURS) * sum(len(c) for c in TABLES.values())
    return {(r.flavour, r.table_name, r.column_name): r for r in rows}


def items(row):
    return [tuple(i) for i in row["items"]]


@pytest.mark.parametrize("flavour", FLAVOURS)
def test_types_and_foreign_keys(profiled, flavour):
    assert profiled[flavour, "causes", "code"].value_type_id == VT.INTEGER
    assert profiled[flavour, "causes", "label"].value_type_id == VT.STRING
    cause = profiled[flavour, "deaths", "cause"]
    assert cause.value_type_id == VT.CATEGORY
    assert (cause.vocabulary_name, cause.vocabulary_description) == ("cause_codes", "Code table values from causes")
    assert items(cause) == [(1, "Natural", "Died from natural causes"), (2, "Unnatural", "Did not die from natural causes")]
    assert cause.description == (None if flavour == "sqlite" else "The cause of the death")
    # Sites have no text column, so a key to them stays a number.
    assert profiled[flavour, "deaths", "site_id"].value_type_id == VT.INTEGER
    assert items(profiled[flavour, "sites", "source_id"]) == [(1, "Alpha", None), (2, "Beta", None)]


@pytest.mark.parametrize("flavour", FLAVOURS)
def test_code_table_by_name_in_one_flavour(profiled, flavour):
    category = profiled[flavour, "deaths", "cause_category"]
    if flavour == "duckdb":
        assert category.value_type_id == VT.CATEGORY and category.vocabulary_name == "cause_category_codes"
        assert items(category) == [(1, "Medical", None), (2, "External", None)]
    else:
        assert category.value_type_id == VT.INTEGER and category["items"] is None


def test_code_columns(snapshots):
    chosen = {
        (r.table_name): (r.code_column, r.description_column)
        for r in prof.code_table_columns(snapshots["columns"].where("flavour = 'duckdb'"), prof.primary_keys(snapshots["constraints"])).collect()
    }
    assert chosen == {"causes": ("label", "description"), "cause_categories": ("label", None), "sources": ("name", None)}


@pytest.mark.parametrize(
    "flavour, definition, codes",
    [
        ("duckdb", "CHECK((status IN ('a', 'b')))", ["a", "b"]),
        ("postgresql", "CHECK (((status)::text = ANY ((ARRAY['a'::character varying, 'b c'::character varying])::text[])))", ["a", "b c"]),
        ("postgresql", "CHECK ((status = ANY (ARRAY['a'::text, 'b'::text])))", ["a", "b"]),
        ("postgresql", "CHECK ((((status)::text = 'p'::text) OR ((status)::text = 'q'::text)))", ["p", "q"]),
        ("mysql", "((`status` = 'p') or (`status` = 'q') or (`status` = 'p'))", ["p", "q"]),
        ("mssql", "([status]='p' OR [status]='q')", ["p", "q"]),
        ("sqlite", "CREATE TABLE t (id int, status text CHECK (status IN ('x','y')))", ["x", "y"]),
        ("sqlite", "CREATE TABLE t (status text CHECK (status = 'x'))", []),
        ("duckdb", "CHECK((other IN ('a')))", []),
        ("duckdb", "CHECK((status > 3))", []),
    ],
)
def test_check_items(frame, flavour, definition, codes):
    columns = frame([(flavour, "main", "t", 1, "Status", "text", True, None)], COLUMNS)
    constraints = frame([(flavour, "main", "t", "CHECK", None, None, None, definition)], CONSTRAINTS)
    found = prof.check_items(columns, constraints).orderBy("value").collect()
    assert [(r.value, r.code) for r in found] == [(i + 1, c) for i, c in enumerate(codes)]


def test_multi_column_foreign_key(frame):
    constraints = frame([("duckdb", "main", "t", "FOREIGN KEY", ["a", "b"], "r", ["x", "y"], None)], CONSTRAINTS)
    found = sorted((r.column_name, r.ref_column) for r in prof.foreign_keys(constraints).collect())
    assert found == [("a", "x"), ("b", "y")]


@pytest.mark.parametrize(
    "sql, table",
    [
        ("SELECT * FROM deaths d", "deaths"), ("select 1 from [deaths];", "deaths"), ('SELECT a\nFROM "deaths"', "deaths"),
        ("SELECT * FROM main.deaths", None), ("SELECT 1", None), ("select * from a, b", "a"),
    ],
)
def test_query_source_table(frame, sql, table):
    assert prof.query_source_table(frame([(sql,)], "sql string")).first().source_table == table


def test_profile_query(spark):
    spark.range(4).select("id", F.when(F.col("id") > 1, F.lit("x")).alias("t"), F.lit(1.5).cast("decimal(5,2)").alias("d")).createOrReplaceTempView("four")
    found = [tuple(r) for r in prof.profile_query(spark, "SELECT * FROM four").collect()]
    assert found == [(1, "id", VT.INTEGER, False, 4, 0), (2, "t", VT.STRING, True, 4, 2), (3, "d", VT.FLOAT, True, 4, 0)]


def test_measured_code_tables(spark, frame):
    tables = {
        "codes": frame([(1, "a", "A"), (2, "b", "B")], "id int, short string, label string"),
        "big": spark.range(250).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("t")),
        "facts": frame([(1, 1), (2, 2), (None, 2)], "code int, other bigint"),
        "repeated": frame([(1, "a"), (1, "b")], "id int, t string"),
    }
    code = prof.small_keyed_tables(tables)
    assert {(r.table_name, r.column_name, r.n) for r in code.collect()} == {("codes", "id", 2)}
    found = {(r.table_name, r.column_name, r.ref_table) for r in prof.inclusion_keys(tables, code).collect()}
    assert found == {("facts", "code", "codes"), ("facts", "other", "codes"), ("repeated", "id", "codes")}
    rows = [(r.value, r.code, r.description) for r in prof.code_table_items(tables, code).orderBy("value").collect()]
    assert rows == [(1, "a", "A"), (2, "b", "B")]


def test_reference_into_one_of_two_schemas(frame):
    columns = frame(
        [("postgresql", s, "sexes", 1, "id", "integer", False, None) for s in "ab"]
        + [("postgresql", s, "sexes", 2, "name", "text", False, None) for s in "ab"]
        + [("postgresql", "b", "people", 1, "sex", "integer", True, None)], COLUMNS,
    )
    keys = [("postgresql", s, "sexes", "PRIMARY KEY", ["id"], None, None, None, None) for s in "ab"]
    link = [("postgresql", "b", "people", "FOREIGN KEY", ["sex"], "b", "sexes", ["id"], None)]
    constraints = frame(keys + link, CONSTRAINTS.replace("ref_table", "ref_schema string, ref_table"))
    counts = frame([("postgresql", s, "sexes", 1) for s in "ab"], "flavour string, schema_name string, table_name string, n bigint")
    code_items = frame(
        [("postgresql", s, "sexes", 1, f"of {s}", None) for s in "ab"],
        "flavour string, schema_name string, table_name string, value bigint, code string, description string",
    )
    enums = frame([], "flavour string, type_name string, ord double, label string")
    found = prof.profile_catalog(columns, constraints, enums, counts, code_items).where("column_name = 'sex'").first()
    assert found.value_type_id == VT.CATEGORY and [i.code for i in found["items"]] == ["of b"]
    old = prof.profile_catalog(columns, constraints.drop("ref_schema"), enums, counts, code_items).where("column_name = 'sex'").first()
    assert [i.code for i in old["items"]] == ["of a"]


def test_code_columns_go_by_the_base_type(frame):
    columns = frame(
        [("mysql", "m", "t", 1, "id", "int(11)", False, None, "int"), ("mysql", "m", "t", 2, "flag", "tinyint(1)", True, None, "tinyint"),
         ("mysql", "m", "t", 3, "size", "int unsigned", True, None, "int"), ("mysql", "m", "t", 4, "label", "varchar(20)", True, None, "varchar")],
        COLUMNS + ", base_type string",
    )
    keys = frame([("mysql", "m", "t", "id", 1)], "flavour string, schema_name string, table_name string, column_name string, key_width int")
    assert prof.code_table_columns(columns, keys).first().code_column == "label"
