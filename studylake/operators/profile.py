"""Schema profiling over catalog snapshots: all columns of all tables at once.

Snapshots (one row per thing, any number of source databases side by side):

- `columns(flavour, schema_name, table_name, ordinal, column_name, data_type, is_nullable, comment)`, optionally with
  `base_type` where `data_type` is the full declaration (MySQL: `tinyint(1)`, `enum(…)`)
- `constraints(flavour, schema_name, table_name, kind, columns[], ref_table, ref_columns[], definition)`, kind one of
  `PRIMARY KEY`, `FOREIGN KEY`, `CHECK`; optionally with `ref_schema`, without which a reference means the first schema
  by name that has such a code table
- `enums(flavour, type_name, ord, label)`
- `row_counts(flavour, schema_name, table_name, n)`
- `code_items(flavour, schema_name, table_name, value, code, description)`, the rows of small keyed tables
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake import types as VT
from studylake.functions.sqltypes import ENUM_BY_NAME, map_type_by_flavour
from studylake.operators.discovery import columns_of, inclusion_dependencies, stacked, within_range
from studylake.session import local_rows, materialize
from studylake.types import value_type_of

TABLE = ["flavour", "schema_name", "table_name"]
COLUMN = [*TABLE, "column_name"]

# Size limit of a code table, names that mark a description column, schemas searched by key name.
CODE_TABLE_ROWS = 250
DESCRIPTION_NAMES = ["description", "desc", "label", "name", "text"]
CODE_SCHEMAS = ["codes", "main"]
DEFAULT_SCHEMA = {"postgresql": "public", "mssql": "dbo"}


# --- queries --------------------------------------------------------------------------------------------------

def profile_query(spark: SparkSession, sql: str) -> DataFrame:
    """One row per column of a SELECT, with row and NULL counts from one pass over its result."""
    return profile_frame(spark.sql(sql))


def profile_frame(df: DataFrame) -> DataFrame:
    """`ordinal, name, value_type_id, is_nullable, n_rows, n_null` of a frame's columns."""
    fields = df.schema.fields
    measured = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("name"),
                F.lit(value_type_of(f.dataType)).alias("value_type_id"), F.lit(f.nullable).alias("is_nullable"),
                F.col("n_rows"), (F.col("n_rows") - F.col(f"c{i}")).alias("n_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return measured.select(F.inline(rows))


def declared_variables(df: DataFrame) -> list[tuple[str, int, str | None]]:
    """`(name, value_type_id, comment)` of a frame, from its schema alone: no job runs."""
    return [(f.name, value_type_of(f.dataType), f.metadata.get("comment")) for f in df.schema.fields]


def query_source_table(queries: DataFrame, sql: str = "sql", out: str = "source_table") -> DataFrame:
    """First table after FROM in each query text; NULL for qualified names and anything else that does not match.

    What follows the first FROM is cut at the next blank, comma or semicolon; it is a table if it is one word, or one
    word between quotes.
    """
    after = F.ltrim(F.regexp_replace(F.regexp_extract(F.col(sql), r"(?is)\bfrom(\s.*)", 1), r"\s", " "))
    named = F.substring_index(F.translate(after, ",;", "  "), " ", 1)
    quoted = F.translate(named, "\"'`[]", "")
    closed = F.length(named) - F.length(quoted)
    return queries.withColumn(out, F.when(F.rlike(quoted, F.lit(r"^[\p{L}\p{N}_]+$")) & (closed <= 2), quoted))


# --- columns --------------------------------------------------------------------------------------------------

def map_types(columns: DataFrame, flavour: Column | None = None) -> DataFrame:
    """Columns with the `value_type_id` of their declared type."""
    by = F.col("flavour") if flavour is None else flavour
    return columns.withColumn("value_type_id", map_type_by_flavour(F.col("data_type"), by))


def column_comments(wanted: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns with their comment as `description`.

    A missing schema means the flavour's default one; empty MySQL comments do not count; SQLite has none.
    """
    default = F
    for flavour, schema in DEFAULT_SCHEMA.items():
        default = default.when(F.col("flavour") == flavour, schema)
    usable = columns.where(
        F.col("comment").isNotNull() & (F.col("flavour") != "sqlite")
        & ~((F.col("flavour") == "mysql") & (F.col("comment") == ""))
    ).select(*COLUMN, F.col("comment").alias("description"))
    filled = wanted.withColumn("schema_name", F.coalesce("schema_name", default.otherwise("main")))
    return filled.join(usable, COLUMN, "left")


def original_types(results: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared type of the source column where there is one, else the type the query reported."""
    declared = columns.select(*COLUMN, F.col("data_type").alias("declared_type"))
    return results.join(declared, COLUMN, "left").withColumn(
        "data_type", F.coalesce("declared_type", "data_type")
    ).drop("declared_type")


def list_table_columns(columns: DataFrame, table_name: str | None = None) -> DataFrame:
    """Columns in table order with nullability."""
    rows = columns if table_name is None else columns.where(F.col("table_name") == table_name)
    return rows.select(*TABLE, "ordinal", "column_name", "data_type", "is_nullable").orderBy(*TABLE, "ordinal")


# --- keys -----------------------------------------------------------------------------------------------------

def foreign_keys(constraints: DataFrame) -> DataFrame:
    """Referenced table and column of every foreign key column, multi-column keys matched by position."""
    return _references(constraints).drop("ref_schema")


def _references(constraints: DataFrame) -> DataFrame:
    """`foreign_keys` with `ref_schema`, NULL where the snapshot does not say."""
    pairs = F.explode(F.arrays_zip("columns", "ref_columns"))
    schema = F.col("ref_schema") if "ref_schema" in constraints.columns else F.lit(None).cast("string").alias("ref_schema")
    return (
        constraints.where(F.col("kind") == "FOREIGN KEY").select(*TABLE, schema, "ref_table", pairs.alias("pair"))
        .select(
            *TABLE, F.col("pair.columns").alias("column_name"), "ref_schema", "ref_table",
            F.col("pair.ref_columns").alias("ref_column"),
        )
        .where("column_name IS NOT NULL AND ref_column IS NOT NULL")
    )


def primary_keys(constraints: DataFrame) -> DataFrame:
    """Columns that are part of a primary key, with the width of the key."""
    return constraints.where(F.col("kind") == "PRIMARY KEY").select(
        *TABLE, F.explode("columns").alias("column_name"), F.size("columns").alias("key_width")
    ).distinct()


def code_tables(keys: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Key columns of tables below the size limit of a code table."""
    return keys.join(row_counts.where(F.col("n") < CODE_TABLE_ROWS), TABLE).select(*COLUMN, "key_width", "n")


def small_keyed_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The same decision from data: `table_name, column_name, n` of tables without declared keys.

    A column counts as key when it is an integer and every row has its own value. A table shows as many rows as make it too large to
    be a code table; those rows of all tables are counted in one grouping.
    """
    parts = []
    for name, df in tables.items():
        whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
        if whole:
            cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("bigint").alias("value")) for c in whole]
            shown = df.select(*(f"`{c}`" for c in whole)).limit(CODE_TABLE_ROWS)
            parts.append(shown.select(F.lit(name).alias("table_name"), F.inline(F.array(*cells))))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return local_rows(spark, [], "table_name string, column_name string, n bigint")
    counted = stacked(parts, "small-tables").groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values")
    )
    return counted.where((F.col("n") < CODE_TABLE_ROWS) & (F.col("n") == F.col("values"))).select("table_name", "column_name", "n")


def code_table_columns(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Code and description column of each keyed table: `..., key_column, code_column, description_column`.

    The code is the first text column besides the key. The description is the last text column with a telling
    name, unless that is the code; then it is the next text column.
    """
    typed = columns
    if "base_type" in columns.columns:
        typed = columns.withColumn("data_type", F.coalesce("base_type", "data_type"))
    typed = map_types(typed)
    texts = (
        typed.where(F.col("value_type_id") == VT.STRING)
        .join(keys.select(*TABLE, F.col("column_name").alias("key_column")), TABLE)
        .where("column_name <> key_column")
    )
    group = [*TABLE, "key_column"]
    telling = F.lower("column_name").isin(DESCRIPTION_NAMES)
    chosen = texts.groupBy(*group).agg(
        F.min_by("column_name", "ordinal").alias("code_column"),
        F.min("ordinal").alias("code_ordinal"),
        F.max_by("column_name", F.when(telling, F.col("ordinal"))).alias("named"),
    )
    later = texts.join(chosen.select(*group, "code_ordinal"), group).where("ordinal > code_ordinal")
    second = later.groupBy(*group).agg(F.min_by("column_name", "ordinal").alias("next_text"))
    named = F.when(F.col("named") != F.col("code_column"), F.col("named"))
    return chosen.join(second, group, "left").select(
        *group, "code_column", F.coalesce(named, F.col("next_text")).alias("description_column")
    )


def code_table_by_name(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Code table per column found by name alone: a one-column key of the same name in another table.

    Schema `codes` comes before `main`, then table name. Only DuckDB sources are searched this way.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in CODE_SCHEMAS]), F.lower("schema_name")).cast("int")
    keys = primary_keys(constraints).where(
        (F.col("flavour") == "duckdb") & (F.col("key_width") == 1) & (rank > 0)
    ).select(
        F.lower("column_name").alias("_key"), rank.alias("_rank"),
        F.col("schema_name").alias("ref_schema"), F.col("table_name").alias("ref_table"),
        F.col("column_name").alias("ref_column"),
    )
    wanted = columns.where(F.col("flavour") == "duckdb").select(*COLUMN, F.lower("column_name").alias("_key"))
    # The best table and the best one in another place suffice: the source itself is at most one of them.
    best = keys.groupBy("_key").agg(_first_table().alias("_best"))
    runner_up = (
        keys.join(best, "_key").where(~_same_table("ref_schema", "ref_table", "_best.ref_schema", "_best.ref_table"))
        .groupBy("_key").agg(_first_table().alias("_next"))
    )
    itself = _same_table("schema_name", "table_name", "_best.ref_schema", "_best.ref_table")
    found = wanted.join(best, "_key").join(runner_up, "_key", "left").withColumn(
        "_ref", F.when(itself, F.col("_next")).otherwise(F.col("_best"))
    )
    return found.where("_ref IS NOT NULL").select(*COLUMN, "_ref.ref_schema", "_ref.ref_table", "_ref.ref_column")


def _first_table() -> Column:
    return F.min_by(F.struct("ref_schema", "ref_table", "ref_column"), F.struct("_rank", "ref_table"))


def _same_table(schema: str, table: str, other_schema: str, other_table: str) -> Column:
    return (F.lower(schema) == F.lower(other_schema)) & (F.lower(table) == F.lower(other_table))


def inclusion_keys(tables: Mapping[str, DataFrame], code: DataFrame) -> DataFrame:
    """Integer columns whose every value is a key of a code table of another name, for tables without declared keys.

    `code` is the result of `small_keyed_tables`. Columns with a value outside the range of all keys are left out first, by their
    bounds; the others are compared with all code tables at once (`discovery.inclusion_dependencies`).
    """
    code = materialize(code.select("table_name", "column_name"), "code-tables")
    named = {tuple(row) for row in code.collect()}
    columns = columns_of(tables, ["integer"])
    keys = [c for c in columns if (c.table_name, c.column_name) in named]
    if not keys:
        return local_rows(code.sparkSession, [], "table_name string, column_name string, ref_table string, ref_column string")
    bounds = stacked(
        [tables[c.table_name].agg(F.min(f"`{c.column_name}`").cast("bigint").alias("low"), F.max(f"`{c.column_name}`").cast("bigint").alias("high")) for c in keys],
        "key-bounds",
    ).agg(F.min("low"), F.max("high")).first()
    found = inclusion_dependencies(tables, within_range(tables, columns, *bounds))
    refs = code.select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    return found.join(refs, ["ref_table", "ref_column"], "left_semi").where("table_name <> ref_table").select(
        "table_name", "column_name", "ref_table", "ref_column"
    )


def describe_code_table(df: DataFrame, key: str) -> tuple[str, str | None] | None:
    """Code and description column of one table by the same rule, None without a text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    if not texts:
        return None
    named = [name for name in texts if name.lower() in DESCRIPTION_NAMES]
    if named and named[-1] != texts[0]:
        return texts[0], named[-1]
    return texts[0], texts[1] if len(texts) > 1 else None


def code_table_items(tables: Mapping[str, DataFrame], code: DataFrame) -> DataFrame:
    """Items of the code tables found by `small_keyed_tables`: `table_name, column_name, value, code, description`."""
    spark = code.sparkSession
    parts = []
    for row in code.collect():
        chosen = describe_code_table(tables[row.table_name], row.column_name)
        if chosen is not None:
            label, description = chosen
            parts.append(
                tables[row.table_name].select(
                    F.lit(row.table_name).alias("table_name"), F.lit(row.column_name).alias("column_name"),
                    F.col(row.column_name).cast("bigint").alias("value"), F.col(label).alias("code"),
                    (F.col(description) if description else F.lit(None).cast("string")).alias("description"),
                )
            )
    if not parts:
        return local_rows(
            spark, [], "table_name string, column_name string, value bigint, code string, description string"
        )
    return stacked(parts, "code-items")


# --- enums and checks -----------------------------------------------------------------------------------------

def enum_items(columns: DataFrame, enums: DataFrame) -> DataFrame:
    """Items of every enum column: `flavour, data_type, value, code`, numbered from 1 in declaration order.

    MySQL and DuckDB spell the labels in the column type; others list them in their catalog. The labels of one type
    are one declaration, so numbering them in one window is bounded.
    """
    spelled = columns.where(F.col("flavour").isin(*ENUM_BY_NAME) & F.startswith(F.lower("data_type"), F.lit("enum")))
    labels = F.regexp_extract_all(F.regexp_extract("data_type", r"(?i)enum\s*\((.*)\)", 1), F.lit("'([^']*)'"), 1)
    parsed = spelled.select("flavour", "data_type").distinct().select(
        "flavour", "data_type", F.posexplode(labels).alias("pos", "code")
    ).select("flavour", "data_type", (F.col("pos") + 1).cast("bigint").alias("value"), "code")
    order = Window.partitionBy("flavour", "type_name").orderBy("ord", "label")
    listed = enums.select(
        "flavour", F.col("type_name").alias("data_type"),
        F.row_number().over(order).cast("bigint").alias("value"), F.col("label").alias("code"),
    )
    return parsed.unionByName(listed)


# The shapes of CHECK texts that list values. The first group is the column, the second its values.
# Postgres prints casts and extra parentheses around both, which the shapes allow for.
_CHECKED = r'(\w+)["`\]]?\)*(?:::[a-z ]+(?:\(\d+\))?)?\)*\s*'
VALUE_LIST = rf"(?i){_CHECKED}(?:=\s*ANY\s*\(+\s*ARRAY\[|\bIN\s*\()([^)\]]+)[)\]]"
VALUE_EQUALS = rf"(?i){_CHECKED}=\s*'([^']*)'"
SQLITE_LIST = r"(?i)CHECK\s*\(\s*(\w+)\s+IN\s*\(([^)]+)\)"
QUOTED = "'([^']*)'"


def _matches(text: Column, pattern: str) -> Column:
    """All matches of a two-group pattern as array of (name, value)."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda m: F.struct(
            F.lower(F.regexp_extract(m, pattern, 1)).alias("name"), F.regexp_extract(m, pattern, 2).alias("value")
        ),
    )


def check_items(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Allowed values a CHECK constraint lists for a column: `..., column_name, value, code`, numbered from 1.

    Understood are `col IN ('a', 'b')`, `col = ANY (ARRAY['a', 'b'])` and `col = 'a' OR col = 'b'`, in that order
    of preference; SQLite only knows the first, inside `CHECK (…)`. Column names are read out of each text and
    then joined, so no text is tried against every column of its table.
    """
    text, lite = F.col("definition"), F.col("flavour") == "sqlite"
    none = F.array().cast("array<struct<name:string,value:string>>")
    read = constraints.where(F.col("kind") == "CHECK").select(*TABLE, "definition").distinct().select(
        *TABLE,
        F.when(lite, _matches(text, SQLITE_LIST)).otherwise(_matches(text, VALUE_LIST)).alias("_lists"),
        F.when(lite, none).otherwise(_matches(text, VALUE_EQUALS)).alias("_equals"),
    )
    named = read.withColumn(
        "_name", F.explode(F.array_distinct(F.transform(F.concat("_lists", "_equals"), lambda m: m["name"])))
    )
    listed = F.get(F.filter("_lists", lambda m: m["name"] == F.col("_name")), F.lit(0))["value"]
    equalled = F.transform(F.filter("_equals", lambda m: m["name"] == F.col("_name")), lambda m: m["value"])
    codes = F.when(listed.isNotNull(), F.regexp_extract_all(listed, F.lit(QUOTED), 1)).otherwise(
        F.array_distinct(equalled)
    )
    items = named.select(*TABLE, "_name", F.posexplode(codes).alias("pos", "code"))
    wanted = columns.select(*COLUMN, F.lower("column_name").alias("_name"))
    return wanted.join(items, [*TABLE, "_name"]).select(
        *COLUMN, (F.col("pos") + 1).cast("bigint").alias("value"), "code"
    )


# --- everything together --------------------------------------------------------------------------------------

def _item_lists(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items nested per key. Lists come from enums, CHECK texts and tables below 250 rows, so they are short."""
    description = F.col("description") if "description" in items.columns else F.lit(None).cast("string")
    item = F.struct(F.col("value").cast("bigint").alias("value"), F.col("code"), description.alias("description"))
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))


def profile_catalog(
    columns: DataFrame, constraints: DataFrame, enums: DataFrame, row_counts: DataFrame, code_items: DataFrame
) -> DataFrame:
    """Variable and vocabulary of every column.

    In order of precedence: an enum is a category; an integer whose foreign key leads to a code table is one; so
    is an integer named like the key of a code table; so is a text column with listed CHECK values. Anything else
    keeps the type its declaration maps to. Output: the column, `value_type_id, description, vocabulary_name,
    vocabulary_description, items`.

    Each snapshot is read once: columns with their types, constraints and the sizes of small tables are written to the shared scratch
    folder, for every kind of vocabulary looks at them again.
    """
    constraints = materialize(constraints, "constraints")
    row_counts = materialize(row_counts.where(F.col("n") < CODE_TABLE_ROWS), "small-tables")
    columns = materialize(columns, "columns")
    typed = map_types(columns)
    typed = typed.withColumn(
        "description",
        F.when(F.col("flavour") == "sqlite", None)
        .when((F.col("flavour") == "mysql") & (F.col("comment") == ""), None).otherwise(F.col("comment")),
    ).select(*COLUMN, "ordinal", "data_type", "value_type_id", "description")

    enum_lists = _item_lists(enum_items(columns, enums), ["flavour", "data_type"]).withColumnRenamed("items", "enum_items")

    # Code tables by (flavour, table, key); their items are bounded by the size limit.
    small = code_tables(primary_keys(constraints), row_counts)
    lists = _item_lists(code_items.join(row_counts, TABLE, "left_semi"), TABLE)
    with_items = materialize(
        small.join(lists, TABLE).select(
            "flavour", F.col("schema_name").alias("ref_schema"), F.col("table_name").alias("ref_table"),
            F.lower("column_name").alias("_ref"), "items",
        ),
        "code-lists",
    )
    by_table = with_items.groupBy("flavour", "ref_table", "_ref").agg(F.min_by("items", "ref_schema").alias("fk_items"))
    first_key = _references(constraints).groupBy(*COLUMN).agg(
        F.min(F.struct("ref_table", "ref_column", "ref_schema")).alias("_fk")
    ).select(
        *TABLE, F.lower("column_name").alias("_col"), F.col("_fk.ref_schema").alias("ref_schema"),
        F.col("_fk.ref_table").alias("ref_table"), F.lower("_fk.ref_column").alias("_ref"),
    )
    # The table of the schema that is named, or of the first schema that has one.
    any_schema = by_table.select("flavour", F.lit(None).cast("string").alias("ref_schema"), "ref_table", "_ref", "fk_items")
    one_schema = with_items.select("flavour", "ref_schema", "ref_table", "_ref", F.col("items").alias("fk_items"))
    known = any_schema.unionByName(one_schema).withColumnRenamed("ref_schema", "_schema")
    referenced = (
        first_key.join(known, ["flavour", "ref_table", "_ref"]).where(F.col("ref_schema").eqNullSafe(F.col("_schema")))
        .select(*TABLE, "_col", F.col("ref_table").alias("fk_table"), "fk_items")
    )
    integers = typed.where(F.col("value_type_id") == VT.INTEGER)
    named = code_table_by_name(integers, constraints).select(
        *COLUMN, "ref_schema", "ref_table", F.lower("ref_column").alias("_ref")
    ).join(with_items, ["flavour", "ref_schema", "ref_table", "_ref"]).select(
        *COLUMN,
        F.when(F.lower("ref_schema") == "codes", F.concat_ws(".", "ref_schema", "ref_table"))
        .otherwise(F.col("ref_table")).alias("named_table"),
        F.col("items").alias("named_items"),
    )
    allowed = _item_lists(
        check_items(typed.where(F.col("value_type_id") == VT.STRING), constraints), COLUMN
    ).withColumnRenamed("items", "check_items")

    enum_names = enums.select("flavour", F.col("type_name").alias("data_type"), F.lit(True).alias("_enum")).distinct()
    joined = (
        typed.withColumn("_col", F.lower("column_name"))
        .join(enum_lists, ["flavour", "data_type"], "left").join(enum_names, ["flavour", "data_type"], "left")
        .join(referenced, [*TABLE, "_col"], "left")
        .join(named, COLUMN, "left").join(allowed, COLUMN, "left")
    )
    kind, column = F.col("value_type_id"), F.col("column_name")
    is_enum = F.col("_enum").isNotNull() | (kind == VT.CATEGORY)
    by_key = ~is_enum & (kind == VT.INTEGER) & F.col("fk_items").isNotNull()
    by_name = ~is_enum & (kind == VT.INTEGER) & F.col("named_items").isNotNull()
    by_check = ~is_enum & (kind == VT.STRING) & F.col("check_items").isNotNull()

    def pick(enum: Column, key: Column, name: Column, check: Column) -> Column:
        return F.when(is_enum, enum).when(by_key, key).when(by_name, name).when(by_check, check)

    items = pick(F.col("enum_items"), F.col("fk_items"), F.col("named_items"), F.col("check_items"))
    has_items = items.isNotNull()
    return joined.select(
        *COLUMN, "ordinal",
        F.when(is_enum | by_key | by_name | by_check, VT.CATEGORY).otherwise(kind).alias("value_type_id"),
        "description",
        F.when(has_items, F.concat(column, pick(F.lit("_enum"), F.lit("_codes"), F.lit("_codes"), F.lit("_allowed"))))
        .alias("vocabulary_name"),
        F.when(
            has_items,
            pick(
                F.concat(F.lit("Enum values for "), column),
                F.concat(F.lit("Code table values from "), F.col("fk_table")),
                F.concat(F.lit("Code table values from "), F.col("named_table")),
                F.concat(F.lit("Allowed values for "), column),
            ),
        ).alias("vocabulary_description"),
        items.alias("items"),
    )


def snapshot(tables: Mapping[str, DataFrame], flavour: str = "spark", schema: str = "main") -> DataFrame:
    """`columns` snapshot of frames whose schema Spark already knows; comments come from field metadata."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (flavour, schema, name, i + 1, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return local_rows(
        spark, rows,
        "flavour string, schema_name string, table_name string, ordinal int, column_name string, "
        "data_type string, is_nullable boolean, comment string",
    )
