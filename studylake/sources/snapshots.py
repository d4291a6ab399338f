"""Catalog snapshots of source databases: their own catalogs read into the frames `operators.profile` works on.

`read` runs one SELECT on the source and returns a DataFrame, for instance
`lambda sql: read_query(spark, sql, jdbc=options)`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.operators import profile as prof
from studylake.session import local_rows

Read = Callable[[str], DataFrame]

# Lists of column names travel as one text, separated by the character made for it.
SEPARATOR = "\x1f"

COLUMN_QUERIES = {
    "postgresql": """
        SELECT c.table_schema AS schema_name, c.table_name, c.ordinal_position AS ordinal, c.column_name,
               CASE WHEN t.typtype = 'e' THEN t.typname ELSE c.data_type END AS data_type, c.is_nullable = 'YES' AS is_nullable,
               col_description(format('%I.%I', c.table_schema, c.table_name)::regclass, c.ordinal_position) AS comment
        FROM information_schema.columns c
        LEFT JOIN pg_namespace n ON n.nspname = c.udt_schema
        LEFT JOIN pg_type t ON t.typname = c.udt_name AND t.typnamespace = n.oid
        WHERE c.table_schema NOT IN ('pg_catalog', 'information_schema')""",
    "mysql": """
        SELECT table_schema AS schema_name, table_name AS table_name, ordinal_position AS ordinal, column_name AS column_name,
               column_type AS data_type, is_nullable = 'YES' AS is_nullable, column_comment AS comment, data_type AS base_type
        FROM information_schema.columns WHERE table_schema = DATABASE()""",
    "mssql": """
        SELECT c.TABLE_SCHEMA AS schema_name, c.TABLE_NAME AS table_name, c.ORDINAL_POSITION AS ordinal, c.COLUMN_NAME AS column_name,
               c.DATA_TYPE AS data_type, CASE c.IS_NULLABLE WHEN 'YES' THEN 1 ELSE 0 END AS is_nullable,
               CAST(p.value AS VARCHAR(MAX)) AS comment
        FROM INFORMATION_SCHEMA.COLUMNS c
        LEFT JOIN sys.columns s ON s.object_id = OBJECT_ID(QUOTENAME(c.TABLE_SCHEMA) + '.' + QUOTENAME(c.TABLE_NAME)) AND s.name = c.COLUMN_NAME
        LEFT JOIN sys.extended_properties p ON p.major_id = s.object_id AND p.minor_id = s.column_id AND p.name = 'MS_Description'""",
    "duckdb": """
        SELECT schema_name, table_name, column_index AS ordinal, column_name, data_type, is_nullable, comment
        FROM duckdb_columns() WHERE NOT internal""",
    "sqlite": """
        SELECT 'main' AS schema_name, m.name AS table_name, p.cid + 1 AS ordinal, p.name AS column_name, p.type AS data_type,
               p."notnull" = 0 AS is_nullable, NULL AS comment
        FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table' AND m.name NOT LIKE 'sqlite_%'""",
}

CONSTRAINT_QUERIES = {
    "postgresql": """
        SELECT n.nspname AS schema_name, t.relname AS table_name,
               CASE c.contype WHEN 'p' THEN 'PRIMARY KEY' WHEN 'f' THEN 'FOREIGN KEY' ELSE 'CHECK' END AS kind,
               (SELECT string_agg(a.attname, chr(31) ORDER BY k.i) FROM unnest(c.conkey) WITH ORDINALITY k(num, i)
                JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.num) AS columns,
               rn.nspname AS ref_schema, r.relname AS ref_table,
               (SELECT string_agg(a.attname, chr(31) ORDER BY k.i) FROM unnest(c.confkey) WITH ORDINALITY k(num, i)
                JOIN pg_attribute a ON a.attrelid = c.confrelid AND a.attnum = k.num) AS ref_columns,
               CASE c.contype WHEN 'c' THEN pg_get_constraintdef(c.oid) END AS definition
        FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace
        LEFT JOIN pg_class r ON r.oid = c.confrelid LEFT JOIN pg_namespace rn ON rn.oid = r.relnamespace WHERE c.contype IN ('p', 'f', 'c')""",
    "mysql": """
        SELECT k.table_schema AS schema_name, k.table_name AS table_name, MAX(t.constraint_type) AS kind,
               GROUP_CONCAT(k.column_name ORDER BY k.ordinal_position SEPARATOR '\x1f') AS columns,
               MAX(k.referenced_table_schema) AS ref_schema, MAX(k.referenced_table_name) AS ref_table,
               GROUP_CONCAT(k.referenced_column_name ORDER BY k.ordinal_position SEPARATOR '\x1f') AS ref_columns, NULL AS definition
        FROM information_schema.key_column_usage k JOIN information_schema.table_constraints t
          ON t.constraint_schema = k.constraint_schema AND t.table_name = k.table_name AND t.constraint_name = k.constraint_name
        WHERE k.table_schema = DATABASE() AND t.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')
        GROUP BY k.table_schema, k.table_name, k.constraint_name
        UNION ALL
        SELECT t.table_schema, t.table_name, 'CHECK', NULL, NULL, NULL, NULL, c.check_clause
        FROM information_schema.check_constraints c JOIN information_schema.table_constraints t
          ON t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name
        WHERE t.table_schema = DATABASE()""",
    "mssql": """
        SELECT SCHEMA_NAME(t.schema_id) AS schema_name, t.name AS table_name, 'PRIMARY KEY' AS kind,
               STRING_AGG(c.name, CHAR(31)) WITHIN GROUP (ORDER BY x.key_ordinal) AS columns,
               CAST(NULL AS SYSNAME) AS ref_schema, CAST(NULL AS SYSNAME) AS ref_table, CAST(NULL AS NVARCHAR(MAX)) AS ref_columns, CAST(NULL AS NVARCHAR(MAX)) AS definition
        FROM sys.tables t JOIN sys.indexes i ON i.object_id = t.object_id AND i.is_primary_key = 1
        JOIN sys.index_columns x ON x.object_id = i.object_id AND x.index_id = i.index_id
        JOIN sys.columns c ON c.object_id = x.object_id AND c.column_id = x.column_id GROUP BY t.schema_id, t.name
        UNION ALL
        SELECT SCHEMA_NAME(t.schema_id), t.name, 'FOREIGN KEY', STRING_AGG(c.name, CHAR(31)) WITHIN GROUP (ORDER BY f.constraint_column_id),
               SCHEMA_NAME(r.schema_id), r.name, STRING_AGG(d.name, CHAR(31)) WITHIN GROUP (ORDER BY f.constraint_column_id), NULL
        FROM sys.foreign_key_columns f JOIN sys.tables t ON t.object_id = f.parent_object_id JOIN sys.tables r ON r.object_id = f.referenced_object_id
        JOIN sys.columns c ON c.object_id = f.parent_object_id AND c.column_id = f.parent_column_id
        JOIN sys.columns d ON d.object_id = f.referenced_object_id AND d.column_id = f.referenced_column_id
        GROUP BY t.schema_id, t.name, f.constraint_object_id, r.schema_id, r.name
        UNION ALL
        SELECT SCHEMA_NAME(t.schema_id), t.name, 'CHECK', NULL, NULL, NULL, NULL, k.definition
        FROM sys.check_constraints k JOIN sys.tables t ON t.object_id = k.parent_object_id""",
    "duckdb": """
        SELECT schema_name, table_name, constraint_type AS kind, array_to_string(constraint_column_names, chr(31)) AS columns,
               CASE constraint_type WHEN 'FOREIGN KEY' THEN schema_name END AS ref_schema, referenced_table AS ref_table,
               array_to_string(referenced_column_names, chr(31)) AS ref_columns, constraint_text AS definition
        FROM duckdb_constraints() WHERE constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY', 'CHECK')""",
    "sqlite": """
        SELECT 'main' AS schema_name, table_name, 'PRIMARY KEY' AS kind, group_concat(name, char(31)) AS columns, NULL AS ref_schema, NULL AS ref_table,
               NULL AS ref_columns, NULL AS definition
        FROM (SELECT m.name AS table_name, p.name FROM sqlite_master m JOIN pragma_table_info(m.name) p
              WHERE m.type = 'table' AND p.pk > 0 ORDER BY m.name, p.pk) GROUP BY table_name
        UNION ALL
        SELECT 'main', table_name, 'FOREIGN KEY', group_concat(own, char(31)), 'main', ref_table, group_concat(other, char(31)), NULL
        FROM (SELECT m.name AS table_name, f.id, f."from" AS own, f."table" AS ref_table, f."to" AS other
              FROM sqlite_master m JOIN pragma_foreign_key_list(m.name) f WHERE m.type = 'table' ORDER BY m.name, f.id, f.seq)
        GROUP BY table_name, id, ref_table
        UNION ALL
        SELECT 'main', name, 'CHECK', NULL, NULL, NULL, NULL, sql FROM sqlite_master WHERE type = 'table'""",
}

ENUM_QUERIES = {
    "postgresql": """
        SELECT t.typname AS type_name, e.enumsortorder AS ord, e.enumlabel AS label FROM pg_enum e JOIN pg_type t ON t.oid = e.enumtypid""",
}

QUOTES = {"mssql": ("[", "]"), "mysql": ("`", "`")}


def quoted(flavour: str, name: str) -> str:
    """Identifier as the flavour quotes it."""
    opening, closing = QUOTES.get(flavour, ('"', '"'))
    return opening + name.replace(closing, closing * 2) + closing


def read_columns(read: Read, flavour: str) -> DataFrame:
    rows = read(COLUMN_QUERIES[flavour])
    base = F.col("base_type") if "base_type" in rows.columns else F.lit(None)
    return rows.select(
        F.lit(flavour).alias("flavour"), "schema_name", "table_name", F.col("ordinal").cast("int").alias("ordinal"),
        "column_name", "data_type", F.col("is_nullable").cast("boolean").alias("is_nullable"),
        F.col("comment").cast("string").alias("comment"), base.cast("string").alias("base_type"),
    )


def read_constraints(read: Read, flavour: str) -> DataFrame:
    def names(column: str):
        return F.split(F.col(column).cast("string"), SEPARATOR).alias(column)

    return read(CONSTRAINT_QUERIES[flavour]).select(
        F.lit(flavour).alias("flavour"), "schema_name", "table_name", "kind", names("columns"),
        F.col("ref_schema").cast("string").alias("ref_schema"), F.col("ref_table").cast("string").alias("ref_table"), names("ref_columns"),
        F.col("definition").cast("string").alias("definition"),
    )


def read_enums(read: Read, flavour: str, like: DataFrame) -> DataFrame:
    if flavour not in ENUM_QUERIES:
        return local_rows(like.sparkSession, [], "flavour string, type_name string, ord double, label string")
    return read(ENUM_QUERIES[flavour]).select(
        F.lit(flavour).alias("flavour"), "type_name", F.col("ord").cast("double").alias("ord"), "label"
    )


def _table(flavour: str, schema: str, table: str) -> str:
    return quoted(flavour, table) if flavour == "sqlite" else f"{quoted(flavour, schema)}.{quoted(flavour, table)}"


def read_code_tables(read: Read, flavour: str, columns: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row counts and items of the tables that can be code tables: keyed tables that something refers to.

    The source is asked for one count per such table, and for the rows of those below the size limit.
    """
    spark = columns.sparkSession
    keys = prof.primary_keys(constraints)
    referred = prof.foreign_keys(constraints).select("flavour", "ref_table").distinct()
    named = prof.code_table_by_name(columns, constraints).select("flavour", "ref_table").distinct()
    targets = referred.union(named).distinct().withColumnRenamed("ref_table", "table_name")
    counts, parts = [], []
    chosen = prof.code_table_columns(columns, keys).join(targets, ["flavour", "table_name"], "left_semi")
    for row in keys.join(targets, ["flavour", "table_name"], "left_semi").select("schema_name", "table_name").distinct().collect():
        n = read(f"SELECT COUNT(*) AS n FROM {_table(flavour, row.schema_name, row.table_name)}").first().n
        counts.append((flavour, row.schema_name, row.table_name, n))
    small = {(schema, table) for _, schema, table, n in counts if n < prof.CODE_TABLE_ROWS}
    for row in chosen.collect():
        if (row.schema_name, row.table_name) in small:
            label = quoted(flavour, row.code_column)
            text = quoted(flavour, row.description_column) if row.description_column else "NULL"
            rows = read(
                f"SELECT {quoted(flavour, row.key_column)} AS value, {label} AS code, {text} AS description "
                f"FROM {_table(flavour, row.schema_name, row.table_name)}"
            )
            parts.append(
                rows.select(
                    F.lit(flavour).alias("flavour"), F.lit(row.schema_name).alias("schema_name"),
                    F.lit(row.table_name).alias("table_name"), F.col("value").cast("bigint").alias("value"), "code",
                    F.col("description").cast("string").alias("description"),
                )
            )
    sizes = local_rows(spark, counts, "flavour string, schema_name string, table_name string, n bigint")
    empty = local_rows(
        spark, [], "flavour string, schema_name string, table_name string, value bigint, code string, description string"
    )
    return sizes, reduce(DataFrame.unionByName, parts, empty)


def profile_database(read: Read, flavour: str) -> DataFrame:
    """Variables and vocabularies of all columns of a source database."""
    columns, constraints = read_columns(read, flavour), read_constraints(read, flavour)
    enums = read_enums(read, flavour, columns)
    sizes, items = read_code_tables(read, flavour, columns, constraints)
    return prof.profile_catalog(columns, constraints, enums, sizes, items)
