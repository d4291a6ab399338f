"""Schema profiling over catalog snapshots and over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions.sqltypes import map_type
from studylake.operators import discovery as disc
from studylake.operators import profile as prof
from workload.dictionary_queries import items_text
from workload.registry import query
from workload.views import TABLES

COLUMN = "flavour, schema_name, table_name, column_name"

# --- declared types -------------------------------------------------------------------------------------------

# Type names each flavour counts as integer, float, date-time and time.
ZONED = "'timestamp with time zone', 'timestamp without time zone'"
ZONED_TIME = "'time with time zone', 'time without time zone'"
INTEGERS = {
    "generic": "'int','integer','smallint','bigint','tinyint','mediumint','int2','int4','int8','serial','bigserial','smallserial'",
    "mssql": "'int','integer','smallint','bigint','tinyint','bit'",
    "duckdb": "'integer','int','int4','int8','bigint','smallint','tinyint','hugeint','ubigint','uinteger','usmallint','utinyint','int2'",
    "postgresql": "'int','integer','smallint','bigint','int2','int4','int8','serial','bigserial','smallserial','oid'",
    "mysql": "'int','integer','smallint','bigint','tinyint','mediumint'",
}
FLOATS = {
    "generic": "'float','double','real','decimal','numeric','money','smallmoney','float4','float8','double precision'",
    "mssql": "'float','real','decimal','numeric','money','smallmoney'",
    "duckdb": "'float','double','real','decimal','numeric','float4','float8'",
    "postgresql": "'float4','float8','real','double precision','numeric','decimal','money'",
    "mysql": "'float','double','real','decimal','numeric'",
}
DATETIMES = {
    "generic": f"'datetime','datetime2','datetimeoffset','timestamp','timestamptz',{ZONED}",
    "mssql": "'datetime','datetime2','datetimeoffset','smalldatetime'",
    "duckdb": f"'timestamp','timestamptz',{ZONED}",
    "postgresql": f"'timestamp','timestamptz',{ZONED}",
    "mysql": "'datetime','timestamp'",
}
TIMES = {"generic": f"'time','timetz',{ZONED_TIME}", "postgresql": f"'time','timetz',{ZONED_TIME}"}


def type_sql(flavour: str, column: str = "data_type") -> str:
    t = f"lower({column})"
    if flavour == "sqlite":
        return (
            f"CASE WHEN {t} LIKE '%int%' THEN 1 WHEN {t} LIKE '%real%' OR {t} LIKE '%floa%' OR {t} LIKE '%doub%' THEN 2 "
            f"WHEN {t} LIKE '%datetime%' OR {t} LIKE '%timestamp%' THEN 5 WHEN {t} = 'date' THEN 4 WHEN {t} = 'time' THEN 6 ELSE 3 END"
        )
    if flavour == "mssql":
        t = rf"regexp_replace({t}, '\s*\([^)]*\)\s*$', '')"
    enum = f"WHEN {t} LIKE 'enum%' THEN 7 " if flavour in ("duckdb", "mysql") else ""
    return (
        f"CASE {enum}WHEN {t} IN ({INTEGERS[flavour]}) THEN 1 WHEN {t} IN ({FLOATS[flavour]}) "
        rf"OR regexp_matches({t}, '^(decimal|numeric)\s*\(\s*\d+\s*,\s*\d+\s*\)$') THEN 2 "
        f"WHEN {t} IN ({DATETIMES[flavour]}) THEN 5 WHEN {t} = 'date' THEN 4 WHEN {t} IN ({TIMES.get(flavour, repr('time'))}) THEN 6 ELSE 3 END"
    )


BY_FLAVOUR = "CASE flavour " + " ".join(
    f"WHEN '{f}' THEN {type_sql(f)}" for f in ("mssql", "duckdb", "postgresql", "mysql", "sqlite")
) + " END"

for _flavour in ("generic", "mssql", "duckdb", "postgresql", "mysql", "sqlite"):

    def _typed(x, flavour=_flavour):
        return x.cat_columns.select(
            "table_name", "column_name", "data_type", map_type(F.col("data_type"), flavour).alias("value_type_id")
        )

    query("map_types_postgres" if _flavour == "postgresql" else f"map_types_{_flavour}", f"SELECT table_name, column_name, data_type, {type_sql(_flavour)} AS value_type_id FROM cat_columns")(_typed)


@query("original_types", f"SELECT {COLUMN}, COALESCE(c.data_type, r.data_type) AS data_type FROM ("
       "SELECT flavour, schema_name, table_name, column_name, 'VARCHAR' AS data_type FROM cat_columns "
       "UNION ALL SELECT flavour, schema_name, table_name, 'total', 'FLOAT' FROM src) r "
       f"LEFT JOIN (SELECT {COLUMN}, data_type FROM cat_columns) c USING ({COLUMN})")
def _(x):
    reported = x.sql(
        f"SELECT {COLUMN}, 'VARCHAR' AS data_type FROM cat_columns "
        "UNION ALL SELECT flavour, schema_name, table_name, 'total', 'FLOAT' FROM src"
    )
    return prof.original_types(reported, x.cat_columns)


@query(
    "column_comments",
    f"""SELECT w.flavour, w.schema_name, w.table_name, w.column_name, c.comment AS description FROM (
      SELECT flavour, CASE WHEN flavour = 'postgresql' AND ordinal > 5 THEN 'public' WHEN flavour = 'mssql' AND ordinal > 5 THEN 'dbo'
      WHEN ordinal > 5 THEN 'main' ELSE schema_name END AS schema_name, table_name, column_name FROM cat_columns) w
    LEFT JOIN (SELECT {COLUMN}, comment FROM cat_columns WHERE comment IS NOT NULL AND flavour <> 'sqlite' AND (flavour <> 'mysql' OR comment <> '')) c
    ON c.flavour = w.flavour AND c.schema_name = w.schema_name AND c.table_name = w.table_name AND c.column_name = w.column_name""",
)
def _(x):
    wanted = x.sql(
        "SELECT flavour, CASE WHEN ordinal <= 5 THEN schema_name END AS schema_name, table_name, column_name FROM cat_columns"
    )
    return prof.column_comments(wanted, x.cat_columns)


@query("list_table_columns", "SELECT flavour, schema_name, table_name, ordinal, column_name, data_type, is_nullable FROM cat_columns")
def _(x):
    return prof.list_table_columns(x.cat_columns)


# --- keys -----------------------------------------------------------------------------------------------------

@query(
    "foreign_keys",
    """SELECT a.flavour, a.schema_name, a.table_name, 'parent' AS column_name, b.table_name AS ref_table, 'k' || b.n AS ref_column
    FROM src a JOIN src b ON b.k = a.k + 5 UNION ALL
    SELECT a.flavour, a.schema_name, a.table_name, 'title', b.table_name, 'title' FROM src a JOIN src b ON b.k = a.k + 5 WHERE b.k % 7 = 0""",
)
def _(x):
    return prof.foreign_keys(x.cat_constraints)


PRIMARY = """SELECT flavour, schema_name, table_name, 'k' || n AS column_name, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS key_width FROM src
UNION ALL SELECT flavour, schema_name, table_name, 'title', 2 FROM src WHERE k % 7 = 0"""


@query("primary_keys", PRIMARY)
def _(x):
    return prof.primary_keys(x.cat_constraints)


@query("code_tables", f"SELECT {COLUMN}, key_width, n FROM ({PRIMARY}) p JOIN cat_row_counts USING (flavour, schema_name, table_name) WHERE n < 250")
def _(x):
    return prof.code_tables(prof.primary_keys(x.cat_constraints), x.cat_row_counts)


# Integer and text columns of the given tables, in table order.
INTEGER_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}
TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "embeddings": [], "pages": ["url", "html"],
    "benchmark": ["text"], "labels": [], "conversations": ["role", "text"],
}


def is_key(table: str, column: str) -> str:
    return f"(SELECT COUNT(*) < 250 AND COUNT(*) = COUNT(DISTINCT {column}) AND COUNT(*) > 0 FROM {table})"


MEASURED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT COUNT(*) FROM {t}) AS n WHERE {is_key(t, c)}"
    for t in TABLES for c in INTEGER_COLUMNS[t]
)


@query("code_tables_measured", MEASURED)
def _(x):
    return prof.small_keyed_tables(x.tables())


@query(
    "inclusion_keys",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{ref}' AS ref_table, '{key}' AS ref_column WHERE {is_key(ref, key)} "
        f"AND (SELECT COUNT({c}) FROM {t}) > 0 AND NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {ref}))"
        for t in TABLES for c in INTEGER_COLUMNS[t] for ref in TABLES for key in INTEGER_COLUMNS[ref] if ref != t
    ),
)
def _(x):
    tables = x.tables()
    return prof.inclusion_keys(tables, prof.small_keyed_tables(tables))


VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{kind}' AS kind, '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL"
    for kind, columns in (("integer", INTEGER_COLUMNS), ("text", TEXT_COLUMNS)) for t in TABLES for c in columns[t]
)


@query(
    "inclusion_dependencies",
    f"""WITH v AS ({VALUES}), sizes AS (SELECT table_name, column_name, COUNT(*) AS n FROM v GROUP BY table_name, column_name)
    SELECT a.table_name, a.column_name, b.table_name AS ref_table, b.column_name AS ref_column FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value
    JOIN sizes s ON s.table_name = a.table_name AND s.column_name = a.column_name
    WHERE a.table_name <> b.table_name OR a.column_name <> b.column_name GROUP BY 1, 2, 3, 4, s.n HAVING COUNT(*) = s.n""",
)
def _(x):
    return disc.inclusion_dependencies(x.tables())


STAMP_COLUMNS = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}


def _differ(table: str, *columns: str) -> str:
    whole = " AND ".join(f"COUNT(*) = COUNT({c})" for c in columns)
    return f"(SELECT COUNT(*) > 0 AND {whole} AND COUNT(*) = COUNT(DISTINCT ({', '.join(columns)})) FROM {table})"


def _keys_of(table: str) -> list[str]:
    columns = INTEGER_COLUMNS[table] + TEXT_COLUMNS[table] + STAMP_COLUMNS.get(table, [])
    size = f"(SELECT COUNT(*) FROM {table}) AS n"
    single = [f"SELECT '{table}' AS table_name, '{c}' AS key_columns, {size} WHERE {_differ(table, c)}" for c in columns]
    pairs = [
        f"SELECT '{table}', array_to_string(list_sort(['{a}', '{b}']), ','), {size} WHERE NOT {_differ(table, a)} AND NOT {_differ(table, b)} AND {_differ(table, a, b)}"
        for i, a in enumerate(columns) for b in columns[i + 1 :]
    ]
    return single + pairs


@query("unique_combinations", " UNION ALL ".join(text for table in TABLES for text in _keys_of(table)))
def _(x):
    found = disc.unique_combinations(x.tables())
    return found.select("table_name", F.array_join(F.sort_array("key_columns"), ",").alias("key_columns"), "n")


def _described(table: str) -> str:
    texts = TEXT_COLUMNS[table]
    named = [c for c in texts if c in ("description", "desc", "label", "name", "text")]
    if named and named[-1] != texts[0]:
        return named[-1]
    return texts[1] if len(texts) > 1 else "CAST(NULL AS VARCHAR)"


@query(
    "code_table_vocabulary",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS BIGINT) AS value, {TEXT_COLUMNS[t][0]} AS code, {_described(t)} AS description "
        f"FROM {t} WHERE {is_key(t, c)}"
        for t in TABLES if TEXT_COLUMNS[t] for c in INTEGER_COLUMNS[t]
    ),
)
def _(x):
    tables = x.tables()
    return prof.code_table_items(tables, prof.small_keyed_tables(tables))


# Text columns of each snapshot table besides its key, by position: 2 title, 3 label/code/remark, then the rest.
TEXTS = f"""SELECT c.flavour, c.schema_name, c.table_name, c.column_name, c.ordinal, p.column_name AS key_column
FROM (SELECT *, {BY_FLAVOUR} AS kind FROM cat_columns) c JOIN ({PRIMARY}) p ON p.flavour = c.flavour AND p.schema_name = c.schema_name
AND p.table_name = c.table_name WHERE kind = 3 AND c.column_name <> p.column_name"""


@query(
    "code_table_columns",
    f"""WITH texts AS ({TEXTS}), ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name, key_column ORDER BY ordinal) AS r,
      ROW_NUMBER() OVER (PARTITION BY table_name, key_column ORDER BY CASE WHEN lower(column_name) IN ('description','desc','label','name','text') THEN ordinal END DESC NULLS LAST) AS d FROM texts)
    SELECT flavour, schema_name, table_name, key_column, MAX(CASE WHEN r = 1 THEN column_name END) AS code_column,
      COALESCE(MAX(CASE WHEN d = 1 AND r <> 1 AND lower(column_name) IN ('description','desc','label','name','text') THEN column_name END),
      MAX(CASE WHEN r = 2 THEN column_name END)) AS description_column FROM ranked GROUP BY ALL""",
)
def _(x):
    return prof.code_table_columns(x.cat_columns, prof.primary_keys(x.cat_constraints))


BY_NAME = f"""SELECT c.flavour, c.schema_name, c.table_name, c.column_name, s.schema_name AS ref_schema, s.table_name AS ref_table, 'k' || s.n AS ref_column
FROM cat_columns c JOIN src s ON s.flavour = 'duckdb' AND s.k % 7 <> 0 AND 'k' || s.n = lower(c.column_name)
  AND NOT (s.schema_name = c.schema_name AND s.table_name = c.table_name)
WHERE c.flavour = 'duckdb' QUALIFY ROW_NUMBER() OVER (PARTITION BY c.schema_name, c.table_name, c.column_name
  ORDER BY CASE s.schema_name WHEN 'codes' THEN 0 ELSE 1 END, s.table_name) = 1"""


@query("code_table_by_name", BY_NAME)
def _(x):
    return prof.code_table_by_name(x.cat_columns, x.cat_constraints)


# --- enums and checks -----------------------------------------------------------------------------------------

ENUMS = """SELECT DISTINCT flavour, 'enum(''a' || n || ''',''b'')' AS data_type, CAST(v AS BIGINT) AS value, CASE v WHEN 1 THEN 'a' || n ELSE 'b' END AS code
FROM src, (VALUES (1), (2)) t(v) WHERE flavour = 'mysql'
UNION ALL SELECT DISTINCT flavour, 'mood' || n, v, CASE v WHEN 1 THEN 'low' WHEN 2 THEN 'mid ' || n ELSE 'high' END
FROM src, (VALUES (1), (2), (3)) t(v) WHERE flavour IN ('duckdb', 'postgresql')"""


@query("enum_items", ENUMS)
def _(x):
    return prof.enum_items(x.cat_columns, x.cat_enums)


CHECKS = """SELECT flavour, schema_name, table_name, 'status' AS column_name, CAST(v AS BIGINT) AS value,
CASE v WHEN 1 THEN 'open ' || n ELSE 'shut' END AS code FROM src, (VALUES (1), (2)) t(v)"""


@query("check_items", CHECKS)
def _(x):
    return prof.check_items(x.cat_columns, x.cat_constraints)


# --- queries and the whole profile ----------------------------------------------------------------------------

PROFILED = """SELECT o_orderkey, o_totalprice, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS urgency,
c_nationkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(
    "profile_query_schema",
    f"""WITH q AS ({PROFILED}) SELECT i AS ordinal, name, value_type_id, is_nullable, n_rows, n_rows - n AS n_null FROM (
      SELECT 1 AS i, 'o_orderkey' AS name, 1 AS value_type_id, TRUE AS is_nullable, COUNT(*) AS n_rows, COUNT(o_orderkey) AS n FROM q
      UNION ALL SELECT 2, 'o_totalprice', 2, TRUE, COUNT(*), COUNT(o_totalprice) FROM q UNION ALL SELECT 3, 'o_orderdate', 5, TRUE, COUNT(*), COUNT(o_orderdate) FROM q
      UNION ALL SELECT 4, 'urgency', 3, TRUE, COUNT(*), COUNT(urgency) FROM q UNION ALL SELECT 5, 'c_nationkey', 1, TRUE, COUNT(*), COUNT(c_nationkey) FROM q
      UNION ALL SELECT 6, 'c_name', 3, TRUE, COUNT(*), COUNT(c_name) FROM q) t""",
)
def _(x):
    return prof.profile_frame(x.sql(PROFILED))


@query(
    "query_source_table",
    """SELECT query_id, CASE query_id % 5 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN NULL WHEN 3 THEN lang ELSE source END AS source_table
    FROM (SELECT doc_id AS query_id, lang, source FROM documents) d""",
)
def _(x):
    return prof.query_source_table(x.query_log).select("query_id", "source_table")


ITEM_TEXT = "string_agg(value || ':' || code || COALESCE(':' || description, ''), '; ' ORDER BY value)"
PROFILE = f"""WITH typed AS (SELECT *, {BY_FLAVOUR} AS kind, lower(column_name) AS col FROM cat_columns),
pk AS ({PRIMARY}),
small AS (SELECT p.flavour, p.schema_name, p.table_name, lower(p.column_name) AS col FROM pk p JOIN cat_row_counts c USING (flavour, schema_name, table_name) WHERE n < 250),
lists AS (SELECT flavour, schema_name, table_name, {ITEM_TEXT} AS items FROM cat_code_items GROUP BY flavour, schema_name, table_name),
enum_lists AS (SELECT flavour, data_type, string_agg(value || ':' || code, '; ' ORDER BY value) AS items FROM ({ENUMS}) e GROUP BY flavour, data_type),
fk AS (SELECT a.flavour, a.schema_name, a.table_name, b.table_name AS ref_table, l.items FROM src a JOIN src b ON b.k = a.k + 5
  JOIN small s ON s.flavour = b.flavour AND s.table_name = b.table_name AND s.col = 'k' || b.n JOIN lists l ON l.table_name = b.table_name),
named AS (SELECT b.schema_name, b.table_name, lower(b.column_name) AS col, CASE WHEN ref_schema = 'codes' THEN 'codes.' || ref_table ELSE ref_table END AS ref, l.items
  FROM ({BY_NAME}) b JOIN small s ON s.flavour = 'duckdb' AND s.table_name = b.ref_table AND s.col = lower(b.ref_column) JOIN lists l ON l.table_name = b.ref_table),
checks AS (SELECT table_name, string_agg(value || ':' || code, '; ' ORDER BY value) AS items FROM ({CHECKS}) c GROUP BY table_name)
SELECT t.flavour, t.schema_name, t.table_name, t.column_name, t.ordinal,
  CASE WHEN e.items IS NOT NULL OR kind = 7 THEN 7 WHEN kind = 1 AND (fk.items IS NOT NULL OR named.items IS NOT NULL) THEN 7
    WHEN kind = 3 AND checks.items IS NOT NULL THEN 7 ELSE kind END AS value_type_id,
  CASE WHEN t.flavour = 'sqlite' OR (t.flavour = 'mysql' AND comment = '') THEN NULL ELSE comment END AS description,
  CASE WHEN e.items IS NOT NULL THEN t.column_name || '_enum' WHEN kind = 1 AND (fk.items IS NOT NULL OR named.items IS NOT NULL) THEN t.column_name || '_codes'
    WHEN kind = 3 AND checks.items IS NOT NULL THEN t.column_name || '_allowed' END AS vocabulary_name,
  CASE WHEN e.items IS NOT NULL THEN 'Enum values for ' || t.column_name WHEN kind = 1 AND fk.items IS NOT NULL THEN 'Code table values from ' || fk.ref_table
    WHEN kind = 1 AND named.items IS NOT NULL THEN 'Code table values from ' || named.ref
    WHEN kind = 3 AND checks.items IS NOT NULL THEN 'Allowed values for ' || t.column_name END AS vocabulary_description,
  CASE WHEN e.items IS NOT NULL THEN e.items WHEN kind = 1 THEN COALESCE(fk.items, named.items) WHEN kind = 3 THEN checks.items END AS items
FROM typed t LEFT JOIN enum_lists e ON e.flavour = t.flavour AND e.data_type = t.data_type
LEFT JOIN fk ON fk.table_name = t.table_name AND t.column_name = 'parent'
LEFT JOIN named ON t.flavour = 'duckdb' AND named.table_name = t.table_name AND named.col = t.col
LEFT JOIN checks ON checks.table_name = t.table_name AND t.column_name = 'status'"""


@query("profile_catalog", PROFILE)
def _(x):
    result = prof.profile_catalog(x.cat_columns, x.cat_constraints, x.cat_enums, x.cat_row_counts, x.cat_code_items)
    return result.withColumn("items", F.when(F.col("items").isNotNull(), items_text()))
