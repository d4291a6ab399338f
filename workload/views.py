"""Views that shape the driver's tables as study data. Each text runs unchanged in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# --- EAV exports ----------------------------------------------------------------------------------------------

VIEWS["eav"] = """
SELECT CAST(record AS STRING) AS record, field_name, value FROM (
SELECT c_custkey AS record, 'mktsegment' AS field_name, c_mktsegment AS value FROM customer
UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS STRING) FROM customer
UNION ALL SELECT c_custkey, 'acctbal', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) FROM customer
UNION ALL SELECT c_custkey, 'segment_code', CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2.5'
  WHEN 'HOUSEHOLD' THEN '3' ELSE 'unknown' END FROM customer
UNION ALL SELECT o_custkey, 'first_order', CONCAT(CAST(MONTH(MIN(o_orderdate)) AS STRING), '/',
  CAST(DAY(MIN(o_orderdate)) AS STRING), '/', CAST(YEAR(MIN(o_orderdate)) AS STRING)) FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'priority', o_orderpriority FROM orders
UNION ALL SELECT o_custkey, 'status', CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END FROM orders) t"""

VIEWS["eav_variables"] = """
SELECT ROW_NUMBER() OVER (ORDER BY name) + 100000 AS variable_id, 0 AS domain_id, name, CASE name
  WHEN 'acctbal' THEN 2 WHEN 'first_order' THEN 4 WHEN 'nation' THEN 1 WHEN 'segment_code' THEN 7 ELSE 3 END AS value_type_id,
  CASE name WHEN 'first_order' THEN '%m/%d/%Y' END AS value_format
FROM (SELECT DISTINCT field_name AS name FROM eav WHERE field_name <> 'status') f
UNION ALL SELECT p_partkey, p_size % 5, CONCAT(p_name, ' ', CAST(p_partkey AS STRING)), (p_size % 8) + 1, CAST(NULL AS STRING) FROM part"""

# Date, datetime and time texts in all the spellings a dictionary can ask for.
VIEWS["stamps"] = """
SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS m, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, CAST(FLOOR(SECOND(ts)) AS INT) AS s
FROM events"""
VIEWS["stamp_texts"] = """
SELECT event_id,
  CONCAT(CAST(m AS STRING), '/', CAST(d AS STRING), '/', CAST(y AS STRING)) AS mdy,
  CONCAT(LPAD(CAST(d AS STRING), 2, '0'), '/', LPAD(CAST(m AS STRING), 2, '0'), '/', CAST(y AS STRING)) AS dmy,
  CONCAT(CAST(y AS STRING), '-', CAST(m AS STRING), '-', CAST(d AS STRING)) AS ymd,
  CONCAT(CAST(h AS STRING), ':', CAST(mi AS STRING)) AS hm,
  CONCAT(LPAD(CAST(mi AS STRING), 2, '0'), ':', CAST(s AS STRING)) AS ms,
  CONCAT(CAST(h AS STRING), ':', LPAD(CAST(mi AS STRING), 2, '0'), ':', LPAD(CAST(s AS STRING), 2, '0')) AS hms
FROM stamps"""

# --- field dictionary -----------------------------------------------------------------------------------------

VIEWS["dictionary"] = """
SELECT CONCAT('f', CAST(CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END AS STRING)) AS field_name,
  p_brand AS form_name,
  CASE p_size % 12 WHEN 0 THEN 'radio' WHEN 1 THEN 'dropdown' WHEN 2 THEN 'yesno' WHEN 3 THEN 'checkbox' WHEN 4 THEN 'calc'
    WHEN 5 THEN 'slider' WHEN 6 THEN 'notes' WHEN 7 THEN 'descriptive' WHEN 8 THEN 'File' ELSE 'text' END AS field_type,
  CASE p_partkey % 17 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'number_2dp' WHEN 3 THEN 'date_mdy'
    WHEN 4 THEN 'date_dmy' WHEN 5 THEN 'date_ymd' WHEN 6 THEN 'datetime_mdy' WHEN 7 THEN 'datetime_seconds_ymd'
    WHEN 8 THEN 'time' WHEN 9 THEN 'time_hh_mm_ss' WHEN 10 THEN 'time_mm_ss' WHEN 11 THEN 'email' WHEN 12 THEN 'Number'
    END AS text_validation_type_or_show_slider_number,
  CASE WHEN p_size % 12 <> 2 THEN CONCAT('1, ', p_name, ' | 2.5, ', p_type, ', x |a = ', p_brand, '| | b | 1e1,Ten')
    END AS select_choices_or_calculations,
  CONCAT('<b>', p_name, '</b>&nbsp;&amp;lt;', CAST(p_size AS STRING), '<style>b {}</style> &quot;', p_type) AS field_label,
  p_type AS field_note, p_partkey AS ord
FROM part"""

VIEWS["choices"] = """
SELECT doc_id AS field_id, CONCAT('1, ', lang, ' | 2, ', source, ' | a = ', CAST(n_chars AS STRING), ' | 3, ', text) AS choices
FROM documents"""

VIEWS["known_variables"] = """
SELECT p_partkey + 1 AS variable_id, 7 AS domain_id, CONCAT('f', CAST(p_partkey AS STRING)) AS name, 3 AS value_type_id,
  CAST(NULL AS STRING) AS value_format, CAST(NULL AS BIGINT) AS vocabulary_id, 'none' AS keyrole, p_name AS description,
  CAST(NULL AS STRING) AS note
FROM part WHERE p_type IN ('PROMO', 'SMALL', 'MEDIUM')"""
VIEWS["known_vocabularies"] = """
SELECT p_partkey + 1 AS vocabulary_id, 7 AS domain_id, CONCAT('src.f', CAST(p_partkey AS STRING)) AS name, 'old' AS description
FROM part WHERE p_type IN ('PROMO', 'LARGE')"""

# --- catalog --------------------------------------------------------------------------------------------------

VIEWS["cat_domains"] = "SELECT r_regionkey AS domain_id, r_name AS name, CAST(NULL AS STRING) AS uri FROM region"
VIEWS["cat_studies"] = "SELECT n_nationkey AS study_id, n_name AS name, (n_nationkey % 6) + 1 AS study_type_id FROM nation"
VIEWS["cat_study_domains"] = "SELECT n_nationkey AS study_id, n_regionkey AS domain_id FROM nation"
VIEWS["cat_assets"] = """
SELECT c_custkey AS asset_id, c_nationkey AS study_id, c_name AS name,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'dataset' ELSE 'file' END AS asset_type FROM customer"""
VIEWS["cat_versions"] = """
SELECT version_id, asset_id, major, minor, patch, created_at,
  ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY major DESC, minor DESC, patch DESC) = 1 AS is_latest
FROM (SELECT o_orderkey AS version_id, o_custkey AS asset_id, CAST(YEAR(o_orderdate) - 1991 AS INT) AS major,
  CAST(MONTH(o_orderdate) AS INT) AS minor, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey, YEAR(o_orderdate), MONTH(o_orderdate)
  ORDER BY o_orderkey) - 1 AS INT) AS patch, o_orderdate AS created_at FROM orders) t"""
# As they come in: some assets have a flagged version, others have none.
VIEWS["raw_versions"] = """
SELECT version_id, asset_id, major, minor, patch, created_at,
  CASE WHEN asset_type = 'dataset' THEN is_latest END AS is_latest
FROM cat_versions JOIN (SELECT asset_id AS a, asset_type FROM cat_assets) t ON asset_id = a"""
VIEWS["cat_transformations"] = """
SELECT s_suppkey AS transformation_id, CASE s_suppkey % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'transform' WHEN 2 THEN 'entity'
  WHEN 3 THEN 'export' ELSE 'repository' END AS transformation_type, s_name AS description FROM supplier"""
VIEWS["cat_inputs"] = "SELECT DISTINCT l_suppkey AS transformation_id, l_orderkey AS version_id FROM lineitem WHERE l_returnflag = 'R'"
VIEWS["cat_outputs"] = "SELECT DISTINCT l_suppkey AS transformation_id, l_orderkey AS version_id FROM lineitem WHERE l_returnflag <> 'R'"
VIEWS["cat_variables"] = """
SELECT p_partkey AS variable_id, p_size % 5 AS domain_id, CONCAT(p_name, ' ', CAST(p_partkey AS STRING)) AS name,
  (p_size % 8) + 1 AS value_type_id, p_type AS vocabulary FROM part"""
VIEWS["cat_vocabulary_items"] = """
SELECT p_type AS vocabulary, CAST(ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_brand) AS INT) AS value, p_brand AS code
FROM (SELECT DISTINCT p_type, p_brand FROM part) t"""
VIEWS["cat_dataset_variables"] = "SELECT DISTINCT l_orderkey AS version_id, l_partkey AS variable_id FROM lineitem"
VIEWS["cat_access"] = """
SELECT s_nationkey AS study_id, CONCAT('user', CAST(s_suppkey % 7 AS STRING)) AS user_id,
  MIN(CASE WHEN s_acctbal > 5000 THEN 'read' ELSE 'write' END) AS access_level FROM supplier
GROUP BY s_nationkey, CONCAT('user', CAST(s_suppkey % 7 AS STRING))"""
# Two batches of named things that overlap, the second with repeats.
VIEWS["old_names"] = """
SELECT MIN(p_partkey) AS variable_id, p_size % 5 AS domain_id, p_name AS name, MIN(p_size) AS value_type_id, MIN(p_brand) AS description
FROM part WHERE p_type IN ('PROMO', 'SMALL', 'MEDIUM') AND p_size > 15 GROUP BY p_size % 5, p_name"""
VIEWS["new_names"] = """
SELECT p_size % 5 AS domain_id, p_name AS name, p_size AS value_type_id, CASE WHEN p_size > 10 THEN p_brand END AS description, p_partkey AS ord
FROM part WHERE p_type IN ('LARGE', 'ECONOMY', 'STANDARD', 'SMALL')"""
# Each version of a customer's year is made from the one before it.
VIEWS["chain_outputs"] = "SELECT o_orderkey AS transformation_id, o_orderkey AS version_id FROM orders"
VIEWS["chain_inputs"] = """
SELECT transformation_id, version_id FROM (SELECT o_orderkey AS transformation_id,
  LAG(o_orderkey) OVER (PARTITION BY o_custkey, YEAR(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS version_id FROM orders) t
WHERE version_id IS NOT NULL"""
VIEWS["chain_seeds"] = """
SELECT version_id FROM (SELECT o_orderkey AS version_id,
  LEAD(o_orderkey) OVER (PARTITION BY o_custkey, YEAR(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS later FROM orders) t
WHERE later IS NULL"""

# --- catalog snapshots of source databases --------------------------------------------------------------------

VIEWS["src"] = """
SELECT s_suppkey AS k, s_nationkey AS n, CASE s_suppkey % 5 WHEN 0 THEN 'duckdb' WHEN 1 THEN 'postgresql' WHEN 2 THEN 'mysql'
  WHEN 3 THEN 'mssql' ELSE 'sqlite' END AS flavour, CASE WHEN s_nationkey < 12 THEN 'main' ELSE 'codes' END AS schema_name,
  CONCAT('t', CAST(s_suppkey AS STRING)) AS table_name, s_name, s_acctbal FROM supplier"""

# Declared types as databases spell them.
NUMBER_TYPES = [
    "INTEGER", "int4", "Decimal(12,2)", "numeric( 8 , 3 )", "bit", "double precision", "money", "hugeint", "oid", "mediumint",
    "int unsigned", "decimal(9)", "real", "FLOAT", "numeric", "serial", "varchar(20)", "bigint", "utinyint",
]
TIME_TYPES = [
    "date", "TIMESTAMP", "timestamp with time zone", "datetime2", "smalldatetime", "time", "timetz", "datetime2(7)",
    "timestamp without time zone", "time without time zone", "datetimeoffset", "interval", "timestamptz",
]


def _choose(expression: str, texts: list[str]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


def _catalog_columns() -> str:
    columns = [
        ("CONCAT('k', CAST(n AS STRING))", "'integer'", "FALSE", "CONCAT('Key of ', s_name)"),
        ("'title'", "CASE flavour WHEN 'duckdb' THEN 'VARCHAR' ELSE 'varchar(40)' END", "TRUE", "''"),
        ("CASE k % 3 WHEN 0 THEN 'Label' WHEN 1 THEN 'code' ELSE 'remark' END", "'text'", "TRUE", "s_name"),
        ("'parent'", "'int'", "TRUE", "CAST(NULL AS STRING)"),
        ("'kind'", "CASE flavour WHEN 'mysql' THEN CONCAT('enum(''a', CAST(n AS STRING), ''',''b'')') WHEN 'duckdb' THEN"
         " CONCAT('mood', CAST(n AS STRING)) WHEN 'postgresql' THEN CONCAT('mood', CAST(n AS STRING)) ELSE 'varchar(10)' END",
         "TRUE", "'Kind of row'"),
        ("'status'", "'text'", "TRUE", "CAST(NULL AS STRING)"),
        ("CONCAT('K', CAST(n + 1 AS STRING))", "'bigint'", "TRUE", "CAST(NULL AS STRING)"),
        ("'amount'", _choose(f"k % {len(NUMBER_TYPES)}", NUMBER_TYPES), "TRUE", "CAST(NULL AS STRING)"),
        ("'seen'", _choose(f"k % {len(TIME_TYPES)}", TIME_TYPES), "TRUE", "CAST(NULL AS STRING)"),
    ]
    return " UNION ALL ".join(
        f"SELECT flavour, schema_name, table_name, {i + 1} AS ordinal, {name} AS column_name, {kind} AS data_type, "
        f"{nullable} AS is_nullable, {comment} AS comment FROM src"
        for i, (name, kind, nullable, comment) in enumerate(columns)
    )


VIEWS["cat_columns"] = _catalog_columns()

VIEWS["cat_checks"] = """
SELECT flavour, schema_name, table_name, CASE flavour
  WHEN 'postgresql' THEN CONCAT('CHECK (((status)::text = ANY ((ARRAY[''open ', CAST(n AS STRING), '''::character varying, ''shut''::character varying])::text[])))')
  WHEN 'duckdb' THEN CONCAT('CHECK((status IN (''open ', CAST(n AS STRING), ''', ''shut'')))')
  WHEN 'mysql' THEN CONCAT('((status = ''open ', CAST(n AS STRING), ''') or (status = ''shut'') or (status = ''open ', CAST(n AS STRING), '''))')
  WHEN 'mssql' THEN CONCAT('([status]=''open ', CAST(n AS STRING), ''' OR [status]=''shut'')')
  ELSE CONCAT('CREATE TABLE ', table_name, ' (parent int, status text CHECK (status IN (''open ', CAST(n AS STRING), ''', ''shut'')))') END AS definition
FROM src"""

VIEWS["cat_constraints"] = """
SELECT flavour, schema_name, table_name, 'PRIMARY KEY' AS kind,
  split(CASE WHEN k % 7 = 0 THEN CONCAT('k', CAST(n AS STRING), ',title') ELSE CONCAT('k', CAST(n AS STRING)) END, ',') AS columns,
  CAST(NULL AS STRING) AS ref_table, split(CAST(NULL AS STRING), ',') AS ref_columns, CAST(NULL AS STRING) AS definition FROM src
UNION ALL SELECT a.flavour, a.schema_name, a.table_name, 'FOREIGN KEY', split(CASE WHEN b.k % 7 = 0 THEN 'parent,title' ELSE 'parent' END, ','),
  b.table_name, split(CASE WHEN b.k % 7 = 0 THEN CONCAT('k', CAST(b.n AS STRING), ',title') ELSE CONCAT('k', CAST(b.n AS STRING)) END, ','),
  CAST(NULL AS STRING) FROM src a JOIN src b ON b.k = a.k + 5
UNION ALL SELECT flavour, schema_name, table_name, 'CHECK', split(CAST(NULL AS STRING), ','), CAST(NULL AS STRING),
  split(CAST(NULL AS STRING), ','), definition FROM cat_checks"""

VIEWS["cat_enums"] = """
SELECT flavour, type_name, ord, label FROM (
SELECT DISTINCT flavour, CONCAT('mood', CAST(n AS STRING)) AS type_name, 1.0 AS ord, 'low' AS label FROM src WHERE flavour IN ('duckdb', 'postgresql')
UNION ALL SELECT DISTINCT flavour, CONCAT('mood', CAST(n AS STRING)), 1.5, CONCAT('mid ', CAST(n AS STRING)) FROM src WHERE flavour IN ('duckdb', 'postgresql')
UNION ALL SELECT DISTINCT flavour, CONCAT('mood', CAST(n AS STRING)), 2.0, 'high' FROM src WHERE flavour IN ('duckdb', 'postgresql')) t"""

# Rows of the keyed tables: from none to several hundred, the more the higher the balance.
VIEWS["cat_code_items"] = """
SELECT DISTINCT flavour, schema_name, table_name, l_partkey AS value, CONCAT('c', CAST(l_partkey AS STRING)) AS code,
  CASE WHEN l_partkey > 10 THEN CONCAT('part ', CAST(l_partkey AS STRING)) END AS description
FROM lineitem JOIN src ON l_suppkey = k WHERE l_quantity <= s_acctbal / 200"""
VIEWS["cat_row_counts"] = "SELECT flavour, schema_name, table_name, COUNT(*) AS n FROM cat_code_items GROUP BY flavour, schema_name, table_name"

VIEWS["query_log"] = """
SELECT doc_id AS query_id, CONCAT('SELECT a, b', CHR(10), CASE doc_id % 3 WHEN 0 THEN 'from ' WHEN 1 THEN 'FROM   ' ELSE 'From ' END,
  CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN CONCAT('"', source, '"') WHEN 2 THEN CONCAT('main.', lang) WHEN 3 THEN CONCAT('[', lang, ']')
  ELSE CONCAT('`', source, '`') END, CASE WHEN n_chars > 500 THEN CONCAT(' d WHERE x = ', CAST(n_chars AS STRING)) ELSE ';' END) AS sql
FROM documents"""

# --- names, entities ------------------------------------------------------------------------------------------

VIEWS["names"] = """
SELECT url AS name FROM pages UNION SELECT p_name FROM part UNION SELECT c_name FROM customer
UNION SELECT CONCAT(' ', CAST(n_chars AS STRING), ' ', lang, '--', source, ' ') FROM documents
UNION SELECT CONCAT('XML', source, '.', lang) FROM documents UNION SELECT text FROM conversations"""
VIEWS["relations"] = """
SELECT user_id AS entity_instance_id_1, event_type AS kind, CAST(MIN(ts) AS DATE) AS valid_from, CAST(MAX(ts) AS DATE) AS valid_to
FROM events GROUP BY user_id, event_type"""
# What a customer ordered in a year, and when a supplier shipped: spans of a day to a year.
VIEWS["order_relations"] = """
SELECT o_custkey AS entity_instance_id_1, YEAR(o_orderdate) AS entity_instance_id_2, CAST(MIN(o_orderdate) AS DATE) AS valid_from,
  CAST(MAX(o_orderdate) AS DATE) AS valid_to FROM orders GROUP BY o_custkey, YEAR(o_orderdate)"""
VIEWS["ship_periods"] = """
SELECT l_suppkey AS supplier, l_linenumber AS line, CAST(MIN(l_shipdate) AS DATE) AS first_day, CAST(MAX(l_shipdate) AS DATE) AS last_day
FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.05 GROUP BY l_suppkey, l_linenumber, YEAR(l_shipdate)"""
VIEWS["ship_days"] = """
SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.05"""
# Three studies whose external ids are the same: an instance belongs to one study.
VIEWS["study_events"] = "SELECT *, CAST(user_id % 3 AS BIGINT) AS study_id FROM events"
_USERS = "SELECT DISTINCT CAST(user_id AS STRING) AS external_id, user_id + 1000 AS instance_id FROM events"
_KINDS = "SELECT DISTINCT event_type AS external_id, LENGTH(event_type) * 100 + ASCII(event_type) AS instance_id FROM events"
for _name, _text in (("users", _USERS), ("kinds", _KINDS)):
    VIEWS[_name] = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS study_id, external_id, instance_id + {1_000_000 * i} AS instance_id FROM ({_text}) t{i}" for i in range(3)
    )
VIEWS["priority_items"] = """
SELECT DISTINCT CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS vocabulary_item_id, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS value FROM orders"""
VIEWS["rank_items"] = "SELECT vocabulary_item_id + 100 AS vocabulary_item_id, value * 10 AS value FROM priority_items"
VIEWS["item_mapping"] = "SELECT vocabulary_item_id AS from_item, vocabulary_item_id + 100 AS to_item FROM priority_items WHERE value < 5"
# Items of fifty vocabularies, and pairs of items that mean the same: chains of up to eleven items, some within one vocabulary.
VIEWS["part_items"] = """
SELECT p_partkey AS vocabulary_item_id, CAST(p_partkey % 50 AS BIGINT) AS vocabulary_id, p_partkey * 3 AS value FROM part"""
VIEWS["part_mapping"] = """
SELECT p_partkey AS from_vocabulary_item, p_partkey + 20 AS to_vocabulary_item FROM part
WHERE p_partkey % 220 < 200 AND p_partkey + 20 <= (SELECT MAX(p_partkey) FROM part)"""
VIEWS["nation_items"] = """
SELECT n_nationkey AS value, n_name AS code, r_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey"""


def needed(text: str) -> list[str]:
    """Views a SQL text refers to, in the order they must be defined."""
    found: list[str] = []
    for word in re.findall(r"[a-z_]+", text):
        if word in VIEWS and word not in found and re.search(rf"(FROM|JOIN)\s+{word}\b", text):
            found += [name for name in needed(VIEWS[word]) if name not in found]
            found.append(word)
    return found


def with_views(body: str) -> str:
    """The text with the views it uses put in front as common table expressions."""
    names = needed(body)
    if not names:
        return body
    ctes = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    recursive = re.match(r"\s*WITH\s+RECURSIVE\s+", body)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {body[recursive.end():]}"
    plain = re.match(r"\s*WITH\s+", body)
    return f"WITH {ctes}, {body[plain.end():]}" if plain else f"WITH {ctes} {body}"


class Inputs:
    """Tables and views of one scale factor as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def sql(self, body: str) -> DataFrame:
        text = with_views(body)
        for name in TABLES:
            if re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
