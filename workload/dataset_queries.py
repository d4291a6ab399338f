"""Readers, writers, file manifests and whole jobs, through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.plans.jobs import eav_to_dataset, load_query, query_to_dataset, register_study
from studylake.plans.store import StudyLake
from studylake.session import local_rows, scratch_path
from studylake.sources import files, readers, writers
from studylake.types import DATETIME, FLOAT, INTEGER, STRING, Variable
from workload.dictionary_queries import legal_sql
from workload.eav_queries import EAV_VARIABLES, FIELDS, TYPED, WIDE
from workload.registry import query

# --- readers --------------------------------------------------------------------------------------------------

@query("scan_eav_csv", "SELECT record, field_name, value FROM eav")
def _(x):
    path = scratch_path(x.spark, "eav-csv")
    writers.export_csv(x.eav.select("value", "record", F.lit(1).alias("extra"), "field_name"), path)
    return readers.scan_eav_csv(x.spark, path)


# Letters of ISO-8859-2 that the documents use; everything else outside ASCII becomes a question mark.
LATIN2 = "áâäçéëíîóôöúüßÁÂÄÇÉËÍÎÓÔÖÚÜ"
LATIN2_TEXTS = rf"""SELECT CAST(doc_id AS STRING) AS record, lang AS field_name, translate(text, 'èêàùûïñãõåøæœ¿¡', 'eeauuinaoaoaoo!') AS value FROM documents"""


@query(
    "scan_eav_transcode",
    f"SELECT record, field_name, regexp_replace(value, '[^\\x01-\\x7F{LATIN2}]', '?', 'g') AS value FROM ({LATIN2_TEXTS}) t",
)
def _(x):
    # The file is written byte by byte: each Latin-2 byte as the Latin-1 character of the same number.
    high = bytes(range(0xA0, 0x100))
    as_bytes = F.translate("value", high.decode("iso8859-2"), high.decode("latin-1"))
    rows = x.sql(LATIN2_TEXTS).withColumn("value", F.regexp_replace("value", rf"[^\x01-\x7F{LATIN2}]", "?"))
    path = scratch_path(x.spark, "eav-latin2")
    rows.select("record", "field_name", as_bytes.alias("value")).write.options(
        header=True, escape='"', encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return readers.scan_eav_transcode(x.spark, path)


@query(
    "scan_dictionary_json",
    """SELECT field_name, form_name, field_type, text_validation_type_or_show_slider_number, select_choices_or_calculations, field_label, field_note
    FROM dictionary WHERE form_name IN ('Brand#3', 'Brand#4', 'Brand#5')""",
)
def _(x):
    path = scratch_path(x.spark, "dictionary-json")
    x.dictionary.drop("ord").write.json(path)
    return readers.scan_dictionary_json(x.spark, path, ["Brand#3", "Brand#4", "Brand#5"], multi_line=False).drop("ord")


@query("get_table", "SELECT * FROM orders")
def _(x):
    x.orders.createOrReplaceTempView("orders")
    return readers.get_table(x.spark, "orders")


@query(
    "select_where_eq",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
)
def _(x):
    return readers.select_where_eq(
        x.lineitem, ["l_orderkey", "l_partkey", "l_quantity"], {"l_returnflag": "R", "l_linestatus": "F"}
    )


# --- writers --------------------------------------------------------------------------------------------------

ORDER_VARIABLES = [
    Variable("o_orderdate", DATETIME), Variable("o_orderstatus", STRING), Variable("o_orderkey", INTEGER),
    Variable("o_totalprice", FLOAT),
]


@query("load_query", "SELECT o_orderdate, o_orderstatus, CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice FROM orders")
def _(x):
    x.orders.createOrReplaceTempView("orders")
    lake = StudyLake(x.spark, scratch_path(x.spark, "lake"))
    return load_query(lake, "SELECT * FROM orders", ORDER_VARIABLES, f"{lake.root}/data/orders")


@query("append_rows", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT c_custkey, c_name FROM customer")
def _(x):
    path = scratch_path(x.spark, "append")
    x.sql("SELECT s_suppkey AS id, s_name AS name FROM supplier").write.parquet(path)
    table = x.spark.read.parquet(path)
    writers.append_rows(x.sql("SELECT n_name AS name, n_nationkey AS id FROM nation"), table, path)
    writers.append_rows(x.sql("SELECT c_name AS name, c_custkey AS id FROM customer"), table, path)
    return x.spark.read.schema(table.schema).parquet(path)


@query("export_csv", "SELECT doc_id, text, lang FROM documents")
def _(x):
    path = scratch_path(x.spark, "export-csv")
    rows = x.documents.select("doc_id", "text", "lang")
    writers.export_csv(rows, path, compress=True)
    return x.spark.read.schema(rows.schema).options(header=True, escape='"', multiLine=True).csv(path)


@query("export_columnar", "SELECT * FROM orders")
def _(x):
    path = scratch_path(x.spark, "export-columnar")
    writers.export_columnar(x.orders, path)
    return x.spark.read.parquet(path)


EVENT_VARIABLES = [
    Variable("user_id", INTEGER), Variable("event_type", STRING), Variable("ts", DATETIME), Variable("value", FLOAT),
]


@query("create_schema_table", "SELECT CAST(user_id AS INTEGER) AS user_id, event_type, ts, value FROM events")
def _(x):
    path = scratch_path(x.spark, "table")
    schema = writers.table_schema(EVENT_VARIABLES)
    local_rows(x.spark, [], schema).write.parquet(path)
    writers.append_rows(x.events.select("value", "ts", "user_id", "event_type"), x.spark.read.schema(schema).parquet(path), path)
    return x.spark.read.schema(schema).parquet(path)


# --- files ----------------------------------------------------------------------------------------------------

KNOWN_FILES = "SELECT MIN(doc_id) AS asset_id, CONCAT(lang, '_', source) AS name FROM documents WHERE lang IN ('de', 'en') GROUP BY lang, source"


@query(
    "file_manifest",
    f"""WITH f AS (SELECT lang || '_' || source AS name, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY lang, source),
    latest AS (SELECT asset_id, MAX(major * 10000 + minor * 100 + patch) AS v FROM cat_versions GROUP BY asset_id),
    m AS (SELECT k.asset_id, {legal_sql(True, 'f.name')} AS asset_name, '.txt' AS extension, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS digest,
      'http://edamontology.org/format_2330' AS edam_format, CAST(COALESCE(v // 10000, 1) AS INTEGER) AS major,
      CAST(COALESCE(v // 100 % 100, 0) AS INTEGER) AS minor, CAST(COALESCE(v % 100 + 1, 0) AS INTEGER) AS patch
      FROM f LEFT JOIN ({KNOWN_FILES}) k ON k.name = f.name LEFT JOIN latest l ON l.asset_id = k.asset_id)
    SELECT *, 'files/lang_study/' || asset_name || '_' || major || '_' || minor || '_' || patch || '.txt' AS lake_path FROM m""",
)
def _(x):
    path = scratch_path(x.spark, "files")
    texts = x.documents.select("lang", "source", "doc_id", "text").repartition("lang", "source")
    texts.sortWithinPartitions("lang", "source", "doc_id").drop("doc_id").write.partitionBy("lang", "source").text(path)
    found = files.scan_files(x.spark, path).where("extension = '.txt'")
    place = r"lang=([^/]+)/source=([^/]+)/"
    named = found.withColumn(
        "file_name",
        F.concat(F.regexp_extract("storage_uri", place, 1), F.lit("_"), F.regexp_extract("storage_uri", place, 2), F.lit(".txt")),
    )
    return files.file_manifest(named, x.sql(KNOWN_FILES), x.cat_versions, "lang_study").drop("storage_uri")


@query(
    "verify_digests",
    """SELECT 'doc/' || doc_id AS storage_uri, CASE WHEN lang = 'fr' THEN 'missing' WHEN lang = 'de' THEN 'changed' ELSE 'unregistered' END AS status
    FROM documents WHERE lang IN ('fr', 'de', 'es')""",
)
def _(x):
    uri = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("storage_uri")
    stored = x.documents.where("lang <> 'es'").select(uri, F.upper(F.sha2("text", 256)).alias("digest"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    actual = x.documents.where("lang <> 'fr'").select(uri, F.sha2(changed, 256).alias("digest"))
    return files.verify_digests(stored, actual)


# --- whole jobs -----------------------------------------------------------------------------------------------

def _lake(x) -> StudyLake:
    """A fresh lake with one study, whose domain describes the fields of the EAV view."""
    lake = StudyLake(x.spark, scratch_path(x.spark, "lake"))
    register_study(lake, "Customer study", 3, ["customers"])
    rows = [(i + 1, 1, v.name, v.value_type_id, v.value_format) for i, v in enumerate(EAV_VARIABLES)]
    variables = local_rows(
        x.spark, rows, "variable_id bigint, domain_id bigint, name string, value_type_id int, value_format string"
    )
    empty = lake.table("variables")
    lake.commit({"variables": empty.unionByName(variables.withColumn("keyrole", F.lit("none")), allowMissingColumns=True)})
    return lake


@query("eav_to_dataset", TYPED)
def _(x):
    lake = _lake(x)
    eav_to_dataset(lake, "Customer study", "customers_eav", rows=x.eav)
    return lake.read_dataset("Customer study", "customers")


@query("eav_to_dataset_incremental", TYPED)
def _(x):
    # The first version lacks some records, holds others that go, and has old values of a third kind.
    lake = _lake(x)
    before = x.sql(
        "SELECT record, field_name, CASE WHEN CAST(record AS INT) % 7 = 3 AND field_name = 'mktsegment' THEN 'old' ELSE value END AS value "
        "FROM eav WHERE CAST(record AS INT) % 5 <> 2 UNION ALL SELECT CONCAT('9000000', record), field_name, value FROM eav WHERE record = '1'"
    )
    eav_to_dataset(lake, "Customer study", "customers_eav", rows=before)
    eav_to_dataset(lake, "Customer study", "customers_eav", rows=x.eav, incremental=True)
    return lake.read_dataset("Customer study", "customers")


@query("eav_to_dataset_raw", WIDE)
def _(x):
    lake = _lake(x)
    return eav_to_dataset(lake, "Customer study", "customers_eav", rows=x.eav, convert=False).select("record", *FIELDS)


COUNTED = "SELECT o_custkey, o_orderstatus, COUNT(*) AS n, MAX(o_orderdate) AS latest FROM orders GROUP BY o_custkey, o_orderstatus"


@query("query_to_dataset", COUNTED)
def _(x):
    lake = _lake(x)
    x.orders.createOrReplaceTempView("orders")
    query_to_dataset(lake, "Customer study", 1, "order_counts", COUNTED)
    return lake.read_dataset("Customer study", "order_counts", (1, 0, 0))


@query("read_dataset", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(x):
    lake = _lake(x)
    x.customer.createOrReplaceTempView("customer")
    query_to_dataset(lake, "Customer study", 1, "people", "SELECT c_custkey, c_name FROM customer")
    query_to_dataset(lake, "Customer study", 1, "people", "SELECT c_custkey, c_name, c_mktsegment FROM customer", replace=True)
    return lake.read_dataset("Customer study", "people")
