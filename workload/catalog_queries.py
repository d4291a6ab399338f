"""Catalog operators: state changes, lookups, versions, constraints and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake import types as VT
from studylake.operators import catalog as cat
from studylake.session import spread
from workload.dictionary_queries import items_text, legal_sql
from workload.registry import query

KEYS = ["domain_id", "name"]
ATTRIBUTES = ["value_type_id", "description"]
LAST = "SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY domain_id, name ORDER BY ord DESC) AS r FROM new_names) t WHERE r = 1"
KEY = "'=' || domain_id || '|=' || name"
FRESH = f"""SELECT (SELECT MAX(variable_id) FROM old_names) + ROW_NUMBER() OVER (ORDER BY substr(md5({KEY}), 1, 3), {KEY}) AS variable_id,
domain_id, name, value_type_id, description FROM ({LAST}) l WHERE (domain_id, name) NOT IN (SELECT (domain_id, name) FROM old_names)"""


@query(
    "upsert_by_key",
    f"""SELECT o.variable_id, o.domain_id, o.name, CASE WHEN l.name IS NULL THEN o.value_type_id ELSE l.value_type_id END AS value_type_id,
    CASE WHEN l.name IS NULL THEN o.description ELSE l.description END AS description
    FROM old_names o LEFT JOIN ({LAST}) l ON l.domain_id = o.domain_id AND l.name = o.name UNION ALL {FRESH}""",
)
def _(x):
    return cat.upsert_by_key(x.old_names, x.new_names, KEYS, "variable_id", ATTRIBUTES, "ord")


@query("insert_if_absent", f"SELECT variable_id, domain_id, name, value_type_id, description FROM old_names UNION ALL {FRESH}")
def _(x):
    return cat.insert_if_absent(x.old_names, x.new_names, KEYS, "variable_id", ATTRIBUTES, "ord")


@query(
    "assign_ids",
    """SELECT 500 + ROW_NUMBER() OVER (ORDER BY substr(md5('=' || l_orderkey || '|=' || l_suppkey), 1, 3), '=' || l_orderkey || '|=' || l_suppkey) AS id,
    l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) t""",
)
def _(x):
    pairs = x.lineitem.select("l_orderkey", "l_suppkey").distinct()
    start = x.sql("SELECT 500 + MIN(r_regionkey) AS id FROM region")
    return cat.assign_ids(pairs, ["l_orderkey", "l_suppkey"], "id", start)


RELOAD = "SELECT DISTINCT p_type AS vocabulary, p_size AS value, CONCAT('size ', CAST(p_size AS STRING)) AS code FROM part WHERE p_type IN ('PROMO', 'SMALL')"


@query(
    "replace_children",
    f"SELECT * FROM cat_vocabulary_items WHERE vocabulary NOT IN (SELECT vocabulary FROM ({RELOAD}) r) UNION ALL {RELOAD}",
)
def _(x):
    return cat.replace_children(x.cat_vocabulary_items, x.sql(RELOAD), "vocabulary")


LINKS = "SELECT s_nationkey AS study_id, CAST(s_suppkey % 5 AS INT) AS domain_id FROM supplier"


@query("link_if_absent", f"SELECT * FROM cat_study_domains UNION {LINKS}")
def _(x):
    return cat.link_if_absent(x.cat_study_domains, x.sql(LINKS), ["study_id", "domain_id"])


CHANGES = """SELECT l_partkey AS variable_id, CASE WHEN COUNT(*) > 30 THEN COUNT(DISTINCT l_suppkey) END AS value_type_id FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_partkey"""


@query(
    "update_by_key",
    f"""SELECT v.variable_id, domain_id, name, CASE WHEN c.variable_id IS NULL THEN v.value_type_id ELSE c.value_type_id END AS value_type_id, vocabulary
    FROM cat_variables v LEFT JOIN ({CHANGES}) c ON c.variable_id = v.variable_id""",
)
def _(x):
    return cat.update_by_key(x.cat_variables, x.sql(CHANGES), ["variable_id"], ["value_type_id"])


WANTED = "SELECT s_nationkey AS study_id, CONCAT('Customer#', LPAD(CAST(s_suppkey AS STRING), 9, '0')) AS name FROM supplier"


@query(
    "lookup_by_key",
    f"""SELECT w.study_id, w.name, a.asset_id, a.asset_type, a.asset_id IS NOT NULL AS found
    FROM (SELECT DISTINCT * FROM ({WANTED}) d) w LEFT JOIN cat_assets a ON a.study_id = w.study_id AND a.name = w.name""",
)
def _(x):
    return cat.lookup_by_key(x.cat_assets, x.sql(WANTED), ["study_id", "name"])


SCOPED = "SELECT MIN(p_partkey) AS vocabulary_id, p_size % 5 AS domain_id, CONCAT(p_type, ' ', p_brand) AS name FROM part GROUP BY 2, 3"


@query(
    "lookup_unique_name",
    f"""SELECT name, COUNT(*) AS n_domains, CASE WHEN COUNT(*) = 1 THEN MIN(vocabulary_id) END AS vocabulary_id, COUNT(*) > 1 AS ambiguous
    FROM ({SCOPED}) v GROUP BY name""",
)
def _(x):
    return cat.lookup_unique_name(x.sql(SCOPED))


# --- versions -------------------------------------------------------------------------------------------------

LATEST = """SELECT version_id, asset_id, major, minor, patch, created_at, is_latest FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id
ORDER BY COALESCE(is_latest, FALSE) DESC, major DESC, minor DESC, patch DESC, version_id DESC) AS r FROM raw_versions) t WHERE r = 1"""


@query("latest_versions", LATEST)
def _(x):
    return cat.latest_versions(x.raw_versions)


REQUESTS = """SELECT c_custkey AS asset_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'major' WHEN 'MACHINERY' THEN 'minor' WHEN 'HOUSEHOLD' THEN 'patch' END AS bump
FROM customer UNION ALL SELECT s_suppkey + 100000000, 'minor' FROM supplier"""


@query(
    "next_versions",
    f"""SELECT r.asset_id, CASE WHEN l.asset_id IS NULL THEN 1 WHEN bump = 'major' THEN major + 1 ELSE major END AS major,
    CASE WHEN l.asset_id IS NULL OR bump = 'major' THEN 0 WHEN bump = 'minor' THEN minor + 1 ELSE minor END AS minor,
    CASE WHEN l.asset_id IS NULL OR bump IN ('major', 'minor') THEN 0 ELSE patch + 1 END AS patch
    FROM ({REQUESTS}) r LEFT JOIN ({LATEST}) l ON l.asset_id = r.asset_id""",
)
def _(x):
    return cat.next_versions(x.sql(REQUESTS), x.raw_versions)


@query(
    "set_latest",
    """SELECT version_id, asset_id, major, minor, patch, created_at,
    ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY created_at DESC, major DESC, minor DESC, patch DESC, version_id DESC) = 1 AS is_latest
    FROM raw_versions""",
)
def _(x):
    return cat.set_latest(x.raw_versions)


@query(
    "version_history",
    "SELECT *, 'v' || major || '.' || minor || '.' || patch AS version_label FROM cat_versions",
)
def _(x):
    return cat.version_history(x.cat_versions)


@query(
    "dataset_names",
    f"""SELECT version_id, {legal_sql(True, 's.name')} || '.' || {legal_sql(True, 'a.name')} || '_' || major || '_' || minor || '_' || patch AS table_name
    FROM cat_versions v JOIN cat_assets a ON a.asset_id = v.asset_id JOIN cat_studies s ON s.study_id = a.study_id WHERE asset_type = 'dataset'""",
)
def _(x):
    return cat.dataset_names(x.cat_studies, x.cat_assets, x.cat_versions)


# --- constraints ----------------------------------------------------------------------------------------------

LOOSE_DOMAINS = """SELECT domain_id, name, uri FROM cat_domains UNION ALL SELECT n_regionkey + 10, CONCAT('D', CAST(n_regionkey AS STRING)),
CASE WHEN n_nationkey > 12 THEN n_name END FROM nation"""
LOOSE_ACCESS = "SELECT s_nationkey + 3 AS study_id, CONCAT('user', CAST(s_suppkey % 7 AS STRING)) AS user_id, 'read' AS access_level FROM supplier"
LOOSE_VERSIONS = """SELECT version_id, asset_id + 20 AS asset_id, major, minor, CASE WHEN major > 6 THEN 0 ELSE patch END AS patch, created_at,
is_latest OR minor = 12 AS is_latest FROM cat_versions"""

LOOSE_VARIABLES = """SELECT variable_id, domain_id, name, value_type_id + 1 AS value_type_id, CAST(NULL AS BIGINT) AS vocabulary_id,
CASE variable_id % 50 WHEN 7 THEN 'recrod' WHEN 8 THEN 'record' WHEN 9 THEN CAST(NULL AS STRING) ELSE 'none' END AS keyrole FROM cat_variables"""


def _duplicates(check: str, table: str, label: str, keys: str) -> str:
    return f"SELECT '{check}' AS violation, {label} AS key, COUNT(*) AS n FROM ({table}) t GROUP BY {keys} HAVING COUNT(*) > 1"


def _orphans(check: str, table: str, key: str, parents: str, parent_key: str) -> str:
    return (
        f"SELECT '{check}' AS violation, CAST({key} AS VARCHAR) AS key, COUNT(*) AS n FROM ({table}) t "
        f"WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM ({parents}) p) GROUP BY {key}"
    )


VIOLATIONS = " UNION ALL ".join([
    _duplicates("duplicate domains", LOOSE_DOMAINS, "name || '|' || COALESCE(uri, 'NULL')", "name, uri"),
    _duplicates("duplicate study_access", LOOSE_ACCESS, "study_id || '|' || user_id", "study_id, user_id"),
    _duplicates("duplicate asset_versions", LOOSE_VERSIONS, "asset_id || '|' || major || '|' || minor || '|' || patch", "asset_id, major, minor, patch"),
    _orphans("orphan study_access.study_id", LOOSE_ACCESS, "study_id", "SELECT * FROM cat_studies", "study_id"),
    _orphans("orphan asset_versions.asset_id", LOOSE_VERSIONS, "asset_id", "SELECT * FROM cat_assets", "asset_id"),
    f"SELECT 'unknown variables.value_type_id', '9', COUNT(*) FROM ({LOOSE_VARIABLES}) v WHERE value_type_id = 9 HAVING COUNT(*) > 0",
    f"SELECT 'unknown variables.keyrole', 'recrod', COUNT(*) FROM ({LOOSE_VARIABLES}) v WHERE keyrole = 'recrod' HAVING COUNT(*) > 0",
    f"SELECT 'several latest versions', CAST(asset_id AS VARCHAR), COUNT(*) FROM ({LOOSE_VERSIONS}) v WHERE is_latest GROUP BY asset_id HAVING COUNT(*) > 1",
    f"""SELECT 'version number changed', CAST(b.version_id AS VARCHAR), COUNT(*) FROM ({LOOSE_VERSIONS}) a JOIN cat_versions b ON a.version_id = b.version_id
    WHERE a.patch <> b.patch GROUP BY b.version_id""",
])


@query("constraint_violations", VIOLATIONS)
def _(x):
    tables = {
        "domains": x.sql(LOOSE_DOMAINS), "studies": x.cat_studies, "study_domains": x.cat_study_domains,
        "study_access": x.sql(LOOSE_ACCESS), "assets": x.cat_assets, "asset_versions": x.sql(LOOSE_VERSIONS),
        "variables": x.sql(LOOSE_VARIABLES),
        "transformations": x.cat_transformations, "transformation_inputs": x.cat_inputs,
        "transformation_outputs": x.cat_outputs,
    }
    return cat.constraint_violations(tables, x.cat_versions)


TOUCHED_VERSIONS = f"SELECT * FROM ({LOOSE_VERSIONS}) v WHERE asset_id % 10 = 3"


@query(
    "constraint_violations_of_changes",
    " UNION ALL ".join([
        f"""SELECT 'duplicate asset_versions' AS violation, asset_id || '|' || major || '|' || minor || '|' || patch AS key, COUNT(*) AS n
        FROM ({LOOSE_VERSIONS}) v GROUP BY asset_id, major, minor, patch HAVING COUNT(*) > 1 AND asset_id % 10 = 3""",
        f"""SELECT 'orphan asset_versions.asset_id', CAST(asset_id AS VARCHAR), COUNT(*) FROM ({LOOSE_VERSIONS}) v
        WHERE asset_id % 10 = 3 AND asset_id NOT IN (SELECT asset_id FROM cat_assets) GROUP BY asset_id""",
        f"""SELECT 'several latest versions', CAST(asset_id AS VARCHAR), COUNT(*) FROM ({LOOSE_VERSIONS}) v
        WHERE is_latest AND asset_id % 10 = 3 GROUP BY asset_id HAVING COUNT(*) > 1""",
    ]),
)
def _(x):
    tables = {"assets": x.cat_assets, "asset_versions": x.sql(LOOSE_VERSIONS)}
    return cat.constraint_violations(tables, changed=["asset_versions"], touched={"asset_versions": x.sql(TOUCHED_VERSIONS)})


# --- studies, assets, variables -------------------------------------------------------------------------------

@query("list_ordered", "SELECT variable_id, domain_id, name FROM cat_variables WHERE domain_id = 2")
def _(x):
    return cat.list_ordered(x.cat_variables, "variable_id", "domain_id", "name", where=F.col("domain_id") == 2)


SUPPLIER_LINKS = "SELECT DISTINCT l_suppkey AS study_id, CAST(l_partkey % 5 AS INT) AS domain_id FROM lineitem"


@query("study_domains", f"SELECT study_id, d.domain_id, name, uri FROM ({SUPPLIER_LINKS}) l JOIN cat_domains d ON d.domain_id = l.domain_id")
def _(x):
    return cat.study_domains(x.sql(SUPPLIER_LINKS), x.cat_domains)


@query(
    "study_assets_latest",
    """SELECT a.asset_id, study_id, name, asset_type, version_id, major, minor, patch, 'v' || major || '.' || minor || '.' || patch AS version_label, created_at
    FROM cat_assets a JOIN cat_versions v ON v.asset_id = a.asset_id WHERE is_latest""",
)
def _(x):
    return cat.study_assets_latest(x.cat_assets, x.cat_versions)


@query(
    "study_datasets",
    f"""SELECT a.asset_id, study_id, name, version_id, major, minor, patch FROM cat_assets a JOIN ({LATEST}) v ON v.asset_id = a.asset_id
    WHERE asset_type = 'dataset'""",
)
def _(x):
    return cat.study_versions(x.cat_assets, x.raw_versions, "dataset")


@query(
    "study_files",
    """SELECT a.asset_id, study_id, name, version_id, major, minor, patch FROM cat_assets a JOIN raw_versions v ON v.asset_id = a.asset_id
    WHERE asset_type = 'file'""",
)
def _(x):
    return cat.study_versions(x.cat_assets, x.raw_versions, "file", include_versions=True)


@query(
    "study_datasets_with_variables",
    f"""SELECT a.asset_id, study_id, name, v.version_id, major, minor, patch, variable_id FROM cat_assets a JOIN ({LATEST}) v ON v.asset_id = a.asset_id
    LEFT JOIN cat_dataset_variables d ON d.version_id = v.version_id WHERE asset_type = 'dataset'""",
)
def _(x):
    return cat.study_versions(x.cat_assets, x.raw_versions, "dataset", details=x.cat_dataset_variables)


@query(
    "datasets_described",
    f"""SELECT a.asset_id, study_id, a.name, v.version_id, major, minor, patch, COUNT(d.variable_id) AS n_variables,
    COALESCE(string_agg(x.name || ':' || x.value_type_id, '; ' ORDER BY d.variable_id % 3, x.name), '') AS variables
    FROM cat_assets a JOIN ({LATEST}) v ON v.asset_id = a.asset_id LEFT JOIN cat_dataset_variables d ON d.version_id = v.version_id
    LEFT JOIN cat_variables x ON x.variable_id = d.variable_id WHERE asset_type = 'dataset' GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def _(x):
    links = x.cat_dataset_variables.withColumn("ordinal", (F.col("variable_id") % 3).cast("int"))
    found = cat.datasets_described(x.cat_assets, x.raw_versions, links, x.cat_variables)
    text = F.array_join(F.transform("variables", lambda v: F.concat(v["name"], F.lit(":"), v["value_type_id"].cast("string"))), "; ")
    return found.withColumns({"n_variables": F.size("variables").cast("bigint"), "variables": text})


VOCABULARIES = "SELECT DISTINCT p_type AS vocabulary FROM part UNION SELECT p_brand FROM part"


@query(
    "vocabulary_items_nested",
    f"""SELECT v.vocabulary, COUNT(value) AS n_items, COALESCE(string_agg(value || ':' || code, '; ' ORDER BY value), '') AS items
    FROM ({VOCABULARIES}) v LEFT JOIN cat_vocabulary_items i ON i.vocabulary = v.vocabulary GROUP BY v.vocabulary""",
)
def _(x):
    items = x.cat_vocabulary_items.withColumn("description", F.lit(None).cast("string"))
    nested = cat.vocabulary_items_nested(x.sql(VOCABULARIES), items, "vocabulary")
    return nested.select("vocabulary", F.size("items").cast("bigint").alias("n_items"), items_text().alias("items"))


ITEM_LISTS = "SELECT vocabulary, string_agg(value || ':' || code, '; ' ORDER BY value) AS items FROM cat_vocabulary_items GROUP BY vocabulary"


def _listed(found):
    """The nested items as one text."""
    texts = F.transform("items", lambda i: F.concat_ws(":", i["value"].cast("string"), i["code"]))
    return found.withColumn("items", F.array_join(texts, "; "))


def _nested(x):
    items = x.cat_vocabulary_items.withColumn("description", F.lit(None).cast("string"))
    return cat.vocabulary_items_nested(items.select("vocabulary").distinct(), items, key="vocabulary")


def _variables_sql(where: str) -> str:
    return f"""SELECT v.*, COALESCE(items, '') AS items FROM cat_variables v LEFT JOIN ({ITEM_LISTS}) i ON i.vocabulary = v.vocabulary
    WHERE domain_id IN (SELECT domain_id FROM cat_study_domains WHERE {where})"""


@query("study_variables", _variables_sql("study_id = 7"))
def _(x):
    found = cat.study_variables(x.cat_variables, x.cat_study_domains, study_id=7, vocabularies=_nested(x), key="vocabulary")
    return _listed(found)


@query("study_variables_in_domain", _variables_sql("domain_id = 3"))
def _(x):
    found = cat.study_variables(x.cat_variables, x.cat_study_domains, domain_id=3, vocabularies=_nested(x), key="vocabulary")
    return _listed(found)


@query(
    "dataset_variables",
    f"""SELECT version_id, v.variable_id, domain_id, name, value_type_id, v.vocabulary, COALESCE(items, '') AS items FROM cat_dataset_variables l
    JOIN cat_variables v ON v.variable_id = l.variable_id LEFT JOIN ({ITEM_LISTS}) i ON i.vocabulary = v.vocabulary""",
)
def _(x):
    return _listed(cat.dataset_variables(x.cat_dataset_variables, x.cat_variables, _nested(x), "vocabulary"))


# --- provenance -----------------------------------------------------------------------------------------------

@query(
    "study_transformations",
    """SELECT study_id, t.transformation_id, transformation_type, description FROM cat_transformations t JOIN (
      SELECT study_id, transformation_id FROM cat_inputs e JOIN cat_versions v ON v.version_id = e.version_id JOIN cat_assets a ON a.asset_id = v.asset_id
      UNION SELECT study_id, transformation_id FROM cat_outputs e JOIN cat_versions v ON v.version_id = e.version_id JOIN cat_assets a ON a.asset_id = v.asset_id
    ) l ON l.transformation_id = t.transformation_id""",
)
def _(x):
    return cat.study_transformations(
        x.cat_transformations, x.cat_inputs, x.cat_outputs, x.cat_versions, x.cat_assets, ["transformation_id"]
    )


@query(
    "record_provenance",
    """SELECT transformation_type, COUNT(DISTINCT t.transformation_id) AS n, COUNT(DISTINCT i.version_id) AS n_inputs, COUNT(DISTINCT o.version_id) AS n_outputs
    FROM (SELECT transformation_id, transformation_type FROM cat_transformations UNION ALL SELECT transformation_id + 1000000, transformation_type FROM cat_transformations) t
    LEFT JOIN (SELECT * FROM cat_inputs UNION SELECT transformation_id + 1000000, version_id FROM cat_outputs) i ON i.transformation_id = t.transformation_id
    LEFT JOIN (SELECT * FROM cat_outputs) o ON o.transformation_id = t.transformation_id GROUP BY transformation_type""",
)
def _(x):
    existing = {
        "transformations": x.cat_transformations, "transformation_inputs": x.cat_inputs, "transformation_outputs": x.cat_outputs,
    }
    shifted = (F.col("transformation_id") + 1_000_000).alias("transformation_id")
    new = cat.record_provenance(
        existing, x.cat_transformations.select(shifted, "transformation_type", "description"),
        x.cat_outputs.select(shifted, "version_id"), x.cat_outputs,
    )
    kinds = new["transformations"].select("transformation_type", "transformation_id")
    edges = [
        new[f"transformation_{name}"].select("transformation_id", F.lit(name).alias("counted"), F.col("version_id").alias("value"))
        for name in ("inputs", "outputs")
    ]
    edges = kinds.join(edges[0].unionByName(edges[1]), "transformation_id").select("transformation_type", "counted", "value")
    ids = kinds.select("transformation_type", F.lit("ids").alias("counted"), F.col("transformation_id").alias("value"))
    # Each value once, in one grouping of narrow rows: three distinct counts side by side would copy every row three times.
    each = spread(edges.unionByName(ids), "transformation_type", "counted", "value").distinct()
    return each.groupBy("transformation_type").agg(
        *[F.count(F.when(F.col("counted") == name, F.col("value"))).alias(out) for name, out in (("ids", "n"), ("inputs", "n_inputs"), ("outputs", "n_outputs"))]
    )


@query(
    "lineage",
    """WITH RECURSIVE walk AS (SELECT version_id AS seed_id, version_id, 0 AS depth FROM chain_seeds
      UNION ALL SELECT seed_id, i.version_id, depth + 1 FROM walk JOIN chain_outputs o ON o.version_id = walk.version_id
      JOIN chain_inputs i ON i.transformation_id = o.transformation_id)
    SELECT seed_id, version_id, depth FROM walk WHERE depth > 0""",
)
def _(x):
    return cat.lineage(x.chain_seeds, x.chain_inputs, x.chain_outputs)


# The seeded value types.
VALUE_TYPE_ROWS = """(1, 'xsd:integer', 'integer'), (2, 'xsd:float', 'float'), (3, 'xsd:string', 'string'), (4, 'xsd:date', 'ISO Date yyyy-mm-dd'),
(5, 'xsd:dateTime', 'ISO Datetime yyyy-mm-ddTHH:mm:ss.sss'), (6, 'xsd:time', 'ISO Time HH:mm:ss.sss'),
(7, 'enumeration', 'Category represented by a Vocabulary with integer value and string code, stored as Integer'),
(8, 'multiresponse', 'Multi-response enumeration with multiple values, stored as an array of integers')"""


@query(
    "seed_types",
    f"""SELECT t.value_type_id, value_type, t.description, COUNT(variable_id) AS n_variables
    FROM (VALUES {VALUE_TYPE_ROWS}) AS t(value_type_id, value_type, description) LEFT JOIN cat_variables v ON v.value_type_id = t.value_type_id
    GROUP BY t.value_type_id, value_type, t.description""",
)
def _(x):
    return cat.value_type_usage(x.cat_variables)


STUDY_TYPE_ROWS = ",\n".join(f"({i}, '{name}', '{text}', '{space}', '{kind}')" for i, name, text, space, kind in VT.STUDY_TYPES)


SUPPLIER_STUDIES = "SELECT s_suppkey AS study_id, s_name AS name, s_nationkey + 1 AS study_type_id FROM supplier"


@query(
    "seed_study_types",
    f"""SELECT t.study_type_id, t.name, t.description, t.namespace, t.ontology_class, COUNT(s.study_id) AS n_studies
    FROM (VALUES {STUDY_TYPE_ROWS}) AS t(study_type_id, name, description, namespace, ontology_class)
    LEFT JOIN ({SUPPLIER_STUDIES}) s ON s.study_type_id = t.study_type_id
    GROUP BY t.study_type_id, t.name, t.description, t.namespace, t.ontology_class""",
)
def _(x):
    return cat.study_type_usage(x.sql(SUPPLIER_STUDIES))
