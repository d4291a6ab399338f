"""Harmonisation, entities, access, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import harmonize as har
from studylake.operators.reconcile import row_differences, row_differences_by_bucket, void_to_string
from workload.registry import query

RULES = [
    har.MappingRule("solvent", "c_acctbal", "gt", "0"),
    har.MappingRule("solvent", "c_acctbal", "eq", "0"),
    har.MappingRule("middle", "c_nationkey", "between", "5, 10"),
    har.MappingRule("segment", "c_mktsegment", "map", "BUILDING=1|MACHINERY = 2|HOUSEHOLD=3"),
    har.MappingRule("round_name", "c_name", "contains", "00"),
    har.MappingRule("rich_abroad", "c_acctbal", "ge", "5000", prerequisite="c_nationkey"),
    har.MappingRule("poor", "c_acctbal", "lt", "1000"),
    har.MappingRule("not_first", "c_nationkey", "ne", "0"),
    har.MappingRule("early", "c_nationkey", "le", "3"),
]


@query(
    "apply_variable_mapping",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN '1' ELSE '0' END AS solvent,
    CASE WHEN c_nationkey BETWEEN 5 AND 10 THEN '1' ELSE '0' END AS middle,
    CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' WHEN 'HOUSEHOLD' THEN '3' END AS segment,
    CASE WHEN c_name LIKE '%00%' THEN '1' ELSE '0' END AS round_name,
    CASE WHEN c_nationkey = 0 THEN NULL WHEN c_acctbal >= 5000 THEN '1' ELSE '0' END AS rich_abroad,
    CASE WHEN c_acctbal < 1000 THEN '1' ELSE '0' END AS poor, CASE WHEN c_nationkey <> 0 THEN '1' ELSE '0' END AS not_first,
    CASE WHEN c_nationkey <= 3 THEN '1' ELSE '0' END AS early FROM customer""",
)
def _(x):
    return har.apply_variable_mapping(x.customer, RULES, ["c_custkey"])


PRIORITIES = "SELECT o_orderkey, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS priority FROM orders"


@query("recode_vocabulary", f"SELECT o_orderkey, priority, CASE WHEN priority < 5 THEN priority * 10 END AS rank FROM ({PRIORITIES}) p")
def _(x):
    return har.recode_vocabulary(x.sql(PRIORITIES), "priority", x.item_mapping, x.priority_items, x.rank_items, "rank")


# Items 20 apart are the same from a multiple of 220 up to the next.
CLASSES = """SELECT vocabulary_item_id, vocabulary_id, value, vocabulary_item_id - 20 * ((vocabulary_item_id % 220) // 20) AS class_id
FROM part_items"""


@query("item_classes", CLASSES)
def _(x):
    return har.item_classes(x.part_items, x.part_mapping)


@query(
    "class_conflicts",
    f"""SELECT class_id, vocabulary_id, COUNT(*) AS n_items, MIN(vocabulary_item_id) AS first_item, MAX(vocabulary_item_id) AS last_item
    FROM ({CLASSES}) c GROUP BY class_id, vocabulary_id HAVING COUNT(*) > 1""",
)
def _(x):
    return har.class_conflicts(har.item_classes(x.part_items, x.part_mapping))


@query(
    "class_representatives",
    f"""SELECT class_id, vocabulary_item_id, vocabulary_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY class_id
    ORDER BY CASE vocabulary_id WHEN 7 THEN 0 WHEN 41 THEN 1 ELSE 2 END, vocabulary_item_id) AS place FROM ({CLASSES}) c) t WHERE place = 1""",
)
def _(x):
    return har.representatives(har.item_classes(x.part_items, x.part_mapping), [7, 41])


@query(
    "recode_between",
    f"""WITH c AS ({CLASSES})
    SELECT l_orderkey, l_linenumber, 3 * l_partkey AS code, other.value AS recoded FROM lineitem
    LEFT JOIN c own ON own.vocabulary_id = 4 AND own.value = 3 * l_partkey AND own.vocabulary_item_id < 100
    LEFT JOIN c other ON other.vocabulary_id = 44 AND other.class_id = own.class_id AND other.vocabulary_item_id < 100""",
)
def _(x):
    # Below 100 a class has one item of each vocabulary at most.
    classes = har.item_classes(x.part_items.where("vocabulary_item_id < 100"), x.part_mapping.where("to_vocabulary_item < 100"))
    codes = x.sql("SELECT l_orderkey, l_linenumber, 3 * l_partkey AS code FROM lineitem")
    return har.recode_between(codes, "code", classes, 4, 44, "recoded")


CHAINED = [
    har.MappingRule("grade", "segment", "map", "1=low|2=middle\\=fair|3=high"),
    har.MappingRule("segment", "c_mktsegment", "map", "BUILDING=1|MACHINERY = 2|HOUSEHOLD=3"),
    har.MappingRule("upper", "segment", "ge", "2", prerequisite="solvent"),
    har.MappingRule("solvent", "c_acctbal", "gt", "0"),
    har.MappingRule("fair", "grade", "eq", "middle=fair", prerequisite="upper"),
    har.MappingRule("in_range", "segment", "between", "2,3", prerequisite="fair"),
    har.MappingRule("in_range", "c_nationkey", "eq", "3"),
]


@query(
    "apply_chained_mapping",
    """WITH one AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' WHEN 'HOUSEHOLD' THEN '3' END AS segment,
      CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS solvent FROM customer),
    two AS (SELECT *, CASE segment WHEN '1' THEN 'low' WHEN '2' THEN 'middle=fair' WHEN '3' THEN 'high' END AS grade,
      CASE WHEN solvent = '1' AND segment IS NOT NULL THEN CASE WHEN CAST(segment AS INT) >= 2 THEN '1' ELSE '0' END END AS upper FROM one),
    three AS (SELECT *, CASE WHEN upper = '1' AND grade IS NOT NULL THEN CASE WHEN grade = 'middle=fair' THEN '1' ELSE '0' END END AS fair FROM two)
    SELECT c_custkey, segment, grade, solvent, upper, fair, CASE WHEN c_nationkey = 3 THEN '1'
      WHEN fair = '1' AND CAST(segment AS INT) BETWEEN 2 AND 3 THEN '1' ELSE '0' END AS in_range FROM three""",
)
def _(x):
    return har.apply_variable_mapping(x.customer, CHAINED, ["c_custkey"])


@query(
    "decode_categories",
    """SELECT c_custkey, c_nationkey, n_name AS c_nationkey_code, r_name AS c_nationkey_description FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def _(x):
    return har.decode_categories(x.customer.select("c_custkey", "c_nationkey"), "c_nationkey", x.nation_items)


INSTANCE_KEY = "'=4|=' || l_suppkey || '|=' || l_partkey"


@query(
    "extract_entity_instances",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY substr(md5({INSTANCE_KEY}), 1, 3), {INSTANCE_KEY}) AS instance_id, CAST(4 AS BIGINT) AS entity_id,
    l_suppkey AS study_id, CAST(l_partkey AS VARCHAR) AS external_id, CAST(9 AS BIGINT) AS transformation_id
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) t""",
)
def _(x):
    return har.extract_entity_instances(x.lineitem, 4, "l_suppkey", "l_partkey", 9)


@query(
    "extract_relation_instances",
    """SELECT CAST(2 AS BIGINT) AS entity_relation_id, user_id + 1000 + 1000000 * (user_id % 3) AS entity_instance_id_1,
    LENGTH(event_type) * 100 + ASCII(event_type) + 1000000 * (user_id % 3) AS entity_instance_id_2,
    CAST(MIN(ts) AS DATE) AS valid_from, CAST(MAX(ts) AS DATE) AS valid_to, CAST(9 AS BIGINT) AS transformation_id
    FROM events GROUP BY user_id, event_type""",
)
def _(x):
    return har.extract_relation_instances(x.study_events, "user_id", "event_type", "ts", x.users, x.kinds, 2, 9)


@query(
    "relations_valid_at",
    "SELECT * FROM relations WHERE DATE '2024-01-02' BETWEEN valid_from AND valid_to",
)
def _(x):
    return har.relations_valid_at(x.relations, "2024-01-02")


@query(
    "relations_valid_in_period",
    "SELECT * FROM relations WHERE valid_from <= DATE '2024-01-03' AND valid_to >= DATE '2024-01-01'",
)
def _(x):
    return har.relations_valid_at(x.relations, "2024-01-01", "2024-01-03")


@query(
    "relations_valid_in_periods",
    "SELECT * FROM order_relations JOIN ship_periods ON valid_from <= last_day AND valid_to >= first_day",
)
def _(x):
    return har.relations_valid_in_periods(x.order_relations, x.ship_periods, "first_day", "last_day")


@query("relations_valid_on_days", "SELECT * FROM order_relations JOIN ship_days ON day BETWEEN valid_from AND valid_to")
def _(x):
    return har.relations_valid_on_days(x.order_relations, x.ship_days, "day")


@query("asset_entities", "SELECT DISTINCT l_suppkey AS asset_id, 2 * l_partkey + l_suppkey % 2 AS entity_instance_id FROM lineitem")
def _(x):
    # Every part is an instance of each of two studies, under the same external id.
    instances = x.sql(
        "SELECT study_id, CAST(p_partkey AS STRING) AS external_id, 2 * p_partkey + study_id AS instance_id "
        "FROM part LATERAL VIEW explode(array(0, 1)) s AS study_id"
    )
    rows = x.sql("SELECT l_suppkey, l_partkey, l_suppkey % 2 AS study_id FROM lineitem")
    return har.asset_entities(rows, "l_suppkey", "l_partkey", instances)


@query(
    "accessible_studies",
    "SELECT * FROM cat_assets WHERE study_id IN (SELECT study_id FROM cat_access WHERE user_id = 'user3' AND access_level IN ('read'))",
)
def _(x):
    return har.accessible_studies(x.cat_assets, x.cat_access, "user3", ["read"])


# --- reconciliation and the end-to-end test queries -----------------------------------------------------------

STORED = "SELECT o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderpriority END AS o_orderpriority FROM orders"


@query(
    "assert_same_rows",
    f"""WITH l AS (SELECT CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_orderpriority FROM orders), r AS ({STORED})
    SELECT o_custkey, o_orderstatus, o_orderpriority, CAST(SUM(a) AS BIGINT) AS left_rows, CAST(SUM(b) AS BIGINT) AS right_rows FROM (
      SELECT *, 1 AS a, 0 AS b FROM l UNION ALL SELECT *, 0, 1 FROM r) u GROUP BY 1, 2, 3 HAVING SUM(a) <> SUM(b)""",
)
def _(x):
    return row_differences(x.orders.select("o_custkey", "o_orderstatus", "o_orderpriority"), x.sql(STORED), ["o_custkey"])


@query(
    "row_differences_by_bucket",
    f"""WITH l AS (SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders),
    r AS (SELECT o_orderkey + CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE 0 END AS o_orderkey, o_orderpriority, o_custkey FROM orders)
    SELECT o_orderkey, o_orderpriority, o_custkey, CAST(SUM(a) AS BIGINT) AS left_rows, CAST(SUM(b) AS BIGINT) AS right_rows FROM (
      SELECT *, 1 AS a, 0 AS b FROM l UNION ALL SELECT *, 0, 1 FROM r) u GROUP BY 1, 2, 3 HAVING SUM(a) <> SUM(b)""",
)
def _(x):
    other = x.sql("SELECT o_orderkey + CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE 0 END AS o_orderkey, o_orderpriority, o_custkey FROM orders")
    return row_differences_by_bucket(x.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), other, ["o_custkey"])


@query("all_null_to_string", "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS remark FROM supplier")
def _(x):
    return void_to_string(x.supplier.select("s_suppkey", "s_name", F.lit(None).alias("remark")))


@query("cause_counts", "SELECT o_orderstatus AS cause, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def _(x):
    return x.orders.groupBy(F.col("o_orderstatus").alias("cause")).count().withColumnRenamed("count", "n")


@query(
    "deaths_joined",
    """SELECT o_orderkey AS death_id, c_custkey AS site_id, o_orderstatus AS cause, n_name AS cause_label, c_nationkey AS source_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def _(x):
    joined = x.orders.join(x.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        x.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("o_orderkey").alias("death_id"), F.col("c_custkey").alias("site_id"), F.col("o_orderstatus").alias("cause"),
        F.col("n_name").alias("cause_label"), F.col("c_nationkey").alias("source_id"),
    )
