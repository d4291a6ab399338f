"""EAV operators and typed column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions import values
from studylake.operators import eav
from studylake.types import CATEGORY, DATE, FLOAT, INTEGER, STRING, VALUE_FORMATS, Variable
from workload.registry import query

EAV_VARIABLES = [
    Variable("acctbal", FLOAT),
    Variable("first_order", DATE, VALUE_FORMATS["date_mdy"]),
    Variable("mktsegment", STRING),
    Variable("nation", INTEGER),
    Variable("priority", STRING),
    Variable("segment_code", CATEGORY),
    Variable("status", STRING),
]
FIELDS = [variable.name for variable in EAV_VARIABLES]

COUNTS = "SELECT record, field_name, COUNT(*) AS n FROM eav GROUP BY record, field_name"
MULTI = f"SELECT DISTINCT field_name FROM ({COUNTS}) c WHERE n > 1"
SINGLE = f"SELECT s.record, s.field_name, s.value FROM eav s LEFT JOIN ({MULTI}) m ON s.field_name = m.field_name WHERE m.field_name IS NULL"
MULTI_AGG = f"""SELECT record, field_name, string_agg(value, ', ' ORDER BY value) AS value FROM eav
WHERE field_name IN ({MULTI}) GROUP BY record, field_name"""
PREPPED = f"{SINGLE} UNION ALL {MULTI_AGG}"
CELLS = ", ".join(f"any_value(value) FILTER (WHERE field_name = '{name}') AS {name}" for name in FIELDS)
WIDE = f"SELECT record, {CELLS} FROM ({PREPPED}) p GROUP BY record"
TYPED = f"""SELECT CAST(record AS INTEGER) AS record, CAST(acctbal AS DOUBLE) AS acctbal,
CAST(strptime(first_order, '%m/%d/%Y') AS DATE) AS first_order, mktsegment, CAST(nation AS INTEGER) AS nation, priority,
TRY_CAST(segment_code AS INTEGER) AS segment_code, segment_code AS segment_code_raw, status FROM ({WIDE}) w"""


@query("eav_field_names", "SELECT DISTINCT field_name FROM eav")
def _(x):
    return eav.field_names(x.eav)


@query("eav_counts", COUNTS)
def _(x):
    return eav.counts(x.eav)


@query("eav_multi_fields", MULTI)
def _(x):
    return eav.multi_fields(x.eav)


@query("eav_single_rows", SINGLE)
def _(x):
    return eav.single_rows(x.eav)


@query("eav_multi_agg", MULTI_AGG)
def _(x):
    return eav.multi_agg(x.eav)


@query("eav_prepped", PREPPED)
def _(x):
    return eav.prepped(x.eav)


@query("eav_pivot", WIDE)
def _(x):
    rows = x.eav
    return eav.pivot(eav.prepped(rows), FIELDS)


@query("eav_wide_raw", WIDE)
def _(x):
    return eav.wide_raw(x.eav)


# Brands and types make up to 150 columns, most of them empty for a given size.
BRAND_EAV = """SELECT CAST(p_size AS STRING) AS record, CONCAT(p_brand, ' ', p_type) AS field_name, p_name AS value FROM part"""


@query(
    "eav_wide_many_fields",
    f"""WITH b AS ({BRAND_EAV}), cells AS (SELECT record, field_name, string_agg(value, ', ' ORDER BY value) AS value FROM b GROUP BY 1, 2)
    SELECT record, COUNT(value) AS n_cells, string_agg(field_name || '=' || value, '; ' ORDER BY field_name) AS cells
    FROM cells GROUP BY record""",
)
def _(x):
    wide = eav.wide_raw(x.sql(BRAND_EAV))
    names = wide.columns[1:]
    cells = F.array(*[F.concat(F.lit(f"{name}="), F.col(f"`{name}`")) for name in names])
    present = F.filter(cells, lambda cell: cell.isNotNull())
    return wide.select("record", F.size(present).cast("bigint").alias("n_cells"), F.array_join(present, "; ").alias("cells"))


@query(
    "eav_variable_match",
    "SELECT v.name AS field_name, variable_id, domain_id, value_type_id, value_format FROM eav_variables v "
    "JOIN (SELECT DISTINCT field_name FROM eav) f ON f.field_name = v.name",
)
def _(x):
    return eav.variable_match(x.eav, x.eav_variables).select(
        "field_name", "variable_id", "domain_id", "value_type_id", "value_format"
    )


@query(
    "eav_unmatched_fields",
    "SELECT DISTINCT field_name FROM eav WHERE field_name NOT IN (SELECT name FROM eav_variables)",
)
def _(x):
    return eav.unmatched_fields(x.eav, x.eav_variables)


def eav_wide_typed(x):
    return eav.wide_typed(x.eav, EAV_VARIABLES)


query("eav_wide_typed", TYPED)(eav_wide_typed)


@query(
    "eav_flat_named_multi",
    f"""WITH multi AS (SELECT record,
        string_agg(value, ', ' ORDER BY value) FILTER (WHERE field_name = 'priority') AS priority,
        string_agg(value, ', ' ORDER BY value) FILTER (WHERE field_name = 'status') AS status
      FROM eav WHERE field_name IN ('priority', 'status') GROUP BY record),
    rest AS (SELECT record, {", ".join(f"first(value) FILTER (WHERE field_name = '{n}') AS {n}" for n in FIELDS if n not in ("priority", "status"))}
      FROM eav WHERE field_name NOT IN ('priority', 'status') GROUP BY record)
    SELECT rest.* EXCLUDE (record), multi.* EXCLUDE (record) FROM rest LEFT JOIN multi ON rest.record = multi.record""",
)
def _(x):
    return eav.flat_named_multi(x.eav, ["priority", "status"])


@query(
    "eav_partial_typed",
    f"""SELECT CAST(record AS INTEGER) AS record, CAST(nation AS INTEGER) AS nation, CAST(acctbal AS DOUBLE) AS acctbal,
    first_order, mktsegment, priority, segment_code, status FROM ({WIDE}) w""",
)
def _(x):
    casts = [Variable("record", INTEGER), Variable("nation", INTEGER), Variable("acctbal", FLOAT)]
    return eav.partial_typed(eav.wide_raw(x.eav), casts)


# --- typed column expressions ---------------------------------------------------------------------------------

def _field(x, name):
    return x.sql(f"SELECT record, value FROM eav WHERE field_name = '{name}'")


@query("cast_integer", "SELECT record, CAST(value AS INTEGER) AS value FROM eav WHERE field_name = 'nation'")
def _(x):
    return _field(x, "nation").select("record", values.cast_integer(F.col("value")).alias("value"))


@query("cast_float", "SELECT record, CAST(value AS DOUBLE) AS value FROM eav WHERE field_name = 'acctbal'")
def _(x):
    return _field(x, "acctbal").select("record", values.cast_float(F.col("value")).alias("value"))


@query(
    "parse_date",
    """SELECT event_id, CAST(strptime(mdy, '%m/%d/%Y') AS DATE) AS mdy, CAST(strptime(dmy, '%d/%m/%Y') AS DATE) AS dmy,
    CAST(strptime(ymd, '%Y-%m-%d') AS DATE) AS ymd FROM stamp_texts""",
)
def _(x):
    columns = [
        values.parse_date(F.col(name), VALUE_FORMATS[f"date_{name}"]).alias(name) for name in ("mdy", "dmy", "ymd")
    ]
    return x.stamp_texts.select("event_id", *columns)


@query(
    "parse_datetime",
    """SELECT event_id, strptime(mdy || ' ' || hm, '%m/%d/%Y %H:%M') AS mdy, strptime(dmy || ' ' || hm, '%d/%m/%Y %H:%M') AS dmy,
    strptime(ymd || ' ' || hm, '%Y-%m-%d %H:%M') AS ymd, strptime(mdy || ' ' || hms, '%m/%d/%Y %H:%M:%S') AS mdy_s,
    strptime(dmy || ' ' || hms, '%d/%m/%Y %H:%M:%S') AS dmy_s, strptime(ymd || ' ' || hms, '%Y-%m-%d %H:%M:%S') AS ymd_s FROM stamp_texts""",
)
def _(x):
    def parse(day, time, key, out):
        return values.parse_datetime(F.concat_ws(" ", day, time), VALUE_FORMATS[key]).alias(out)

    days = ("mdy", "dmy", "ymd")
    return x.stamp_texts.select(
        "event_id", *[parse(d, "hm", f"datetime_{d}", d) for d in days],
        *[parse(d, "hms", f"datetime_seconds_{d}", f"{d}_s") for d in days],
    )


@query(
    "parse_time",
    """SELECT event_id, strftime(strptime(hm, '%H:%M'), '%H:%M:%S') AS hm, strftime(strptime(ms, '%M:%S'), '%H:%M:%S') AS ms,
    strftime(strptime(hms, '%H:%M:%S'), '%H:%M:%S') AS hms FROM stamp_texts""",
)
def _(x):
    keys = {"hm": "time", "ms": "time_mm_ss", "hms": "time_hh_mm_ss"}
    columns = [values.parse_time(F.col(name), VALUE_FORMATS[key]).alias(name) for name, key in keys.items()]
    return x.stamp_texts.select("event_id", *columns)


@query(
    "cast_category",
    "SELECT record, TRY_CAST(value AS INTEGER) AS value, value AS value_raw FROM eav",
)
def _(x):
    # Numbers, halves, dates, names: everything the export holds.
    return x.eav.select("record", values.cast_category(F.col("value")).alias("value"), F.col("value").alias("value_raw"))


@query("pass_text", "SELECT record, field_name, value FROM eav")
def _(x):
    return x.eav.select("record", "field_name", values.typed_columns([Variable("value", STRING)])[0].alias("value"))




@query(
    "multiresponse_array",
    """SELECT record, n, CAST(total AS BIGINT) AS total, answers FROM (SELECT o_custkey AS record, COUNT(*) AS n,
    SUM(CAST(SUBSTR(o_orderpriority, 1, 1) AS INT)) AS total, string_agg(SUBSTR(o_orderpriority, 1, 1), '+' ORDER BY SUBSTR(o_orderpriority, 1, 1)) AS answers
    FROM orders GROUP BY o_custkey) t""",
)
def _(x):
    rows = x.sql("SELECT CAST(o_custkey AS STRING) AS record, 'answers' AS field_name, SUBSTR(o_orderpriority, 1, 1) AS value FROM orders")
    answers = values.multiresponse_array(F.col("answers"))
    return eav.wide_raw(rows, ["answers"]).select(
        F.col("record").cast("bigint").alias("record"), F.size(answers).cast("bigint").alias("n"),
        F.aggregate(answers, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
        F.array_join(F.transform(answers, lambda v: v.cast("string")), "+").alias("answers"),
    )
