"""Dictionary operators and legal names."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions import names as legal
from studylake.functions.text import strip_markup
from studylake.operators import dictionary as dic
from workload.registry import query

KEPT = "SELECT * FROM dictionary WHERE lower(field_type) NOT IN ('descriptive', 'sql', 'signature', 'file')"
VALIDATION = "text_validation_type_or_show_slider_number"
CHOICES = "select_choices_or_calculations"
BLANK = r"[\x09-\x0D\x85\p{Z}]"
TRIM = r"^[\x09-\x0D\x85\p{Zs}]+|[\x09-\x0D\x85\p{Zs}]+\z"

# Date and time formats by validation.
FORMATS = [
    ("date_mdy", "%m/%d/%Y"), ("date_dmy", "%d/%m/%Y"), ("date_ymd", "%Y-%m-%d"), ("datetime_mdy", "%m/%d/%Y %H:%M"),
    ("datetime_seconds_ymd", "%Y-%m-%d %H:%M:%S"), ("time", "%H:%M"), ("time_hh_mm_ss", "%H:%M:%S"), ("time_mm_ss", "%M:%S"),
]
TYPE_ID = f"""CASE WHEN lower(field_type) IN ('radio', 'dropdown', 'yesno', 'truefalse') THEN 7 WHEN lower(field_type) = 'checkbox' THEN 8
WHEN lower(field_type) = 'calc' THEN 2 WHEN lower(field_type) = 'slider' THEN 1 WHEN lower(field_type) <> 'text' THEN 3
WHEN lower({VALIDATION}) = 'integer' THEN 1 WHEN lower({VALIDATION}) LIKE 'number%' THEN 2 WHEN {VALIDATION} LIKE 'datetime%' THEN 5
WHEN {VALIDATION} LIKE 'date%' THEN 4 WHEN {VALIDATION} LIKE 'time%' THEN 6 ELSE 3 END"""
FORMAT = "CASE " + " ".join(
    f"WHEN lower(field_type) = 'text' AND {VALIDATION} = '{key}' THEN '{fmt}'" for key, fmt in FORMATS
) + " END"


def plain(column: str) -> str:
    text = rf"regexp_replace({column}, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g')"
    text = rf"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return rf"regexp_replace(regexp_replace({text}, '[ \t\r\n]+', ' ', 'g'), '{TRIM}', '', 'g')"


def choice_sql(source: str, key: str, text: str) -> str:
    """Choices numbered within their text; the sequence numbers of non-numeric ids come from a window."""
    return rf"""
    parts AS (SELECT {key}, unnest(list_filter(list_transform(string_split({text}, '|'), lambda p: regexp_replace(p, '{TRIM}', '', 'g')), lambda p: p <> '')) AS part,
      generate_subscripts(list_filter(list_transform(string_split({text}, '|'), lambda p: regexp_replace(p, '{TRIM}', '', 'g')), lambda p: p <> ''), 1) AS pos
      FROM {source} WHERE {text} IS NOT NULL),
    split_parts AS (SELECT {key}, CAST(pos AS INTEGER) AS pos, CASE WHEN contains(part, ',') THEN ',' WHEN contains(part, '=') THEN '=' END AS sep, part FROM parts),
    cut AS (SELECT {key}, pos, part, CASE WHEN sep IS NOT NULL THEN regexp_replace(substr(part, 1, instr(part, sep) - 1), '{TRIM}', '', 'g') END AS i,
      CASE WHEN sep IS NOT NULL THEN regexp_replace(substr(part, instr(part, sep) + 1), '{TRIM}', '', 'g') END AS l FROM split_parts),
    labelled AS (SELECT {key}, pos, CASE WHEN i <> '' AND l <> '' AND NOT contains(l, chr(10)) THEN i ELSE part END AS id,
      CASE WHEN i <> '' AND l <> '' AND NOT contains(l, chr(10)) THEN l ELSE part END AS label FROM cut),
    valued AS (SELECT {key}, pos, id, label, CASE WHEN regexp_matches(id, '^[+-]?[0-9]+$') AND TRY_CAST(id AS BIGINT) IS NOT NULL THEN CAST(id AS BIGINT)
      WHEN regexp_matches(id, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
      THEN TRY_CAST(round_even(CAST(id AS DOUBLE), 0) AS BIGINT) END AS num FROM labelled),
    items AS (SELECT {key}, pos, COALESCE(num, SUM(CASE WHEN num IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos)::BIGINT) AS value,
      CASE WHEN num IS NULL THEN id ELSE regexp_replace(lower(label), '{BLANK}+', '_', 'g') END AS code, label AS description FROM valued)"""


@query("dict_data_fields", KEPT)
def _(x):
    return dic.data_fields(x.dictionary)


@query("dict_field_list", f"SELECT field_name, MIN(ord) AS ord FROM ({KEPT}) k GROUP BY field_name")
def _(x):
    return dic.field_list(x.dictionary)


@query(
    "dict_field_list_of_forms",
    "SELECT field_name, MIN(ord) AS ord FROM dictionary WHERE form_name IN ('Brand#1', 'Brand#7') GROUP BY field_name",
)
def _(x):
    return dic.field_list(x.dictionary, ["Brand#1", "Brand#7"], include_non_data=True)


@query("dict_value_types", f"SELECT ord, field_name, {TYPE_ID} AS value_type_id, {FORMAT} AS value_format FROM dictionary")
def _(x):
    return dic.value_types(x.dictionary).select("ord", "field_name", "value_type_id", "value_format")


@query("strip_markup", f"SELECT page_id, {plain('html')} AS text FROM pages")
def _(x):
    return x.pages.select("page_id", strip_markup(F.col("html")).alias("text"))


@query("parse_choices", f"WITH {choice_sql('choices', 'field_id', 'choices')} SELECT field_id, pos, id, label FROM labelled")
def _(x):
    return dic.choices(x.choices, "field_id", "choices")


@query("choice_values", f"WITH {choice_sql('choices', 'field_id', 'choices')} SELECT field_id, pos, value FROM items")
def _(x):
    return dic.choice_rows(x.choices, "field_id", "choices").select("field_id", "pos", "value")


@query("choice_codes", f"WITH {choice_sql('dictionary', 'ord', CHOICES)} SELECT ord, pos, value, code, description FROM items")
def _(x):
    return dic.choice_rows(x.dictionary, "ord", CHOICES)


VOCABULARY_TEXT = f"""WITH {choice_sql('dictionary', 'ord', CHOICES)},
coded AS (SELECT *, {TYPE_ID} AS kind FROM ({KEPT}) k)
SELECT c.ord, c.field_name, 'src.' || c.field_name AS name, 'REDCap choices for ' || c.field_name AS description,
  COUNT(i.pos) AS n_items, COALESCE(string_agg(i.value || ':' || i.code || ':' || i.description, '; ' ORDER BY i.pos), '') AS items
FROM coded c LEFT JOIN items i ON c.ord = i.ord WHERE kind IN (7, 8) GROUP BY c.ord, c.field_name"""


def items_text(items="items"):
    """Nested items as one text, for comparison."""
    return F.array_join(
        F.transform(items, lambda i: F.concat_ws(":", i["value"].cast("string"), i["code"], i["description"])), "; "
    )


@query("build_vocabularies", VOCABULARY_TEXT)
def _(x):
    return dic.vocabularies(x.dictionary, 7, "src").select(
        "ord", "field_name", "name", "description", F.size("items").cast("bigint").alias("n_items"), items_text().alias("items")
    )


@query(
    "dict_key_role",
    f"SELECT ord, field_name, CASE WHEN ord = (SELECT MIN(ord) FROM ({KEPT}) m) THEN 'record' ELSE 'none' END AS keyrole FROM ({KEPT}) k",
)
def _(x):
    return dic.key_roles(x.dictionary).select("ord", "field_name", "keyrole")


def new_ids(rows: str, key: str, existing: str, id_column: str) -> str:
    return (
        f"SELECT name, (SELECT COALESCE(MAX({id_column}), 0) FROM {existing}) + ROW_NUMBER() OVER "
        f"(ORDER BY substr(md5({key}), 1, 3), {key}) AS id FROM ({rows}) r "
        f"WHERE name NOT IN (SELECT name FROM {existing})"
    )


REGISTERED = f"""WITH declared AS (SELECT *, {TYPE_ID} AS kind FROM ({KEPT}) k),
vocab_names AS (SELECT DISTINCT 'src.' || field_name AS name FROM declared WHERE kind IN (7, 8)),
vocab_ids AS (SELECT name, vocabulary_id AS id FROM known_vocabularies UNION ALL
  {new_ids("SELECT name FROM vocab_names", "'=7|=' || name", "known_vocabularies", "vocabulary_id")}),
variable_ids AS (SELECT name, variable_id AS id FROM known_variables UNION ALL
  {new_ids("SELECT DISTINCT field_name AS name FROM declared", "'=7|=' || name", "known_variables", "variable_id")})
SELECT field_name, v.id AS variable_id, kind AS value_type_id, w.id AS vocabulary_id, field_type, {VALIDATION} AS validation,
  {plain('field_label')} AS label, field_note AS note
FROM declared JOIN variable_ids v ON v.name = field_name LEFT JOIN vocab_ids w ON kind IN (7, 8) AND w.name = 'src.' || field_name"""


@query("register_dictionary", REGISTERED)
def _(x):
    return dic.register(x.dictionary, 7, x.known_variables, x.known_vocabularies, "src")["report"]


@query(
    "register_dictionary_variables",
    f"""WITH declared AS (SELECT *, {TYPE_ID} AS kind, {FORMAT} AS fmt FROM ({KEPT}) k QUALIFY ROW_NUMBER() OVER (PARTITION BY field_name ORDER BY ord DESC) = 1),
    ids AS ({new_ids("SELECT field_name AS name FROM declared", "'=7|=' || name", "known_variables", "variable_id")})
    SELECT COALESCE(k.variable_id, ids.id) AS variable_id, COALESCE(k.name, field_name) AS name,
      CASE WHEN field_name IS NULL THEN k.value_type_id ELSE kind END AS value_type_id, fmt AS value_format,
      CASE WHEN field_name IS NULL THEN k.note ELSE field_note END AS note
    FROM known_variables k FULL JOIN declared ON k.name = field_name LEFT JOIN ids ON ids.name = field_name""",
)
def _(x):
    new = dic.register(x.dictionary, 7, x.known_variables, x.known_vocabularies, "src")["variables"]
    return new.select("variable_id", "name", "value_type_id", "value_format", "note")


# --- names ----------------------------------------------------------------------------------------------------

CHARS = r"\p{L}\p{N}\p{Mc}\p{Mn}\p{Pc}\p{Lm}"


def legal_sql(strict: bool, column: str = "name") -> str:
    allowed = CHARS if strict else CHARS + r"\-."
    text = rf"regexp_replace(regexp_replace({column}, '^[\x09-\x0D\x85\p{{Zs}}]+|[\x09-\x0D\x85\p{{Zs}}]+\z', '', 'g'), '[^{allowed}]', '_', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '^([^_\p{{L}}])', '_\1'), '_{{2,}}', '_', 'g')"
    return f"""CASE WHEN {text} = '' THEN '_x' WHEN lower({text}) LIKE 'xml%' THEN '_' || {text} ELSE {text} END"""


@query("normalize_names", f"SELECT name, {legal_sql(False)} AS legal, {legal_sql(True)} AS strict FROM names")
def _(x):
    name = F.col("name")
    return x.names.select("name", legal.legal_name(name).alias("legal"), legal.legal_name(name, strict=True).alias("strict"))


@query(
    "invalid_names",
    rf"""SELECT name, regexp_matches(name, '^[_\p{{L}}][{CHARS}\-.]*\z') AS legal FROM names
    WHERE NOT regexp_matches(name, '^[_\p{{L}}][{CHARS}]*\z')""",
)
def _(x):
    name = F.col("name")
    return x.names.where(~legal.is_legal_name(name, strict=True)).select("name", legal.is_legal_name(name).alias("legal"))


# Spellings that become one legal name.
SPELLINGS = "SELECT name FROM names UNION ALL SELECT REPLACE(name, ' ', '-') FROM names UNION ALL SELECT CONCAT(name, '!') FROM names"


@query(
    "name_collisions",
    f"SELECT {legal_sql(True)} AS legal, COUNT(DISTINCT name) AS n_names FROM ({SPELLINGS}) n GROUP BY 1 HAVING COUNT(DISTINCT name) > 1",
)
def _(x):
    return legal.name_collisions(x.sql(SPELLINGS), "name")
