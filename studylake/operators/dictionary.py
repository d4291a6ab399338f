"""Field dictionary -> variables and code lists.

Input columns: `DICTIONARY_SCHEMA` plus `ord`, the row order in the file. Everything up to the vocabularies is a
projection of one row, so a dictionary of any size is processed without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake import types as VT
from studylake.functions.text import choice_items, split_choices, strip_markup
from studylake.operators import catalog

VALIDATION = "text_validation_type_or_show_slider_number"
CHOICES = "select_choices_or_calculations"

# Field types without data, and what field types and validations mean.
NON_DATA_TYPES = ["descriptive", "sql", "signature", "file"]
CATEGORY_TYPES = ["radio", "dropdown", "yesno", "truefalse"]
NUMBER_VALIDATIONS = ["number", "number_1dp", "number_2dp", "number_3dp"]
DATE_VALIDATIONS = ["date_ymd", "date_mdy", "date_dmy"]
DATETIME_VALIDATIONS = [
    "datetime_ymd", "datetime_mdy", "datetime_dmy",
    "datetime_seconds_ymd", "datetime_seconds_mdy", "datetime_seconds_dmy",
]
TIME_VALIDATIONS = ["time", "time_hh_mm_ss", "time_mm_ss"]
VOCABULARY_DESCRIPTION = "REDCap choices for "


def is_data_field(field_type: Column) -> Column:
    return ~F.coalesce(F.lower(field_type), F.lit("")).isin(NON_DATA_TYPES)


def data_fields(dictionary: DataFrame) -> DataFrame:
    """Rows of the fields that hold data."""
    return dictionary.where(is_data_field(F.col("field_type")))


def field_list(dictionary: DataFrame, forms: Sequence[str] | None = None, include_non_data: bool = False) -> DataFrame:
    """Unique field names in the order they first appear: `field_name, ord`."""
    rows = dictionary if include_non_data else data_fields(dictionary)
    if forms:
        rows = rows.where(F.col("form_name").isin(list(forms)))
    return (
        rows.where(F.coalesce(F.col("field_name"), F.lit("")) != "")
        .groupBy("field_name").agg(F.min("ord").alias("ord")).orderBy("ord")
    )


def value_type(field_type: Column, validation: Column) -> Column:
    kind, check = F.lower(field_type), F.coalesce(F.lower(validation), F.lit(""))
    text = (
        F.when(check == "integer", VT.INTEGER)
        .when(check.isin(NUMBER_VALIDATIONS), VT.FLOAT)
        .when(check.isin(DATE_VALIDATIONS), VT.DATE)
        .when(check.isin(DATETIME_VALIDATIONS), VT.DATETIME)
        .when(check.isin(TIME_VALIDATIONS), VT.TIME)
        .otherwise(VT.STRING)
    )
    return (
        F.when(kind.isin(CATEGORY_TYPES), VT.CATEGORY)
        .when(kind == "checkbox", VT.MULTIRESPONSE)
        .when(kind == "calc", VT.FLOAT)
        .when(kind == "slider", VT.INTEGER)
        .when(kind == "text", text)
        .otherwise(VT.STRING)
    )


def value_format(field_type: Column, validation: Column) -> Column:
    """strptime format of a validated date or time text field, else NULL."""
    check = F.lower(validation)
    rule = F
    for name in [*DATE_VALIDATIONS, *DATETIME_VALIDATIONS, *TIME_VALIDATIONS]:
        rule = rule.when(check == name, VT.VALUE_FORMATS[name])
    return F.when(F.lower(field_type) == "text", rule.otherwise(None))


def value_types(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows with `value_type_id` and `value_format`."""
    kind, check = F.col("field_type"), F.col(VALIDATION)
    return dictionary.withColumns({"value_type_id": value_type(kind, check), "value_format": value_format(kind, check)})


def choices(dictionary: DataFrame, key: str = "field_name", text: str = CHOICES) -> DataFrame:
    """One row per choice: `key, pos, id, label`."""
    return dictionary.select(key, F.inline(split_choices(F.col(text))))


def choice_rows(dictionary: DataFrame, key: str = "field_name", text: str = CHOICES) -> DataFrame:
    """One row per choice with its integer value, code and description."""
    return dictionary.select(key, F.inline(choice_items(F.col(text))))


def vocabulary_name(field: Column, domain_id: int, prefix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix}." if prefix else f"dom{domain_id}."), field)


def vocabularies(dictionary: DataFrame, domain_id: int, prefix: str = "") -> DataFrame:
    """One vocabulary per category or multi-response field, its items nested in choice order.

    Fields without choices (yes/no) get an empty list.
    """
    coded = value_types(data_fields(dictionary)).where(F.col("value_type_id").isin(VT.CATEGORY, VT.MULTIRESPONSE))
    items = choice_items(F.coalesce(F.col(CHOICES), F.lit("")))
    return coded.select(
        "field_name",
        F.lit(domain_id).cast("bigint").alias("domain_id"),
        vocabulary_name(F.col("field_name"), domain_id, prefix).alias("name"),
        F.concat(F.lit(VOCABULARY_DESCRIPTION), F.col("field_name")).alias("description"),
        F.transform(items, lambda i: F.struct(i["value"], i["code"], i["description"])).alias("items"),
        "ord",
    )


def key_roles(dictionary: DataFrame) -> DataFrame:
    """Data fields with `keyrole`: the first one is the record key."""
    kept = data_fields(dictionary)
    first = kept.select(F.min("ord")).scalar()
    return kept.withColumn("keyrole", F.when(F.col("ord") == first, "record").otherwise("none"))


def dictionary_variables(dictionary: DataFrame, domain_id: int, prefix: str = "") -> DataFrame:
    """Variable attributes a dictionary declares, before ids are known."""
    rows = value_types(key_roles(dictionary))
    coded = F.col("value_type_id").isin(VT.CATEGORY, VT.MULTIRESPONSE)
    return rows.select(
        F.lit(domain_id).cast("bigint").alias("domain_id"),
        F.col("field_name").alias("name"),
        "value_type_id",
        "value_format",
        F.when(coded, vocabulary_name(F.col("field_name"), domain_id, prefix)).alias("vocabulary"),
        "keyrole",
        strip_markup(F.col("field_label")).alias("description"),
        F.col("field_note").alias("note"),
        "field_type",
        F.col(VALIDATION).alias("validation"),
        "ord",
    )


def register(
    dictionary: DataFrame,
    domain_id: int,
    existing_variables: DataFrame,
    existing_vocabularies: DataFrame,
    prefix: str = "",
) -> dict[str, DataFrame]:
    """New catalog state after a dictionary is registered, and the report of what was registered.

    Returns `report`, `variables`, `vocabularies` and `vocabulary_items` (the items of the dictionary's own
    vocabularies, which replace older ones; all NULL but the id for a vocabulary without choices).
    """
    declared = dictionary_variables(dictionary, domain_id, prefix)
    coded = vocabularies(dictionary, domain_id, prefix)
    vocabs = catalog.upsert_by_key(
        existing_vocabularies, coded, ["domain_id", "name"], "vocabulary_id", ["description"], "ord"
    )
    vocab_ids = vocabs.where(F.col("domain_id") == domain_id).select(
        "vocabulary_id", F.col("name").alias("vocabulary")
    )
    attributes = ["value_type_id", "value_format", "vocabulary_id", "keyrole", "description", "note"]
    incoming = declared.join(vocab_ids, "vocabulary", "left")
    variables = catalog.upsert_by_key(
        existing_variables, incoming, ["domain_id", "name"], "variable_id", attributes, "ord"
    )
    ids = variables.where(F.col("domain_id") == domain_id).select("variable_id", "name")
    report = incoming.join(ids, "name").select(
        F.col("name").alias("field_name"), "variable_id", "value_type_id", "vocabulary_id", "field_type",
        "validation", F.col("description").alias("label"), "note",
    )
    latest = coded.groupBy("name").agg(F.max_by("items", "ord").alias("items"))
    items = latest.join(vocab_ids, latest["name"] == vocab_ids["vocabulary"]).select(
        "vocabulary_id", F.inline_outer("items")  # a list that is now empty still empties the stored one
    )
    return {"report": report, "variables": variables, "vocabularies": vocabs, "vocabulary_items": items}

