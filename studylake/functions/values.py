"""From text to typed values, one expression per value type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake import types as VT
from studylake.functions.text import NUMBER

# Strptime directives and the Spark pattern letters that accept the same digits, padded or not.
DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}


def spark_pattern(value_format: str) -> str:
    """strptime format -> Spark datetime pattern."""
    pattern = value_format
    for directive, letters in DIRECTIVES.items():
        pattern = pattern.replace(directive, letters)
    if "%" in pattern:
        raise ValueError(f"unsupported format {value_format!r}")
    return pattern


def cast_integer(text: Column) -> Column:
    """Strict: bad text fails the query. Fractions round half away from zero."""
    return F.coalesce(text.try_cast("int"), F.round(text.cast("double")).cast("int"))


def cast_float(text: Column) -> Column:
    return text.cast("double")


def parse_date(text: Column, value_format: str) -> Column:
    return F.to_date(text, spark_pattern(value_format))


def parse_datetime(text: Column, value_format: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(spark_pattern(value_format)))


def parse_time(text: Column, value_format: str, as_time: bool = False) -> Column:
    """Time of day as `HH:mm:ss` text, or as TIME where the session has `spark.sql.timeType.enabled`."""
    if as_time:
        return F.to_time(text, F.lit(spark_pattern(value_format)))
    stamp = F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), text), F.lit("yyyy-M-d " + spark_pattern(value_format)))
    return F.substring(stamp.cast("string"), 12, 8)


def cast_category(text: Column) -> Column:
    """Lenient: NULL where the text is no number."""
    trimmed = F.trim(text)
    return F.coalesce(
        trimmed.try_cast("int"),
        F.when(trimmed.rlike(NUMBER), F.round(trimmed.try_cast("double")).try_cast("int")),
    )


def multiresponse_array(text: Column) -> Column:
    """Comma-joined text -> array of integers."""
    return F.transform(F.split(text, ", *"), cast_category)


def typed_columns(
    variables: list[VT.Variable], multiresponse_as_array: bool = False, as_time: bool = False
) -> list[Column]:
    """Projection of text columns into their variables' types, in variable order."""
    columns: list[Column] = []
    for variable in variables:
        text = F.col(f"`{variable.name.replace('`', '``')}`")
        kind = variable.value_type_id
        if kind in (VT.DATE, VT.DATETIME, VT.TIME) and not variable.value_format:
            raise ValueError(f"variable {variable.name!r} needs a value format")
        if kind == VT.CATEGORY:
            columns += [cast_category(text).alias(variable.name), text.alias(f"{variable.name}_raw")]
        elif kind == VT.INTEGER:
            columns.append(cast_integer(text).alias(variable.name))
        elif kind == VT.FLOAT:
            columns.append(cast_float(text).alias(variable.name))
        elif kind == VT.DATE:
            columns.append(parse_date(text, variable.value_format).alias(variable.name))
        elif kind == VT.DATETIME:
            columns.append(parse_datetime(text, variable.value_format).alias(variable.name))
        elif kind == VT.TIME:
            columns.append(parse_time(text, variable.value_format, as_time).alias(variable.name))
        elif kind == VT.MULTIRESPONSE and multiresponse_as_array:
            columns.append(multiresponse_array(text).alias(variable.name))
        else:
            columns.append(text.alias(variable.name))
    return columns
