"""Declared SQL column types -> value types, per database flavour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake import types as VT

# Type names each flavour counts as integer, float, date-time, date and time.
_ZONED_TIMESTAMPS = ["timestamp with time zone", "timestamp without time zone"]
_ZONED_TIMES = ["time with time zone", "time without time zone"]
TYPE_NAMES = {
    "generic": {
        VT.INTEGER: ["int", "integer", "smallint", "bigint", "tinyint", "mediumint", "int2", "int4", "int8",
                     "serial", "bigserial", "smallserial"],
        VT.FLOAT: ["float", "double", "real", "decimal", "numeric", "money", "smallmoney", "float4", "float8",
                   "double precision"],
        VT.DATETIME: ["datetime", "datetime2", "datetimeoffset", "timestamp", "timestamptz", *_ZONED_TIMESTAMPS],
        VT.DATE: ["date"],
        VT.TIME: ["time", "timetz", *_ZONED_TIMES],
    },
    "mssql": {
        VT.INTEGER: ["int", "integer", "smallint", "bigint", "tinyint", "bit"],
        VT.FLOAT: ["float", "real", "decimal", "numeric", "money", "smallmoney"],
        VT.DATETIME: ["datetime", "datetime2", "datetimeoffset", "smalldatetime"],
        VT.DATE: ["date"],
        VT.TIME: ["time"],
    },
    "duckdb": {
        VT.INTEGER: ["integer", "int", "int2", "int4", "int8", "bigint", "smallint", "tinyint", "hugeint",
                     "ubigint", "uinteger", "usmallint", "utinyint"],
        VT.FLOAT: ["float", "double", "real", "decimal", "numeric", "float4", "float8"],
        VT.DATETIME: ["timestamp", "timestamptz", *_ZONED_TIMESTAMPS],
        VT.DATE: ["date"],
        VT.TIME: ["time"],
    },
    "postgresql": {
        VT.INTEGER: ["int", "integer", "smallint", "bigint", "int2", "int4", "int8", "serial", "bigserial",
                     "smallserial", "oid"],
        VT.FLOAT: ["float4", "float8", "real", "double precision", "numeric", "decimal", "money"],
        VT.DATETIME: ["timestamp", "timestamptz", *_ZONED_TIMESTAMPS],
        VT.DATE: ["date"],
        VT.TIME: ["time", "timetz", *_ZONED_TIMES],
    },
    "spark": {
        VT.INTEGER: ["tinyint", "smallint", "int", "bigint", "boolean"],
        VT.FLOAT: ["float", "double"],
        VT.DATETIME: ["timestamp", "timestamp_ntz"],
        VT.DATE: ["date"],
        VT.TIME: ["time(0)", "time(3)", "time(6)"],
    },
    "mysql": {
        VT.INTEGER: ["int", "integer", "smallint", "bigint", "tinyint", "mediumint"],
        VT.FLOAT: ["float", "double", "real", "decimal", "numeric"],
        VT.DATETIME: ["datetime", "timestamp"],
        VT.DATE: ["date"],
        VT.TIME: ["time"],
    },
}
SCALED_DECIMAL = r"^(decimal|numeric)\s*\(\s*\d+\s*,\s*\d+\s*\)$"
ENUM_BY_NAME = ("duckdb", "mysql")
FLAVOURS = (*TYPE_NAMES, "sqlite")


def map_type(data_type: Column, flavour: str) -> Column:
    """Value type id of a declared type, by the rules of one flavour."""
    return map_type_by_flavour(data_type, F.lit(flavour))


def map_type_by_flavour(data_type: Column, flavour: Column) -> Column:
    """The same for a column of flavours; unknown flavours follow the generic rules.

    The names of all flavours go into one set per value type, keyed by flavour, so that the expression stays as
    small as for one flavour.
    """
    declared = F.lower(data_type)
    base = F.when(flavour == "mssql", F.regexp_replace(declared, r"\s*\([^)]*\)\s*$", "")).otherwise(declared)
    rules = F.when(flavour.isin(*FLAVOURS), flavour).otherwise("generic")
    key = F.concat(rules, F.lit(":"), base)

    def named(kind: int) -> Column:
        return key.isin([f"{name}:{text}" for name, kinds in TYPE_NAMES.items() for text in kinds[kind]])

    affinity = (
        F.when(F.contains(declared, F.lit("int")), VT.INTEGER)
        .when(declared.rlike("real|floa|doub"), VT.FLOAT)
        .when(declared.rlike("datetime|timestamp"), VT.DATETIME)
        .when(declared == "date", VT.DATE)
        .when(declared == "time", VT.TIME)
        .otherwise(VT.STRING)
    )
    return (
        F.when(flavour == "sqlite", affinity)
        .when(flavour.isin(*ENUM_BY_NAME) & F.startswith(declared, F.lit("enum")), VT.CATEGORY)
        .when(named(VT.INTEGER), VT.INTEGER)
        .when(named(VT.FLOAT) | ((flavour != "mssql") & declared.rlike(SCALED_DECIMAL)), VT.FLOAT)
        .when(named(VT.DATETIME), VT.DATETIME)
        .when(named(VT.DATE), VT.DATE)
        .when(named(VT.TIME), VT.TIME)
        .otherwise(VT.STRING)
    )
