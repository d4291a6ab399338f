"""Exports, dictionaries, tables and database queries as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.types import DICTIONARY_SCHEMA


def scan_eav_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, encoding: str = "UTF-8", keys: Sequence[str] = ()
) -> DataFrame:
    """EAV export with a header row -> `record, field_name, value`, all text; other columns are ignored.

    `keys` are columns that tell the visits of a record apart, as longitudinal exports have them; they come after `record`.

    Values may hold line breaks, which makes a file one task. Set `multi_line=False` for exports known to have
    none, and large files are split.
    """
    # A folder's files must agree on their columns: without enforceSchema Spark compares every header.
    options = {"header": True, "multiLine": multi_line, "encoding": encoding, "escape": '"', "enforceSchema": False}
    header = spark.read.options(**{**options, "multiLine": False}).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    wanted = ["record", *[key for key in keys if key != "record"], "field_name", "value"]
    missing = sorted(set(wanted) - set(header))
    if missing:
        raise ValueError(f"no column {missing} in {path}")
    return spark.read.schema(schema).options(**options).csv(path).select(*wanted)


def scan_eav_transcode(
    spark: SparkSession, path: str, charset: str = "iso8859-2", multi_line: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """The same for an export in another single-byte character set.

    Spark reads every byte as the Latin-1 character of the same number; each is then translated to the character
    the byte stands for.
    """
    high = bytes(range(0x80, 0x100))
    read_as, meant = high.decode("latin-1"), high.decode(charset, errors="replace")

    def decode(name: str) -> Column:
        return F.translate(F.col(name), read_as, meant).alias(name)

    raw = scan_eav_csv(spark, path, multi_line, "ISO-8859-1", keys)
    return raw.select(*[decode(name) for name in raw.columns])


def scan_dictionary_json(
    spark: SparkSession, path: str, forms: Sequence[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """Dictionary: JSON arrays of field objects, optionally of some forms only. Absent keys become NULL.

    `ord` keeps the row order of the file. With `multi_line=False` every line is an object or array of its own,
    and large files are split.
    """
    rows = (
        spark.read.schema(DICTIONARY_SCHEMA).option("multiLine", multi_line).json(path)
        .withColumn("ord", F.monotonically_increasing_id())
    )
    return rows.where(F.col("form_name").isin(list(forms))) if forms else rows


def get_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def select_where_eq(df: DataFrame, columns: Sequence[str], equal: Mapping[str, Any] | None = None) -> DataFrame:
    """Some columns of the rows that equal all given values."""
    conditions = [F.col(name) == value for name, value in (equal or {}).items()]
    rows = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    return rows.select(*columns) if columns else rows


def read_query(
    spark: SparkSession,
    sql: str,
    jdbc: Mapping[str, str] | None = None,
    partition: tuple[str, Any, Any, int] | None = None,
) -> DataFrame:
    """Result of a SELECT on Spark's own tables, or on a database through JDBC.

    `partition` is `(column, lower, upper, partitions)`: without it a database is read by one task.
    """
    if jdbc is None:
        return spark.sql(sql)
    reader = spark.read.format("jdbc").options(**jdbc)
    if partition is None:
        return reader.option("query", sql).load()
    column, lower, upper, partitions = partition
    return reader.options(
        dbtable=f"({sql}) q", partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
    ).load()
