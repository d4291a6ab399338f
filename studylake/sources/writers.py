"""Tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.types import Variable, lake_type


def table_schema(variables: Sequence[Variable]) -> T.StructType:
    """Schema of a dataset table from its variables."""
    return T.StructType([T.StructField(v.name, lake_type(v.value_type_id)) for v in variables])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order, cast to its types; columns the schema does not name are dropped."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])


def append_rows(df: DataFrame, table: DataFrame, path: str) -> None:
    """Append to the Parquet table at `path`, columns matched by name; the names must be the same."""
    if set(df.columns) != set(table.columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(table.columns))}")
    conform(df, table.schema).write.mode("append").parquet(path)


def _mode(replace: bool) -> str:
    return "overwrite" if replace else "errorifexists"


def export_csv(df: DataFrame, path: str, replace: bool = False, compress: bool = False) -> None:
    """CSV files with header; refuses to overwrite unless `replace`. Blanks around values are kept."""
    writer = df.write.mode(_mode(replace)).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    (writer.option("compression", "gzip") if compress else writer).csv(path)


def export_columnar(df: DataFrame, path: str, replace: bool = False) -> None:
    """Columnar files with zstd compression; refuses to overwrite unless `replace`."""
    df.write.mode(_mode(replace)).option("compression", "zstd").parquet(path)
