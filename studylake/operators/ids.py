"""Surrogate ids and natural keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the key hash that make a bucket: 3 digits give 4,096 buckets.
BUCKET_DIGITS = 3


def key_text(keys: Sequence[str]) -> Column:
    """Natural key as one text, a different one for each key: NULL parts are marked, and `|` and `\\` in a part are escaped."""
    written = [F.col(key).cast("string") for key in keys]
    if len(written) > 1:
        written = [F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for part in written]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), part), F.lit("-")) for part in written])


def same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    """NULL-safe equality of two aliased sides on a natural key."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def assign_ids(rows: DataFrame, keys: Sequence[str], id_column: str, existing: DataFrame | None = None) -> DataFrame:
    """Dense ids for rows with distinct natural keys, continuing after the largest existing id.

    Rows are numbered within hash buckets of their key and shifted by the sizes of the buckets before theirs.
    The numbers depend on the keys alone, so a recomputed task hands out the same ids; no single task sees
    more than a bucket, and the only table that is summed up in one place has one row per bucket.
    """
    bucketed = rows.withColumn("_key", key_text(keys)).withColumn(
        "_bucket", F.substring(F.md5(F.col("_key")), 1, BUCKET_DIGITS)
    )
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # Never more than 16 ** BUCKET_DIGITS rows.
    numbered = bucketed.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))).join(
        F.broadcast(offsets), "_bucket"
    )
    start = F.lit(0) if existing is None else existing.select(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    new_id = (start + F.col("_offset") + F.col("_n")).cast("bigint").alias(id_column)
    return numbered.select(new_id, *rows.columns)
