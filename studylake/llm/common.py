"""What the operators share: reading columns whatever else a table holds, and freeing finished shuffles."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.session import materialize, partitions

__all__ = ["by_place", "free_shuffles", "materialize", "partitions", "pick", "read_table", "split_bytes"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns renamed c0, c1, … and where each name is now (the first, if a name repeats)."""
    places: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        places.setdefault(name, f"c{i}")
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), places


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the given names; other columns, also of clashing names, are left behind."""
    plain, places = by_place(df)
    return plain.select(*(plain[places[source]].alias(name) for name, source in columns.items()))


def split_bytes(spark: SparkSession) -> int:
    """The most bytes of files that Spark puts into one input split."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the files of shuffles nothing refers to any more, before the next large one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
